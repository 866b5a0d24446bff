"""Tokeniser, stemmer and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import stemmers, tokeniser
from loomline.queries.common import ONCE, WORDS, messages
from loomline.streaming import flows


def tokenise_full(spark: SparkSession, d: str) -> DataFrame:
    """(ord, tokens, offsets) of every message, from its text."""
    rows = messages(spark, d, "text").select("ord", tokeniser.analyse("text").alias("a"))
    pick = lambda f: F.transform("a.tokens", lambda t: t[f])
    return rows.select("ord", pick("token").alias("tokens"), pick("pos").alias("offsets"))


def tok_lang(spark: SparkSession, d: str) -> DataFrame:
    """The string of proper words among the stored tokens."""
    return messages(spark, d, "tokens").select("ord", tokeniser.language_words(F.col("tokens")).alias("tok_lang"))


def stem(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d, "tokens", "lang_det")
    return rows.select("ord", stemmers.stem_tokens(F.col("tokens"), F.col("lang_det")).alias("stemmed"))


def stream_retweet_filter(spark: SparkSession, d: str) -> DataFrame:
    return flows.run_available(flows.retweet_filter(flows.table_stream(spark, f"{d}/tweets.parquet"))).select("ord")


def stream_word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of all deliveries after the last batch."""
    rows = flows.run_available(flows.word_counts(flows.table_stream(spark, f"{d}/tweets.parquet")), "update")
    return rows.groupBy("word").agg(F.max_by("cnt", "_batch").alias("cnt"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the messages that aren't retweets, each once."""
    return flows.run_available(flows.first_by_key(flows.table_stream(spark, f"{d}/tweets.parquet"))).select("key")


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = flows.run_available(flows.windowed_counts(flows.table_stream(spark, f"{d}/events.parquet"), "ts", "event_type", delay="60 days"), "update")
    return rows.groupBy(F.col("start").cast("string").alias("start"), "event_type").agg(F.max_by("n", "_batch").alias("n"))


def queries() -> dict:
    return {f.__name__: f for f in (tokenise_full, tok_lang, stem, stream_retweet_filter, stream_word_counts, stream_dedup, stream_event_windows)}


def oracle_sql() -> dict[str, str]:
    from loomline.queries.text import _KEY, _QUOTED

    plain = f"text is not null and coalesce(retweeted_status.text, {_QUOTED}, '') = ''"
    return {
        "tok_lang": f"with {ONCE} select ord, tok_lang from t",
        "stream_retweet_filter": f"select ord from tweets where {plain}",
        "stream_word_counts": f"with e as (select unnest({WORDS.format('analysis.tokens.\"all\"')}) as word from tweets) select word, count(*) as cnt from e group by word",
        "stream_dedup": f"with t as (select *, analysis.tokens.unprotected as unprotected from tweets), q as (select {_KEY} as key from t where {plain} and unprotected is not null) select distinct key from q",
        "stream_event_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events where ts is not null group by 1, 2",
    }
