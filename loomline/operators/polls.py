"""Daily sentiment of parties from keyword lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_sets(keywords: DataFrame) -> tuple[dict[str, list[str]], list[str], list[str]]:
    """(by party, positive, negative) from a keyword table: a small list by nature; blanks are stripped, repeats fold."""
    rows = keywords.select(F.trim("party").alias("party"), F.lower(F.trim("polarity")).alias("polarity"), F.trim("keyword").alias("k")).where("k is not null and k <> ''").distinct().collect()
    parties = {p: sorted({r.k for r in rows if r.party == p}) for p in sorted({r.party for r in rows if r.party})}
    polar = lambda x: sorted({r.k for r in rows if r.polarity == x})
    return parties, polar("positive"), polar("negative")


def party_counts(df: DataFrame, day: str, tokens: str, parties: dict[str, list[str]], positive: list[str], negative: list[str], *keys: str) -> DataFrame:
    """(day, *keys, party, pos, neg): a message adds, for each of its tokens of a party, all its positive and
    negative tokens. Repeated tokens count as often as they occur. No shuffle but the final sums."""
    toks = F.transform(F.col(tokens), F.lower)
    hits = lambda words: F.size(F.filter(toks, lambda t: t.isin(words))) if words else F.lit(0)
    by_party = F.array(*[F.struct(F.lit(p).alias("party"), hits(words).alias("k")) for p, words in parties.items()])
    rows = df.where(F.col(tokens).isNotNull() & F.col(day).isNotNull()).select(F.col(day).alias("day"), *keys, hits(positive).alias("p"), hits(negative).alias("n"), F.explode(by_party).alias("x"))
    return rows.groupBy("day", *keys, F.col("x.party").alias("party")).agg(F.sum(F.col("x.k") * F.col("p")).alias("pos"), F.sum(F.col("x.k") * F.col("n")).alias("neg"))


def poll_sentiment(df: DataFrame, keywords: DataFrame, day: str, tokens: str, eps: float = 1.0) -> DataFrame:
    """(day, party, pos, neg, ratio) with ratio (pos + eps) / (neg + eps), for each day with a message and each party."""
    counts = party_counts(df, day, tokens, *keyword_sets(keywords))
    return counts.select("*", ((F.col("pos") + F.lit(eps)) / (F.col("neg") + F.lit(eps))).alias("ratio"))
