"""Records, retweets, first occurrences, normalised terms, party sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import polls, records
from loomline.queries.common import ONCE, messages
from loomline.sources.tables import read_table


def message_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered line that is whole: its id and text."""
    return records.parse_lines(read_table(spark, d, "tweets").select("raw")).select("id", "text")


def retweet_filter(spark: SparkSession, d: str) -> DataFrame:
    return records.drop_retweets(messages(spark, d, "text", "retweeted_status")).select("ord")


def retweet_text(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d, "text").where("text is not null")
    return rows.select("ord", X.quoted(F.col("text")).alias("quoted")).where("quoted <> ''")


def doc_dedup_prefix(spark: SparkSession, d: str) -> DataFrame:
    return records.dedup_messages(messages(spark, d, "text", "retweeted_status", "analysis"))


def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d, "tokens").where("tokens is not null")
    return rows.select(F.explode("tokens").alias("token")).distinct().select("token", X.normalise(F.col("token")).alias("normal"))


def unigram_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d, "tokens").where("tokens is not null").select(F.explode(X.unigrams(F.col("tokens"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d, "tokens").where("tokens is not null").select(F.explode(X.bigrams(F.col("tokens"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def document_word_df(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("text is not null")
    return rows.select(F.explode(F.array_distinct(X.simple_tokens(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def link_domains(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d, "tokens").select(F.explode("tokens").alias("link")).where(F.col("link").startswith("http"))
    return rows.select(X.source_domain(F.col("link")).alias("domain")).where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("cnt"))


def poll_sentiment_daily(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d, "posted_at", "analysis").select(F.to_date("posted_at").alias("day"), F.col("analysis.tokens.unprotected").alias("t"))
    return polls.poll_sentiment(rows, read_table(spark, d, "keywords"), "day", "t").withColumn("ratio", F.round("ratio", 6)).withColumn("day", F.col("day").cast("string"))


def poll_by_party(spark: SparkSession, d: str) -> DataFrame:
    """Each party's series in the order of days."""
    daily = poll_sentiment_daily(spark, d)
    return daily.groupBy("party").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "pos", "neg"))), lambda x: x["pos"] - x["neg"]).alias("balance"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def keyword_matches(spark: SparkSession, d: str) -> DataFrame:
    """Messages of each keyword, as a semi-join would count them."""
    words = read_table(spark, d, "keywords").select(F.trim("keyword").alias("word")).where("word <> ''").distinct()
    rows = messages(spark, d, "analysis").select(F.explode(F.array_distinct(X.lower_all(F.col("analysis.tokens.unprotected")))).alias("word"))
    return rows.join(words, "word").groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def queries() -> dict:
    return {f.__name__: f for f in (message_parse, retweet_filter, retweet_text, doc_dedup_prefix, text_normalise, unigram_filter, bigram_counts, document_word_df, link_domains, poll_sentiment_daily, poll_by_party, keyword_matches)}


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)
_NORMAL = "regexp_replace(replace(regexp_replace(regexp_replace(lower({0}), '``|''''|‘‘|’’|“|”', '\"', 'g'), '`|‘|’', '''', 'g'), '…', '...'), '[0-9]+', '<num>', 'g')"
_SPACE = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_STRIP = lambda x: _SPACE(f"regexp_replace({_SPACE(x)}, '^:+|:+$', '', 'g')")
_RT, _VIA1, _VIA2 = X.RETWEET, r"\(via @\w+\)", r" via @\w+"
_PART = lambda pattern, n: f"regexp_extract(text, '(?s)^(.*?){pattern}(.*)$', {n})"
_AHEAD = f"case when regexp_matches(text, '{_VIA1}') then {_PART(_VIA1, 1)} else {_PART(_VIA2, 1)} end"
_QUOTED = f"""case when regexp_matches(text, '{X.VIA}') then
  case when ({_AHEAD}) = '' then trim(regexp_replace(trim(regexp_extract(text, '(?s)^(?:\\(via @\\w+\\)| via @\\w+)(.*?)\\[.*\\]', 1)), '^:', '')) else trim(regexp_replace(trim({_AHEAD}), '[|,./]$', '')) end
  when regexp_matches(text, '{_RT}') then case when {_PART(_RT, 2)} = '' then {_STRIP(_PART(_RT, 1))} else {_STRIP(_PART(_RT, 2))} end
  when regexp_matches(text, '^{X.LEADING_RT}') and regexp_matches(text, '@\\w') then regexp_extract(text, '(?s)^RT[\\s!.-:]+.*?@\\w+(.*)$', 1) else '' end"""
_KEY = """case when len(unprotected) >= 6 then array_to_string(list_slice(unprotected, 1, case when list_contains(unprotected, 'YouTube') then 5 else 6 end), ' ') else lower(array_to_string(unprotected, ' ')) end"""
_POLLS = f"""with {ONCE}, k as (select distinct trim(party) as party, lower(trim(polarity)) as polarity, trim(keyword) as word from keywords where trim(keyword) <> ''),
m as (select ord, cast(posted_at as date) as day, list_transform(unprotected, lambda w: lower(w)) as w from t where unprotected is not null and posted_at is not null),
e as (select ord, day, unnest(w) as word from m),
s as (select ord, count(*) filter (where polarity = 'positive') as p, count(*) filter (where polarity = 'negative') as n from e join k using (word) where polarity is not null group by ord),
h as (select ord, party, count(*) as c from e join k using (word) where party is not null group by ord, party),
g as (select distinct day, party from m, (select distinct party from k where party is not null)),
x as (select m.day, h.party, sum(h.c * coalesce(s.p, 0)) as pos, sum(h.c * coalesce(s.n, 0)) as neg from m join h using (ord) left join s using (ord) group by m.day, h.party),
y as (select g.day, g.party, cast(coalesce(pos, 0) as bigint) as pos, cast(coalesce(neg, 0) as bigint) as neg from g left join x on x.day = g.day and x.party = g.party)"""


def oracle_sql() -> dict[str, str]:
    return {
        "message_parse": """select cast(json_extract(raw, '$.id') as bigint) as id, json_extract_string(raw, '$.text') as text from tweets where json_valid(raw)""",
        "retweet_filter": f"with {ONCE} select ord from t where text is not null and coalesce(rt_text, {_QUOTED}, '') = ''",
        "retweet_text": f"with {ONCE}, q as (select ord, {_QUOTED} as quoted from t where text is not null) select ord, quoted from q where quoted <> ''",
        "doc_dedup_prefix": f"with {ONCE}, q as (select ord, {_KEY} as key from t where text is not null and coalesce(rt_text, {_QUOTED}, '') = '' and unprotected is not null) select key, min(ord) as first from q group by key",
        "text_normalise": f"with {ONCE}, e as (select distinct unnest(tokens) as token from t) select token, {_NORMAL.format('token')} as normal from e",
        "unigram_filter": f"with {ONCE}, e as (select unnest(tokens) as token from t), n as (select {_NORMAL.format('token')} as term from e) select term, count(*) as cnt from n where length(term) > 1 and term not in ({_STOP}) and not regexp_matches(term, '^[^A-Za-z0-9_]+$') group by term",
        "bigram_counts": f"""with {ONCE}, n as (select list_transform(tokens, lambda x: {_NORMAL.format('x')}) as w from t where len(tokens) > 1),
            e as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || '__' || w[i + 1])) as term from n) select term, count(*) as cnt from e group by term""",
        "document_word_df": r"""with e as (select doc_id, unnest(list_distinct(string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' '))) as word from documents where trim(regexp_replace(text, '\s+', ' ', 'g')) <> '') select word, count(*) as cnt from e group by word""",
        "link_domains": f"""with {ONCE}, e as (select unnest(tokens) as link from t), h as (select lower(regexp_extract(link, '^http[^:]*://(?:[^/@]*@)?([^/:?#]+)', 1)) as host from e where link like 'http%'),
            x as (select regexp_extract(host, '([^.]+\\.[^.]+)$', 1) as domain from h where host <> '' and not regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$')) select domain, count(*) as cnt from x where domain <> '' group by domain""",
        "poll_sentiment_daily": _POLLS + " select cast(day as varchar) as day, party, pos, neg, round((pos + 1) / (neg + 1), 6) as ratio from y",
        "poll_by_party": _POLLS + " select party, list(pos - neg order by day) as balance, cast(sum(pos) as bigint) as pos, cast(sum(neg) as bigint) as neg from y group by party",
        "keyword_matches": f"with {ONCE}, e as (select ord, unnest(list_distinct(list_transform(unprotected, lambda w: lower(w)))) as word from t) select word, count(*) as cnt from e where word in (select trim(keyword) from keywords) group by word",
    }
