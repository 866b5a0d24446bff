"""Stories, sources, terms, facts, indexes, roll-ups and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import news
from loomline.plans.lineage import cut
from loomline.sources.tables import read_table

MIN_SOURCE, MIN_TERM = 10, 3


def _stories(spark: SparkSession, d: str) -> DataFrame:
    return news.unique_stories(read_table(spark, d, "stories"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return news.keep_sources(_stories(spark, d), MIN_SOURCE)


def _counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    kept = cut(_kept(spark, d))
    frequencies = cut(news.term_frequency(kept))
    return kept, frequencies, news.term_counts(kept, frequencies, MIN_TERM)


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Keywords as terms: their party or polarity is their class; classes have superclasses."""
    k = read_table(spark, d, "keywords")
    classes = k.select(F.trim("keyword").alias("word"), F.coalesce(F.trim("party"), F.trim("polarity")).alias("class")).distinct()
    edges = spark.createDataFrame([("civic", "party"), ("harbour", "party"), ("meadow", "party"), ("positive", "polarity"), ("negative", "polarity"), ("party", "actor"), ("polarity", "opinion"), ("actor", "thing"), ("opinion", "thing")], "child string, parent string")
    return classes, edges


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


def source_freq(spark: SparkSession, d: str) -> DataFrame:
    return news.source_frequency(_stories(spark, d))


def source_freq_days(spark: SparkSession, d: str) -> DataFrame:
    return news.source_frequency(_stories(spark, d), "day")


def kept_sources(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_kept(spark, d).select("day", "story", "source"))


def term_freq_filter(spark: SparkSession, d: str) -> DataFrame:
    return news.term_frequency(_kept(spark, d)).where(F.col("freq") > MIN_TERM)


def day_source_articles(spark: SparkSession, d: str) -> DataFrame:
    return _dated(news.article_counts(_kept(spark, d)))


def day_source_facts(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_counts(spark, d)[2])


def term_index(spark: SparkSession, d: str) -> DataFrame:
    return news.term_index(news.term_frequency(_kept(spark, d)), MIN_TERM)


def source_index(spark: SparkSession, d: str) -> DataFrame:
    return news.source_index(_kept(spark, d))


def index_encode(spark: SparkSession, d: str) -> DataFrame:
    kept, frequencies, counts = _counts(spark, d)
    return news.index_encode(counts, news.term_index(frequencies, MIN_TERM), news.source_index(kept))


def month_rollup(spark: SparkSession, d: str) -> DataFrame:
    return news.month_rollup(_counts(spark, d)[2])


def class_closure(spark: SparkSession, d: str) -> DataFrame:
    return news.class_closure(*_classes(spark, d))


def _keyword_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All terms of the kept stories, without a frequency bound, so that keywords remain."""
    kept = cut(_kept(spark, d))
    return kept, news.term_counts(kept, news.term_frequency(kept), 0)


def class_expand_direct(spark: SparkSession, d: str) -> DataFrame:
    return _dated(news.expand_classes(_keyword_facts(spark, d)[1], _classes(spark, d)[0]))


def class_expand_all(spark: SparkSession, d: str) -> DataFrame:
    kept, counts = _keyword_facts(spark, d)
    return _dated(news.expand_classes(counts, *_classes(spark, d), news.article_counts(kept)))


def class_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of classes added to those of the terms."""
    existing = news.term_index(news.term_frequency(_kept(spark, d)), MIN_TERM).select("idx", F.col("term").alias("key"))
    return news.incremental_ids(class_closure(spark, d).select(F.concat(F.lit("class:"), "class").alias("key")), cut(existing), "key")


def triples_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as triples, parsed and pivoted back."""
    ns = "http://example.org/facts#"
    lines = news.to_triples(_counts(spark, d)[2], ns)
    return _dated(news.facts_from_triples(news.parse_triples(lines), ns)[1])


def thread_stories(spark: SparkSession, d: str) -> DataFrame:
    """Story segmentation over the lines of threads as paragraphs: a line with a tag ends a story with the tag's site
    as source, a line of four words or less without a tag says that there is no source."""
    lines = read_table(spark, d, "documents").where("kind = 'thread' and text is not null").select(F.col("doc_id").cast("string").alias("file"), "day", F.posexplode(F.split("text", "\n")).alias("par", "line"))
    tag = F.regexp_extract("line", r"#(\w+)", 1)
    stock = (F.trim("line") != "") & (tag == "") & (F.size(F.split(F.trim("line"), " ")) <= 4)
    strings = F.when(stock, F.array(F.lit("No"), F.lit("link"))).when(F.trim("line") == "", F.array().cast("array<string>")).otherwise(F.array("line"))
    hrefs = F.when(stock | (tag == ""), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("http://www."), tag, F.lit(".example/x"))))
    words = F.filter(F.split(F.lower("line"), " "), lambda w: w.rlike("^[a-z]+$"))
    paragraphs = lines.select("file", "day", "par", strings.alias("strings"), hrefs.alias("hrefs"), words.alias("terms"))
    out = news.segment_stories(paragraphs)
    return out.select("file", "story", F.size("terms").alias("n_terms"), F.array_join("sources", ",").alias("sources"))


def queries() -> dict:
    return {f"news_{f.__name__}" if f.__name__ in ("term_index", "source_index") else f.__name__: f for f in (source_freq, source_freq_days, kept_sources, term_freq_filter, day_source_articles, day_source_facts, term_index, source_index, index_encode, month_rollup, class_closure, class_expand_direct, class_expand_all, class_ids, triples_roundtrip, thread_stories)}


_KEPT = f"""with recursive s as (select day, story, any_value(terms) as terms, any_value(sources) as sources from stories where day is not null and story is not null group by day, story),
e as (select day, story, terms, unnest(list_distinct(sources)) as source from s),
f as (select source, count(distinct case when source = 'No Source' then cast(day as varchar) else cast(day as varchar) || '#' || cast(story as varchar) end) as freq from e where source is not null group by source),
k as (select day, story, terms, source from e where source in (select source from f where freq >= {MIN_SOURCE}))"""
_TERMS = _KEPT + """, u as (select day, story, any_value(terms) as terms from k group by day, story),
w as (select unnest(terms) as term from u), g as (select term, count(*) as freq from w where term is not null group by term)"""
_FACTS = _TERMS + """, a as (select day, source, unnest(terms) as term from k), ac as (select day, source, count(*) as article_count from k group by day, source),
c as (select day, source, term, count(*) as cnt from a where term in (select term from g where freq > {0}) group by day, source, term)"""
_IDX = f", ti as (select cast(row_number() over (order by freq desc, term) - 1 as integer) as idx, term, freq from g where freq > {MIN_TERM}), " + """
fs as (select source, min((day, story)) as f from k where source <> 'No Source' group by source),
si as (select cast(row_number() over (order by f, source) as integer) as uid, source from fs union all select 0, 'No Source')"""
_CLASS = """, wc as (select distinct trim(keyword) as word, coalesce(trim(party), trim(polarity)) as class from keywords where keyword is not null and coalesce(party, polarity) is not null),
ed(child, parent) as (values ('civic','party'),('harbour','party'),('meadow','party'),('positive','polarity'),('negative','polarity'),('party','actor'),('polarity','opinion'),('actor','thing'),('opinion','thing')),
cl(word, class) as (select word, class from wc union select cl.word, ed.parent from cl join ed on ed.child = cl.class)"""


def oracle_sql() -> dict[str, str]:
    facts, every = _FACTS.format(MIN_TERM), _FACTS.format(0)
    return {
        "source_freq": _KEPT + " select source, freq from f",
        "source_freq_days": _KEPT + " select source, count(distinct day) as freq from e where source is not null group by source",
        "kept_sources": _KEPT + " select cast(day as varchar) as day, story, source from k",
        "term_freq_filter": _TERMS + f" select term, freq from g where freq > {MIN_TERM}",
        "day_source_articles": facts + " select cast(day as varchar) as day, source, article_count from ac",
        "day_source_facts": facts + " select cast(day as varchar) as day, source, term, cnt from c",
        "news_term_index": _TERMS + _IDX + " select idx, term, freq from ti",
        "news_source_index": _TERMS + _IDX + " select uid, source from si",
        "index_encode": facts + _IDX + " select cast(c.day - (select min(day) from c) as integer) as day_id, uid, idx, cnt from c join ti using (term) join si using (source)",
        "month_rollup": facts + " select strftime(day, '%Y-%m') as month, source, term, cast(sum(cnt) as bigint) as cnt from c group by 1, 2, 3",
        "class_closure": _KEPT + _CLASS + " select word, class from cl",
        "class_expand_direct": every + _CLASS + " select cast(day as varchar) as day, class, cast(sum(cnt) as bigint) as cnt from c join wc on wc.word = c.term group by day, class",
        "class_expand_all": every + _CLASS + " select cast(x.day as varchar) as day, x.source, x.class, x.cnt, ac.article_count from (select day, source, class, cast(sum(cnt) as bigint) as cnt from c join cl on cl.word = c.term group by day, source, class) x join ac on ac.day = x.day and ac.source = x.source",
        "class_ids": _TERMS + _IDX + _CLASS + ", nk as (select distinct 'class:' || class as key from cl) select idx, term as key from ti union all select cast((select coalesce(max(idx), -1) from ti) + row_number() over (order by key) as integer), key from nk",
        "triples_roundtrip": facts + " select cast(day as varchar) as day, source, term, cnt from c",
        "thread_stories": r"""with p as (select doc_id, string_split(text, chr(10)) as ls from documents where kind = 'thread' and text is not null),
            l as (select doc_id, unnest(range(0, len(ls))) as par, unnest(ls) as line from p),
            m as (select *, regexp_extract(line, '#(\w+)', 1) as tag, trim(line) <> '' and not regexp_matches(line, '#(\w+)') and len(string_split(trim(line), ' ')) <= 4 as stock from l where trim(line) <> '' or regexp_matches(line, '#(\w+)')),
            q as (select *, stock or tag <> '' as ends, coalesce(sum(case when stock or tag <> '' then 1 else 0 end) over (partition by doc_id order by par rows between unbounded preceding and 1 preceding), 0) + 1 as story from m)
            select cast(doc_id as varchar) as file, cast(story as bigint) as story, cast(sum(len(list_filter(string_split(lower(line), ' '), lambda w: regexp_matches(w, '^[a-z]+$')))) as integer) as n_terms,
              max(case when stock then 'No Source' when tag <> '' then lower(tag) || '.example' end) as sources from q group by doc_id, story having bool_or(ends)""",
    }
