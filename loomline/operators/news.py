"""Annotated news pages to stories, per-source facts, indexes and roll-ups, and class expansion."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.text import source_domain
from loomline.plans.lineage import cut, dense_ids

NO_SOURCE = "No Source"
# Entity elements of a page and attributes of its mentions, with the class each stands for.
ENTITIES = {"Person": "http://dbpedia.org/ontology/Person", "Location": "http://dbpedia.org/ontology/Place", "Organization": "http://dbpedia.org/ontology/Organisation"}
MENTION_ATTRIBUTES = {
    "officeowl": "http://dbpedia.org/ontology/office", "partyowl": "http://dbpedia.org/ontology/PoliticalParty", "birthplaceowl": "http://dbpedia.org/ontology/birthPlace",
    "countryowl": "http://dbpedia.org/ontology/Country", "leadernameowl": "http://dbpedia.org/ontology/leaderName", "birthcountry": "http://dbpedia.org/ontology/birthPlace",
    "officeprop": "http://dbpedia.org/property/office", "partyprop": "http://dbpedia.org/property/party", "countryprop": "http://dbpedia.org/property/country",
}
RESOURCE = "http://dbpedia.org/resource/"

PARAGRAPHS = (
    "file string, day date, par int, strings array<string>, hrefs array<string>, "
    "terms array<struct<term:string,uri:string,type:string>>, tokens array<struct<string:string,category:string>>"
)


def _texts(node: ET.Element, skip: set[str]) -> list[str]:
    out: list[str] = []

    def walk(x: ET.Element) -> None:
        if x.tag not in skip:
            out.append(x.text or "")
            for child in x:
                walk(child)
                out.append(child.tail or "")

    walk(node)
    return [t for t in (s.strip() for s in out) if t]


def _annotations(par: ET.Element) -> list[dict]:
    """Entities by kind, then mentions with their attribute values, in document order within each kind."""
    found = []
    for kind, uri in ENTITIES.items():
        for x in par.iter(kind):
            if name := "_".join(_texts(x, {"script"})):
                found.append({"term": f"annotated:{name}", "uri": RESOURCE + name, "type": uri})
    for x in par.iter("Mention"):
        inst = x.get("inst", "")
        found.append({"term": "annotated:" + inst.replace(RESOURCE, ""), "uri": inst, "type": x.get("class")})
        for attribute, uri in MENTION_ATTRIBUTES.items():
            for value in (v.strip().replace(" ", "_") for v in x.get(attribute, "").split(",")):
                if value:
                    full = value if "http" in value else RESOURCE + value
                    found.append({"term": "annotated:" + full.replace(RESOURCE, ""), "uri": full, "type": uri})
    return found


def read_paragraphs(pages: DataFrame) -> DataFrame:
    """Paragraphs of pages (file, content): those below the first div of class newsbody. The day is the date in the
    file name; pages that aren't well-formed or have no such div give no rows. Text within scripts doesn't count."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, content in zip(frame["file"], frame["content"], strict=True):
                date = re.search(r"\d{4}-\d{2}-\d{2}", str(file).rsplit("/", 1)[-1])
                try:
                    root = ET.fromstring(content)
                except (ET.ParseError, TypeError):
                    continue
                body = next((d for d in root.iter("div") if d.get("class") == "newsbody"), None)
                for n, par in enumerate(body.iter("p") if body is not None else ()):
                    tokens = [{"string": t.get("string"), "category": t.get("category")} for t in par.iter("Token")]
                    hrefs = [a.get("href", "") for a in par.iter("a")]
                    rows.append((file, pd.to_datetime(date[0]).date() if date else None, n, _texts(par, {"script"}), hrefs, _annotations(par), tokens))
            yield pd.DataFrame(rows, columns=["file", "day", "par", "strings", "hrefs", "terms", "tokens"])

    return pages.select("file", "content").mapInPandas(run, PARAGRAPHS)


def segment_stories(paragraphs: DataFrame) -> DataFrame:
    """(file, day, story, terms, sources): paragraphs gathered up to the one that ends a story.

    A paragraph with a link to a valid domain ends a story with its domains as sources; the words 'No', 'link' end it
    without source; links to nothing valid make a paragraph's terms not count; empty paragraphs are passed over; what
    comes after the last end is dropped. Stories are numbered from 1 within a file. The window is over one page.
    """
    domains = F.array_distinct(F.filter(F.transform("hrefs", lambda h: source_domain(h)), lambda d: d.isNotNull()))
    linked = F.size("hrefs") > 0
    no_link = ~linked & (F.array_join("strings", "\x00") == F.lit("No\x00link"))
    rows = paragraphs.withColumn("domains", domains)
    ends = (linked & (F.size("domains") > 0)) | no_link
    rows = rows.where(linked | (F.size("strings") > 0)).withColumn("ends", ends)
    terms = F.when(linked & ~F.col("ends"), F.slice("terms", 1, 0)).otherwise(F.col("terms"))
    order = Window.partitionBy("file").orderBy("par").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("story", F.coalesce(F.sum(F.col("ends").cast("int")).over(order), F.lit(0)) + 1).withColumn("terms", terms)
    grouped = rows.groupBy("file", "day", "story").agg(
        F.array_sort(F.collect_list(F.struct("par", "terms"))).alias("t"),
        F.max("ends").alias("ended"),
        F.max(F.when(F.col("ends"), F.when(no_link, F.array(F.lit(NO_SOURCE))).otherwise(F.col("domains")))).alias("sources"),
    )
    return grouped.where("ended").select("file", "day", "story", F.flatten(F.transform("t", lambda x: x["terms"])).alias("terms"), "sources")


def unique_stories(stories: DataFrame) -> DataFrame:
    """One row per (day, story): redelivered stories count once."""
    return stories.where("day is not null and story is not null").dropDuplicates(["day", "story"])


def source_frequency(stories: DataFrame, count_mode: str = "article") -> DataFrame:
    """(source, freq): stories per source; with count_mode 'day', days per source. 'No Source' always counts once a day."""
    rows = stories.select("day", "story", F.explode(F.array_distinct("sources")).alias("source")).where("source is not null")
    unit = F.col("day").cast("string") if count_mode == "day" else F.when(F.col("source") == NO_SOURCE, F.col("day").cast("string")).otherwise(F.concat_ws("#", "day", "story"))
    return rows.select("source", unit.alias("u")).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("freq"))


def keep_sources(stories: DataFrame, min_freq: int | None, count_mode: str = "article") -> DataFrame:
    """(day, story, terms, source), one row per kept source of a story; stories without one drop out. None keeps all."""
    rows = stories.select("day", "story", "terms", F.explode(F.array_distinct("sources")).alias("source")).where("source is not null")
    if min_freq is None:
        return rows
    kept = source_frequency(stories, count_mode).where(F.col("freq") >= min_freq).select("source")
    return rows.join(kept, "source", "left_semi").select("day", "story", "terms", "source")


def term_frequency(kept: DataFrame) -> DataFrame:
    """(term, freq) over the stories of ``keep_sources``, each story once however many sources it has."""
    stories = kept.select("day", "story", "terms").dropDuplicates(["day", "story"])
    return stories.select(F.explode("terms").alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def article_counts(kept: DataFrame) -> DataFrame:
    return kept.groupBy("day", "source").agg(F.count(F.lit(1)).alias("article_count"))


def term_counts(kept: DataFrame, frequencies: DataFrame, min_count: int = 11) -> DataFrame:
    """(day, source, term, cnt) of the terms that occur more than ``min_count`` times."""
    able = frequencies.where(F.col("freq") > min_count).select("term")
    return kept.select("day", "source", F.explode("terms").alias("term")).join(able, "term", "left_semi").groupBy("day", "source", "term").agg(F.count(F.lit(1)).alias("cnt"))


def term_index(frequencies: DataFrame, min_count: int = 11) -> DataFrame:
    """(idx, term): ids from 0 by falling frequency, equal ones by term."""
    able = frequencies.where(F.col("freq") > min_count)
    return dense_ids(able, F.desc("freq"), F.col("term"), start=0, name="idx").select("idx", "term", "freq")


def source_index(kept: DataFrame) -> DataFrame:
    """(uid, source): 'No Source' is 0, others from 1 by first appearance (day, story, name)."""
    first = kept.where(F.col("source") != NO_SOURCE).groupBy("source").agg(F.min(F.struct("day", "story")).alias("f"))
    ids = dense_ids(first, F.col("f.day"), F.col("f.story"), F.col("source"), start=1, name="uid").select("uid", "source")
    return ids.unionByName(kept.sparkSession.createDataFrame([(0, NO_SOURCE)], "uid int, source string"))


def day_index(days: DataFrame, day_col: str = "day") -> Column:
    """Days since the oldest day of ``days``, as a column."""
    oldest = days.agg(F.min(day_col)).first()[0]
    return F.datediff(F.col(day_col), F.lit(oldest))


def index_encode(counts: DataFrame, terms: DataFrame, sources: DataFrame) -> DataFrame:
    """(day_id, uid, idx, cnt): facts with their ids; a fact without an id or two facts of one cell are an error
    (``last_of_cell`` picks one of them)."""
    joined = assert_single(counts).join(terms.select("term", "idx"), "term", "left").join(sources, "source", "left").withColumn("day_id", day_index(counts))
    known = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"no {c} for a fact")).cast("int")).otherwise(F.col(c))
    return joined.select("day_id", known("uid").alias("uid"), known("idx").alias("idx"), "cnt")


def last_of_cell(facts: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(day, source, term, cnt): of several facts of one cell the one written last, that is of the greatest ordinal."""
    return facts.groupBy("day", "source", "term").agg(F.max_by("cnt", ordinal).alias("cnt"))


def assert_single(facts: DataFrame) -> DataFrame:
    """The facts as they are; an error where two are of one cell."""
    n = F.count(F.lit(1)).over(Window.partitionBy("day", "source", "term"))
    return facts.withColumn("_n", n).withColumn("cnt", F.when(F.col("_n") > 1, F.raise_error(F.lit("two facts of one cell")).cast("long")).otherwise(F.col("cnt"))).drop("_n")


def month_rollup(counts: DataFrame) -> DataFrame:
    """(month, source, term, cnt)."""
    return counts.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "source", "term").agg(F.sum("cnt").alias("cnt"))


def term_metadata(terms: DataFrame) -> DataFrame:
    """(term, uri, type) from (ordinal, term, uri, type): the first record of a term counts."""
    return terms.groupBy("term").agg(F.min_by(F.struct("uri", "type"), "ordinal").alias("m")).select("term", "m.uri", "m.type")


def class_closure(classes: DataFrame, edges: DataFrame, max_depth: int = 50) -> DataFrame:
    """(word, class): each word's direct class and all superclasses over the edges (child, parent).

    Semi-naive: a round joins only the pairs found in the last one. Cycles end by themselves.
    """
    known = cut(classes.select("word", "class").where("word is not null and class is not null").distinct())
    fresh = known
    for _ in range(max_depth):
        up = fresh.join(edges, fresh["class"] == edges["child"]).select("word", F.col("parent").alias("class")).distinct()
        fresh = cut(up.join(known, ["word", "class"], "left_anti"))
        if fresh.limit(1).count() == 0:
            return known
        known = cut(known.unionByName(fresh))
    raise RuntimeError("class hierarchy is deeper than max_depth")


def expand_classes(counts: DataFrame, classes: DataFrame, edges: DataFrame | None = None, articles: DataFrame | None = None) -> DataFrame:
    """Counts by class: direct mode (day, class, cnt) without ``edges``, else all superclasses by (day, source), with
    the source's article count of that day where ``articles`` is given."""
    word_class = classes.select("word", "class").distinct() if edges is None else class_closure(classes, edges)
    joined = counts.join(word_class, counts["term"] == word_class["word"])
    if edges is None:
        return joined.groupBy("day", "class").agg(F.sum("cnt").alias("cnt"))
    summed = joined.groupBy("day", "source", "class").agg(F.sum("cnt").alias("cnt"))
    return summed if articles is None else summed.join(articles, ["day", "source"])


def incremental_ids(new: DataFrame, existing: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """(name, key): the existing ids, and ids from their maximum + 1 for keys of ``new`` that have none."""
    top = existing.agg(F.max(name)).first()[0]
    fresh = new.select(key).where(F.col(key).isNotNull()).distinct().join(existing, key, "left_anti")
    return existing.select(name, key).unionByName(dense_ids(fresh, key, start=0 if top is None else top + 1, name=name).select(name, key))


def pos_terms(tokens: Column, normalised: Column) -> Column:
    """word/category of each token whose normalised form is kept (not null)."""
    return F.filter(F.zip_with(tokens, normalised, lambda t, n: F.concat(n, F.lit("/"), t["category"])), lambda x: x.isNotNull())


NTRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z-]+)?)\s*\.\s*$'


def parse_triples(lines: DataFrame, col: str = "value") -> DataFrame:
    """(s, p, o, o_type) from lines of N-Triples; other lines give no row."""
    part = lambda n: F.regexp_extract(col, NTRIPLE, n)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    o = part(3)
    value = F.when(o.startswith('"'), F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(bare(o))
    kind = F.when(o.startswith('"'), F.coalesce(F.nullif(F.regexp_extract(o, r"\^\^<([^>]*)>$", 1), F.lit("")), F.lit("http://www.w3.org/2001/XMLSchema#string")))
    return lines.where(F.col(col).rlike(NTRIPLE)).select(bare(part(1)).alias("s"), bare(part(2)).alias("p"), value.alias("o"), kind.alias("o_type"))


def facts_from_triples(triples: DataFrame, ns: str) -> tuple[DataFrame, DataFrame]:
    """(article_counts, term_counts) from a triple table: predicates become columns in one aggregation, no self-joins."""
    pick = lambda name: F.max(F.when(F.col("p") == ns + name, F.col("o"))).alias(name)
    wide = triples.groupBy("s").agg(*map(pick, ("date", "byuser", "article_count", "word", "count")))
    articles = wide.where("article_count is not null").select(F.to_date("date").alias("day"), F.col("byuser").alias("source"), F.col("article_count").cast("long").alias("article_count"))
    words = wide.where("word is not null").select(F.to_date("date").alias("day"), F.col("byuser").alias("source"), F.col("word").alias("term"), F.col("count").cast("long").alias("cnt"))
    return articles, words


def to_triples(counts: DataFrame, ns: str) -> DataFrame:
    """(day, value): N-Triples lines of (day, source, term, cnt), each fact a blank node named by its key."""
    node = F.concat(F.lit("_:f"), F.hex(F.xxhash64("day", "source", "term")))
    literal = lambda c, t: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit(f'"^^<http://www.w3.org/2001/XMLSchema#{t}>'))
    parts = [("date", literal("day", "date")), ("byuser", literal("source", "string")), ("word", literal("term", "string")), ("count", literal("cnt", "integer"))]
    lines = F.array(*[F.concat(node, F.lit(f" <{ns}{name}> "), value, F.lit(" .")) for name, value in parts])
    return counts.select("day", F.explode(lines).alias("value"))
