"""Document frequencies, vocabulary, co-occurrence and normalised pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import lower_all, strip_quotes
from loomline.plans.lineage import dense_ids


def distinct_words(tokens: Column) -> Column:
    """Distinct lower-cased tokens without enclosing quotes; empty ones drop out."""
    return F.filter(F.array_distinct(F.transform(lower_all(tokens), strip_quotes)), lambda w: w.isNotNull() & (w != ""))


def document_frequency(df: DataFrame, words: Column) -> DataFrame:
    """(word, cnt): the number of rows with each word of the array ``words`` of distinct words."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary_filter(counts: DataFrame, threshold: int) -> DataFrame:
    """Words that begin with # or a letter and occur more than ``threshold`` times."""
    return counts.where((F.col("word").startswith("#") | F.col("word").rlike(r"^\p{L}")) & (F.col("cnt") > threshold))


def vocabulary(counts: DataFrame, threshold: int) -> DataFrame:
    """(id, word, cnt): ids from 1 in the byte order of the kept words."""
    return dense_ids(vocabulary_filter(counts, threshold), "word").select("id", "word", "cnt")


def to_ids(df: DataFrame, id_col: str, words: Column, vocab: DataFrame) -> DataFrame:
    """(id_col, ids): sorted ids of each row's words; words out of the vocabulary are skipped, before any pairing.

    The vocabulary side is broadcast only where the planner finds it small.
    """
    flat = df.select(id_col, F.explode(words).alias("word"))
    return flat.join(vocab.select("word", F.col("id").alias("wid")), "word").groupBy(id_col).agg(F.array_sort(F.collect_set("wid")).alias("ids"))


def pair_counts(records: DataFrame) -> DataFrame:
    """(i, j, cnt), i < j: rows in which both ids occur. ``records`` has a sorted array ``ids`` of one short message."""
    n = F.size("ids")
    heads = records.where(n > 1).select("ids", F.posexplode("ids").alias("p", "i"))
    pairs = heads.select("i", F.explode(F.slice("ids", F.col("p") + 2, F.greatest(F.size("ids") - F.col("p") - 1, F.lit(0)))).alias("j"))
    return pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("cnt"))


def npmi(pairs: DataFrame, vocab: DataFrame, min_count: int = 10) -> DataFrame:
    """(i, j, npmi) for pairs whose words both occur more than ``min_count`` times and not only together.

    Word counts are normalised by their sum, pair counts by theirs, both over the whole vocabulary.
    """
    words = vocab.agg(F.sum("cnt").cast("double")).first()[0] or 0.0
    total = pairs.agg(F.sum("cnt").cast("double")).first()[0] or 0.0
    side = lambda s: vocab.select(F.col("id").alias(s), F.col("cnt").cast("double").alias(f"c{s}"))
    joined = pairs.withColumn("c", F.col("cnt").cast("double")).join(side("i"), "i").join(side("j"), "j")
    kept = joined.where((F.col("c") != F.col("ci")) & (F.col("c") != F.col("cj")) & (F.col("ci") > min_count) & (F.col("cj") > min_count))
    value = F.ln(F.col("c") * F.lit(words) * F.lit(words) / (F.col("ci") * F.col("cj") * F.lit(total))) / -F.ln(F.col("c") / F.lit(total))
    return kept.select("i", "j", value.alias("npmi"))


def truncate(edges: DataFrame, threshold: float, value: str = "npmi") -> DataFrame:
    return edges.where(F.col(value) > threshold)


def symmetrise(edges: DataFrame, i: str = "i", j: str = "j", value: str = "npmi") -> DataFrame:
    """(src, dst, weight): every edge in both directions, by one pass over the edges."""
    both = F.explode(F.array(F.struct(F.col(i).alias("src"), F.col(j).alias("dst")), F.struct(F.col(j).alias("src"), F.col(i).alias("dst"))))
    return edges.select(both.alias("e"), F.col(value).alias("weight")).select("e.src", "e.dst", "weight")
