"""Readers of line-based inputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = r"(\d{4}-\d{2}-\d{2})"


def file_day(name: Column) -> Column:
    """The date in a file's base name, null if there is none."""
    return F.to_date(F.nullif(F.regexp_extract(F.element_at(F.split(name, "/"), -1), DATE, 1), F.lit("")))


def read_listed(spark: SparkSession, list_file: str, base: str) -> DataFrame:
    """(raw, file, day): lines of all files or folders that a list names, each under ``base``. The list itself is small."""
    names = [r.value.strip() for r in spark.read.text(list_file).collect() if r.value.strip()]
    if not names:
        return spark.createDataFrame([], "raw string, file string, day date")
    rows = spark.read.text([f"{base.rstrip('/')}/{n}" for n in names]).select(F.col("value").alias("raw"), F.split(F.input_file_name(), "/").alias("_p"))
    # A listed folder's name stands for those of the files in it.
    folder, file = F.element_at("_p", -2), F.element_at("_p", -1)
    return rows.select("raw", F.when(folder.isin(names), folder).otherwise(file).alias("file")).withColumn("day", file_day(F.col("file")))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(raw): one column of lines for ``operators.records.parse_lines``."""
    return spark.read.text(path).select(F.col("value").alias("raw"))


def read_terms(spark: SparkSession, path: str, name: str = "term") -> DataFrame:
    """One term a line, blanks stripped, empty lines left out."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "").distinct()


def read_dictionary(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """(id, word) from lines 'id word'."""
    part = lambda n: F.regexp_extract("value", r"^(\d+)\s+(.*)$", n)
    word = F.trim(part(2))
    return spark.read.text(path).where(F.col("value").rlike(r"^\d+\s")).select(part(1).cast("int").alias("id"), (F.lower(word) if lower else word).alias("word"))


def scan_pattern(lines: DataFrame, pattern: str, types: list[str] | None = None, col: str = "value") -> DataFrame:
    """One column for each group of ``pattern``, cast to the given types (double by default); lines that don't match
    give no row."""
    groups = re.compile(pattern).groups
    types = types or ["double"] * groups
    matched = lines.where(F.col(col).rlike(pattern))
    return matched.select(*[F.regexp_extract(col, pattern, i + 1).cast(t).alias(f"c{i}") for i, t in enumerate(types)])


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(word, cluster, importance) from lines 'word cluster importance'."""
    got = scan_pattern(spark.read.text(path), r"^(\S+) (\d+) (\S+)$", ["string", "int", "double"])
    return got.toDF("word", "cluster", "importance")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, coherence, label): the cluster is the number of the line, from 1. One small file."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    rows = [(i + 1, int(m[1]), " ".join(m[2].split())) for i, line in enumerate("\n".join(lines).splitlines()) if (m := re.match(r"^\s*(\d+)\s*(.*)$", line))]
    return spark.createDataFrame(rows, "cluster int, coherence int, label string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of whole pages, for ``operators.news.read_paragraphs``. Names must hold a date."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    return pages.where(F.col("file").rlike(rf"{DATE}\.[^/]*$|{DATE}[^/]*$"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    from loomline.operators.news import parse_triples

    return parse_triples(spark.read.text(path))


def read_user_regions(spark: SparkSession, path: str) -> DataFrame:
    """(user, region) from lines 'user region', regions from 1."""
    return scan_pattern(spark.read.text(path), r"^(\d+)\s+(\d+)\s*$", ["long", "int"]).toDF("user", "region")


def read_user_genders(spark: SparkSession, path: str) -> DataFrame:
    """(user, gender) from lines 'user 0|1': 0 is female, 1 male."""
    got = scan_pattern(spark.read.text(path), r"^(\d+)\s+([01])\s*$", ["long", "int"]).toDF("user", "g")
    return got.select("user", F.when(F.col("g") == 0, "female").otherwise("male").alias("gender"))


def vocabulary_of(words: DataFrame, index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, word), ids from 0: the chosen positions (pos, ref) lead to positions of an index (pos, ref), and those to words
    (pos, word); all positions count from 1. Positions that lead nowhere drop out."""
    second = index.select(F.col("pos").alias("ref"), F.col("ref").alias("at"))
    return chosen.join(second, "ref").join(words.select(F.col("pos").alias("at"), "word"), "at").select((F.col("pos") - 1).alias("id"), "word")
