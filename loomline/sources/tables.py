"""Reading the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the directory; filters and column choices reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_panel(spark: SparkSession, path: str, days: tuple[int, int] | None = None, regions: list[int] | None = None, words: DataFrame | None = None, genders: list[str] | None = None) -> DataFrame:
    """A panel written by ``sinks.write_panel``: days from the first up to but without the second, and the given
    regions or genders, open only their folders; ``words`` (word) keeps those words by a semi-join."""
    rows = spark.read.parquet(path)
    if days is not None:
        rows = rows.where((F.col("day") >= days[0]) & (F.col("day") < days[1]))
    if regions is not None:
        rows = rows.where(F.col("region").isin(regions))
    if genders is not None:
        rows = rows.where(F.col("gender").isin(genders))
    return rows if words is None else rows.join(words.select("word").distinct(), "word", "left_semi")


def next_index(index: DataFrame, column: str = "idx") -> int:
    """The first free id of an index: its maximum + 1, 0 for an empty one."""
    top = index.agg(F.max(column)).first()[0]
    return 0 if top is None else top + 1


def load_metrics(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The blocks that ``sinks.append_metrics`` wrote, of all runs or one."""
    rows = spark.read.parquet(path)
    return rows if run is None else rows.where(F.col("run") == run)
