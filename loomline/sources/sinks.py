"""Writers. Each writes a folder and replaces what was there unless it appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """key TAB count, keys as they are."""
    counts.select(F.concat_ws("\t", *counts.columns).alias("value")).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str, i: str = "i", j: str = "j", value: str = "npmi") -> None:
    """'i j value' with ten decimals."""
    edges.select(F.format_string("%d %d %.10f", i, j, value).alias("value")).write.mode("overwrite").text(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """'word cluster importance' with five decimals."""
    clusters.select(F.format_string("%s %d %.5f", "word", "cluster", "importance").alias("value")).write.mode("overwrite").text(path)


def write_by_party(daily: DataFrame, path: str) -> None:
    """One folder a party, its days in order."""
    daily.repartition("party").sortWithinPartitions("party", "day").write.mode("overwrite").partitionBy("party").csv(path, header=True)


def write_news(path: str, counts: DataFrame, articles: DataFrame, terms: DataFrame, sources: DataFrame, days: DataFrame) -> None:
    """Five tables: facts, article counts, and the dictionaries of terms, sources and days."""
    for name, df in (("facts", counts), ("articles", articles), ("dictionary", terms), ("sources", sources), ("dates", days)):
        df.write.mode("overwrite").csv(f"{path}/{name}", sep="\t")


def write_triples(triples: DataFrame, path: str) -> None:
    """Lines of N-Triples in one folder a day."""
    triples.write.mode("overwrite").partitionBy("day").text(path)


def write_panel(panel: DataFrame, path: str, *by: str) -> None:
    """Parquet by region and day (or as given), so that a range of days reads only its folders."""
    keys = by or ("region", "day")
    panel.repartition(*keys).write.mode("overwrite").partitionBy(*keys).option("compression", "zstd").parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """One more block of run, fold, epoch, metric, value rows."""
    metrics.write.mode("append").parquet(path)


def wide_errors(table: DataFrame) -> DataFrame:
    """The table of errors with one column a region, as reports show it."""
    return table.groupBy("task").pivot("region").agg(F.first("model"))


def write_sparse(panel: DataFrame, path: str, users: int) -> None:
    """(row, col, x) with row = day x users + user: the flat form of a day x user x word panel."""
    panel.select(flat_row(F.col("day"), F.col("user"), users).alias("row"), F.col("word").alias("col"), "x").write.mode("overwrite").parquet(path)


def flat_row(day: Column, user: Column, users: int) -> Column:
    return day.cast("long") * users + user


def unflat_row(row: Column, users: int) -> tuple[Column, Column]:
    """(day, user) of a flat row."""
    return F.floor(row / F.lit(users)).cast("int"), F.pmod(row, F.lit(users))


def copy_through(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder as it is, to another place; what was there is replaced."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def wordle(weights: DataFrame) -> DataFrame:
    """(region, task, value): 'word: score' lines of the words with a positive score, as word clouds take them."""
    return weights.where("score > 0").select("region", "task", F.format_string("%s: %.4f", "word", "score").alias("value"))
