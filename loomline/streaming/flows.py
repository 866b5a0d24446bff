"""Streaming faces of the operators: the same column functions on an unbounded input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import text as X
from loomline.operators import counts, records
from loomline.plans.lineage import ensure_checkpoint_dir


def table_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a folder's or file's Parquet rows."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path[:-1] + f"[{path[-1]}]")  # as a pattern, so that a single file will do as well as a folder


def work_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one, for a stream's state and results."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is available now, through the stream's own engine, as a table; in update and complete modes the last
    value of each batch's rows is kept by the batch number in ``_batch``."""
    spark = stream.sparkSession
    folder = work_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that comes again after a failure replaces itself.
        batch.write.mode("overwrite").parquet(f"{folder}/rows/_batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(f"{folder}/rows")
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return spark.createDataFrame([], schema)
        raise


def retweet_filter(stream: DataFrame) -> DataFrame:
    return records.drop_retweets(stream).select("ord")


def first_by_key(stream: DataFrame, delay: str = "10 days", time_col: str = "seen_at") -> DataFrame:
    """(key, ...) one message for each key within the delay; state older than the watermark is dropped."""
    rows = records.drop_retweets(stream).where("analysis.tokens.unprotected is not null").withColumn("key", X.dedup_key(F.col("analysis.tokens.unprotected")))
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["key"]).select("key")


def word_counts(stream: DataFrame) -> DataFrame:
    """(word, cnt) document frequencies, for complete or update mode."""
    rows = stream.where("analysis.tokens.all is not null")
    return counts.document_frequency(rows, counts.distinct_words(F.col("analysis.tokens.all")))


def windowed_counts(stream: DataFrame, time_col: str, key: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, key, n): tumbling windows of event time with late rows up to the delay. Beyond the batch operators."""
    w = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).groupBy(F.window(time_col, window), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), key, "n")


class IncrementalLearner:
    """Keeps all (x, y) batches in a table and refits on what has come so far; ``fit`` gets the whole table.

    For ``foreachBatch``: a batch that comes again (after a failure) replaces itself.
    """

    def __init__(self, spark: SparkSession, fit: Callable[[DataFrame], object], folder: str | None = None):
        self.spark, self.fit, self.folder, self.model, self.seen = spark, fit, folder or work_folder(spark), None, 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        self.seen += 1
        self.model = self.fit(self.spark.read.parquet(self.folder))
