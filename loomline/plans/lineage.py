"""Plan-level helpers: cutting lineage, keeping one row per key, dense ids, bounded samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_folder() -> str:
    """A folder of this process that goes with it; for sessions that run in one process only."""
    folder = tempfile.mkdtemp(prefix="loomline-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local session gets a
    folder of its own; a cluster's executors couldn't read that one, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or local_folder())


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def release(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` returned and that nothing reads any more."""
    held = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if held.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(held.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _in_few_files(df: DataFrame, limit: int) -> bool:
    """Whether a table is small and lies in fewer files than there are cores: one file of one row group is one task
    however many cores there are."""
    if df.isStreaming:
        return False
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= limit and 0 < len(df.inputFiles()) < df.sparkSession.sparkContext.defaultParallelism


def spread_small(df: DataFrame, limit: int = 1 << 30) -> DataFrame:
    """A small table that lies in fewer files than there are cores, over all cores; any other as it is.

    Only where the table is small does moving it cost less than that; large tables are never moved for this.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if _in_few_files(df, limit) else df


def once_per_key(df: DataFrame, key: str, limit: int = 1 << 30) -> DataFrame:
    """One row per non-null ``key``; which of several rows stays is not defined (they are redeliveries of one record).

    One scan and one shuffle of the selected columns; rows of one key are folded before the shuffle, so that a key that
    comes very often sends one row a task. A small table in few files is spread first and folded by all cores.
    """
    rows = df.where(F.col(key).isNotNull())
    if _in_few_files(rows, limit):
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)
    return rows.dropDuplicates([key])


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of ``key``: the same rows on every run, whatever the partitioning.

    The rows are thinned by hash before the last few are dropped, so that the tasks together hand on little more
    than ``n`` rows however many tasks there are.
    """
    total = df.count()
    if total > n:
        keep = min(1.0, (n + 4 * n**0.5 + 10) / total)
        df = df.where(F.shiftrightunsigned(F.xxhash64(key), 11) < F.lit(int(keep * 2**53)))
    return df.orderBy(F.xxhash64(key), key).limit(n)


def dense_ids(df: DataFrame, *order, start: int = 1, name: str = "id") -> DataFrame:
    """``df`` with ids ``start``, start + 1, ... in the given order, without gathering the rows in one task.

    Rows are range-partitioned and numbered within their partition; partitions start where the ones before end. Only
    one count for each partition goes to the driver. The order should be total, else ties get ids in no fixed order.
    """
    from itertools import accumulate

    from pyspark.sql.window import Window

    spread = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r._part: r["count"] for r in spread.groupBy("_part").count().collect()}
    parts = sorted(sizes)
    offsets = dict(zip(parts, accumulate([start] + [sizes[p] for p in parts[:-1]]), strict=True)) if parts else {}
    numbered = spread.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_part")) if offsets else F.lit(start)
    return numbered.withColumn(name, (F.col("_row") + offset).cast("int")).drop("_part", "_row")
