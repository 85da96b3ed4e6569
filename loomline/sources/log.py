"""The event log: an append-only Parquet table whose rows carry a gapless offset, written by one job at a time.

A batch is the folder ``batch=<number>``. Spark's committer moves its files there when the job ends, and writing a batch again replaces
it with the same rows, so a retried batch cannot double. Numbers are dealt without sorting the batch into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import stored


def numbered(batch: DataFrame, order: list[str], following: int = 0, column: str = "offset") -> DataFrame:
    """Add gapless numbers from ``following`` on, in ``order``: rows are ranged over tasks by it, counted in each, and the counts summed
    (one row a task reaches the driver)."""
    spark = batch.sparkSession
    ranged = batch.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = stored(ranged.select("*", F.shiftright("_id", 33).alias("_task"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")).drop("_id"))
    starts, at = [], following
    for r in held.groupBy("_task").agg(F.count("*").alias("n")).orderBy("_task").collect():
        starts.append((r["_task"], at))
        at += r["n"]
    table = spark.createDataFrame(starts, "_task bigint, _start bigint")
    return held.join(F.broadcast(table), "_task").withColumn(column, F.col("_start") + F.col("_row")).drop("_task", "_row", "_start")


def next_offset(spark: SparkSession, path: str, before_batch: int) -> int:
    if before_batch == 0:
        return 0
    found = spark.read.parquet(path).where(F.col("batch") < before_batch).agg(F.max("offset")).first()[0]
    return 0 if found is None else found + 1


def append(spark: SparkSession, path: str, batch: DataFrame, number: int, order: list[str]) -> None:
    """Append ``batch`` as batch ``number``; batches are numbered from 0 and written in turn."""
    rows = numbered(batch, order, next_offset(spark, path, number))
    rows.repartitionByRange("offset").sortWithinPartitions("offset").write.mode("overwrite").parquet(f"{path}/batch={number}")


def unseen(batch: DataFrame, log: DataFrame, fingerprint: str) -> DataFrame:
    """Rows of a batch whose fingerprint the log does not hold, repeats within the batch once."""
    return batch.dropDuplicates([fingerprint]).join(log.select(fingerprint), fingerprint, "left_anti")


def since(log: DataFrame, offset: int, limit: int | None = None) -> DataFrame:
    """The log after ``offset``, in order; a page of it with ``limit``. Files hold ranges of offsets, so others are skipped."""
    rows = log.where(F.col("offset") > offset).orderBy("offset")
    return rows if limit is None else rows.limit(limit)
