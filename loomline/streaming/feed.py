"""Structured Streaming over the event log. No watermark anywhere: a late event is a correction and is never dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.session import shared_root
from loomline.sources import log


def follow(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """The table at ``path`` as a stream; the query's checkpoint is the reader's cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def slot_view(events: DataFrame, slot: list[str], order: list[str]) -> DataFrame:
    """The current claim of each slot, as a streaming aggregation: the state store holds one row a slot, JVM-side."""
    rest = [c for c in events.columns if c not in slot]
    best = events.groupBy(*slot).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("c"))
    return best.select(*slot, "c.*")


def first_seen(events: DataFrame, fingerprint: str) -> DataFrame:
    """Replays of an event that came before go."""
    return events.dropDuplicates([fingerprint])


def write_changes(view: DataFrame, path: str, checkpoint: str) -> None:
    """Write, batch by batch, the rows of a view that changed, and return when all that is there has been read. A retried batch replaces
    its own folder."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    view.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_to_log(events: DataFrame, path: str, checkpoint: str, order: list[str]) -> None:
    """Append a stream to the event log, each micro-batch a batch of the log: the one writer the log has."""

    def put(rows: DataFrame, number: int) -> None:
        log.append(rows.sparkSession, path, rows, number, order)

    events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(changes: DataFrame, slot: list[str], order: list[str]) -> DataFrame:
    """The view itself from its written changes. Batches are written in turn, so the last change of a slot stands."""
    rest = [c for c in changes.columns if c not in slot]
    return changes.groupBy(*slot).agg(F.max_by(F.struct(*rest), F.struct("batch", *order)).alias("c")).select(*slot, "c.*").drop("batch")


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_root(spark)}/loomline/{uuid.uuid4().hex}"
