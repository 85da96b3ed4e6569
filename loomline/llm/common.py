"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session that runs in this process
    (tests) has a folder of its own; on a cluster that would lose data, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="loomline-"))
        found = _OWN[0]
    return found.rstrip("/")


def columns_of(df: DataFrame) -> list[F.Column]:
    """All columns of ``df``, whatever their names: a name with a dot is not a path."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost no second pass."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_column(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Up to so many row numbers (8 bytes each) are broadcast to the texts that they choose; beyond, the texts are shuffled to them.
BROADCAST_ROWS = 1 << 20


def chosen(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of wide ``rows`` that a table ``ids`` has (left_semi) or lacks (left_anti), by the column row."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "row", how)


def batch_of(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rows_of(batch: pa.RecordBatch, size: int = 256) -> Iterator[tuple]:
    """The rows of a batch; only ``size`` of them are Python objects at a time."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over batches of at most BATCH_BYTES, or one row. Spark's own limit lets a batch of whole texts hold a partition, once
    in the JVM's direct memory and once in the worker. Spark reads that limit from the session as it runs the plan, so the session keeps
    it; one that it has already stays."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker that is used again would hold it while other stages need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return
