"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_OWN: list[str] = []


def session(cores: str = "*") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a session that runs in this process (tests)
    has a folder of its own; on a cluster that would lose data, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="loomline-"))
        root = _OWN[0]
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a loop's lineage ends there."""
    path = f"{shared_root(df.sparkSession)}/loomline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as there are cores or shuffle partitions, however small its files are: for rows that take long each."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def folded(rows: DataFrame, key: str, fold: Callable[[Any, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fold(key, rows)`` of each group of ``rows``, which are tuples of its columns; it gives tuples of ``schema``. Groups follow each other
    in a task, one in memory at a time. The tasks are not joined however little they read: the work is in the fold."""
    at = rows.columns.index(key)
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    dealt = spread(rows, key).sortWithinPartitions(key)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[at] != now:
                    out += fold(now, held)
                    held = []
                now = row[at]
                held.append(row)
            yield batch(out)
        if held:
            yield batch(list(fold(now, held)))

    return dealt.mapInArrow(run, schema)
