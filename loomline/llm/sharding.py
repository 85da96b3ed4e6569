"""Extendible hashing: a directory of hash-prefix bits; only buckets over the byte limit split on another bit.

Only DataFrame functions: no Python on the executors. A row moves once, without its text: sizes are summed by prefix first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, materialize

#: Bytes of a shard at most.
LIMIT_BYTES = 1 << 20
#: Bits of a hash, and bits that one round looks at.
BITS, STEP = 48, 8


def _hash(id_col: str, text_col: str) -> F.Column:
    """The first 48 bits, as 0 and 1, of the MD5 of id and text: rows that repeat an id, or have none, are spread by their texts."""
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.lpad(F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 2), BITS, "0")


def _bytes(text_col: str) -> F.Column:
    return F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint")


def directory(rows: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """shard (prefix bits; '' is the whole), shard_bytes, shard_docs from (__hash, __bytes): the shortest prefixes whose rows fit the limit.
    Only equal rows have one hash: their shard has all bits and may exceed the limit."""
    rounds = []
    over = rows.select("__hash", "__bytes")
    for depth in range(0, BITS, STEP):
        last = depth + STEP >= BITS
        cells = over.groupBy(F.substring("__hash", 1, depth + STEP).alias("cell")).agg(F.sum("__bytes").alias("b"), F.count("*").alias("n"))
        levels = F.sequence(F.lit(depth if not depth else depth + 1), F.lit(depth + STEP))
        sums = cells.select(F.explode(levels).alias("d"), "cell", "b", "n").select(F.expr("substring(cell, 1, d)").alias("shard"), "d", "b", "n")
        sums = materialize(sums.groupBy("shard", "d").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")))
        parent = sums.where(F.col("shard_bytes") > limit_bytes).select(F.col("shard").alias("up"))
        fits = sums.where((F.col("shard_bytes") <= limit_bytes) | (F.lit(last) & (F.col("d") == BITS)))
        top = fits.where(F.col("d") == (depth + 1 if depth else 0))
        below = fits.where(F.col("d") > (depth + 1 if depth else 0)).join(parent, F.expr("substring(shard, 1, d - 1)") == F.col("up"), "left_semi")
        rounds.append(top.union(below).select("shard", "shard_bytes", "shard_docs"))
        large = sums.where((F.col("d") == depth + STEP) & (F.col("shard_bytes") > limit_bytes)).select(F.col("shard").alias("up"))
        if last or large.isEmpty():
            break
        over = materialize(over.join(large, F.substring("__hash", 1, depth + STEP) == F.col("up"), "left_semi"))
    found = rounds[0]
    for r in rounds[1:]:
        found = found.union(r)
    return materialize(found)


def assign(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Join each row to its shard: on the prefix, once for each depth in use (a few lengths, told by the directory)."""
    depths = sorted(r[0] for r in shards.select(F.length("shard")).distinct().collect())  # BITS + 1 values at most
    prefixes = F.array(*[F.substring("__hash", 1, d) if d else F.lit("") for d in depths]) if depths else F.array(F.lit(""))
    return rows.withColumn("__prefix", F.explode(prefixes)).join(shards, F.col("__prefix") == F.col("shard")).drop("__prefix")


def shard(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, shard_docs for each row.

    Null and empty texts have 0 bytes; equal rows share a shard, rows that only repeat an id or have none need not; a text over the
    limit ends in a shard of its own, or of its copies. Other columns, whatever their names, are left out. An empty table gives none.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), _hash(id_col, text_col).alias("__hash"), _bytes(text_col).alias("__bytes")))
    found = assign(rows, directory(rows, limit_bytes))
    return found.select(F.col("id").alias(id_col), F.col("__bytes").alias("n_bytes"), "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs")


def write(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write ``docs`` with all columns as Parquet, in a folder for each shard, and return the folders' column: ``shard``, with as many
    underscores as make it none of the table's. Its values are the prefix bits after a b. An empty table writes no folder."""
    name = "shard"
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    rows = docs.select(F.struct(*columns_of(docs)).alias("__doc"), _hash(id_col, text_col).alias("__hash"), _bytes(text_col).alias("__bytes"))
    placed = assign(rows, directory(materialize(rows.select("__hash", "__bytes")), limit_bytes))
    named = placed.select(F.concat(F.lit("b"), "shard").alias("__shard"), "__doc").repartition("__shard")
    named.select("__doc.*", F.col("__shard").alias(name)).write.partitionBy(name).parquet(path)
    return name


ORACLE_SQL = f"""
WITH RECURSIVE h AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
  lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT), 48, '0') AS bits FROM documents),
p AS (SELECT r, doc_id, n_bytes, bits, unnest(range(0, 49)) AS d FROM h),
s AS (SELECT substr(bits, 1, d::INT) AS shard, d, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM p GROUP BY ALL),
f AS (SELECT h.doc_id, h.n_bytes, s.*, row_number() OVER (PARTITION BY h.r ORDER BY s.d) AS k FROM p h JOIN s ON s.shard = substr(h.bits, 1, h.d::INT) AND s.d = h.d
  WHERE s.shard_bytes <= {LIMIT_BYTES} OR s.d = 48)
SELECT doc_id, n_bytes, shard, d::INT AS depth, shard_bytes, shard_docs FROM f WHERE k = 1"""
