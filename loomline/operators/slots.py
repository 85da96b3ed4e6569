"""Slots: what a newer claim supersedes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def current(claims: DataFrame, slot: list[str], order: list[Column]) -> DataFrame:
    """The last claim of each slot. ``order`` must be total in a slot. Aggregated in each task before the shuffle."""
    rest = [c for c in claims.columns if c not in slot]
    return claims.groupBy(*slot).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("c")).select(*slot, "c.*")


def winnowed(batch: DataFrame, stored: DataFrame, slot: list[str], content: str, order: list[Column]) -> DataFrame:
    """The claims of a batch that change their slot: repeats of one (slot, content) count once, at their first place, and then a claim
    equal to the one before it, or to the stored one, is dropped."""
    first = batch.groupBy(*slot, content).agg(F.min(F.struct(*order)).alias("at"))
    seeded = first.join(stored.select(*slot, F.col(content).alias("stored")), slot, "left")
    before = F.lag(content).over(W.partitionBy(*slot).orderBy("at"))
    is_first = F.row_number().over(W.partitionBy(*slot).orderBy("at")) == 1
    return seeded.withColumn("before", F.when(is_first, F.col("stored")).otherwise(before)).where(~F.col(content).eqNullSafe(F.col("before"))).select(*slot, content, "at.*")
