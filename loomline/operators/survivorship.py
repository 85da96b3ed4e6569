"""Survivorship: which source's value stands, or is it undecidable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rank of a source that no tier names: after every tier, and equal to its like.
UNRANKED = 2147483647


def ranked(entries: DataFrame, priority: DataFrame, dimension: str = "field") -> DataFrame:
    """Add rank from priority(dimension, source, rank). A dimension that has tiers never falls back to '*'; others use it."""
    own = priority.select(F.col("dimension").alias(dimension)).distinct().withColumn("__has", F.lit(True))
    keyed = entries.join(own, dimension, "left").withColumn("__dim", F.when(F.col("__has"), F.col(dimension)).otherwise(F.lit("*")))
    tiers = priority.select(F.col("dimension").alias("__dim"), F.col("source"), "rank")
    return keyed.join(tiers, ["__dim", "source"], "left").withColumn("rank", F.coalesce("rank", F.lit(UNRANKED))).drop("__dim", "__has")


def latest_per_source(claims: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return claims.groupBy(*keys, "source").agg(F.max_by(F.struct("value", *[c for c in claims.columns if c == "rank"]), F.struct(*order, F.col("value"))).alias("c")).select(*keys, "source", "c.*")


def decide(entries: DataFrame, keys: list[str]) -> DataFrame:
    """value, winner, status, candidates from (keys, source, value, rank), one row a source. Sources of the best rank that differ leave
    the value open. Two aggregations on one partitioning; no window over a whole key."""
    ordered = entries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "source", "value"))).alias("c"))
    top = F.filter("c", lambda x: x["rank"] == F.col("c")[0]["rank"])
    tie = F.size(F.array_distinct(F.transform(top, lambda x: x["value"]))) > 1
    return ordered.select(
        *keys,
        F.when(~tie, F.col("c")[0]["value"]).alias("value"),
        F.when(~tie, F.col("c")[0]["source"]).alias("winner"),
        F.when(tie, "needs_review").otherwise("resolved").alias("status"),
        F.transform("c", lambda x: F.struct(x["source"].alias("source"), x["value"].alias("value"))).alias("candidates"),
    )


def score_rank(score: Column, tie: Column) -> Column:
    """Rank of a scored source: higher scores first, then the tie index."""
    return (-score * 1_000_000 + tie).cast("bigint")
