"""Decisions that take two pairs of eyes, and cases whose evidence may have moved on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.codes import bridge_grade


def endorsed(votes: DataFrame, needed: int = 2) -> DataFrame:
    """subject, actors, approved: a subject is approved once ``needed`` different people have endorsed it. From votes(subject, actor);
    null actors and repeats of one person do not count."""
    return votes.groupBy("subject").agg(F.countDistinct("actor").alias("actors")).withColumn("approved", F.col("actors") >= needed)


def digest(*columns: Column) -> Column:
    """SHA-256 of the evidence; nulls and empty strings stay apart, and so do neighbouring columns."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])), 256)


def cases(opened: DataFrame, now: DataFrame) -> DataFrame:
    """subject, status: open while the evidence is what it was when the case was opened, stale if it changed, superseded if it is gone.
    From (subject, digest) then and now."""
    held = opened.join(now.withColumnRenamed("digest", "now"), "subject", "left")
    return held.select("subject", F.when(F.col("now").isNull(), "superseded").when(F.col("now") == F.col("digest"), "open").otherwise("stale").alias("status"))


def status(keys: DataFrame, merges: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """key, status (active, merged, withdrawn, unknown), canonical: from asked keys(key, minted), redirects(key, survivor), withdrawn(key)."""
    gone = withdrawn.select("key", F.lit(True).alias("gone"))
    found = keys.join(merges, "key", "left").join(gone, "key", "left")
    said = F.when(~F.col("minted"), "unknown").when(F.col("survivor").isNotNull(), "merged").when(F.col("gone"), "withdrawn").otherwise("active")
    return found.select("key", said.alias("status"), F.when(F.col("minted"), F.coalesce("survivor", "key")).alias("canonical"))


def approved_merges(proposals: DataFrame, votes: DataFrame, needed: int = 2) -> DataFrame:
    """subject, key, survivor for each key of the proposals(subject, key) that enough people endorsed; the least key, as text, survives."""
    approved = endorsed(votes, needed).where("approved").select("subject")
    keys = proposals.select("subject", "key").distinct().join(approved, "subject", "left_semi")
    return keys.join(keys.groupBy("subject").agg(F.min("key").alias("survivor")), "subject")


def members_after(members: DataFrame, merges: DataFrame) -> DataFrame:
    """members(key, scheme, code) once each merged key's codes are its survivor's; a code of several merged keys is one row."""
    to = merges.select("key", "survivor").distinct()
    return members.join(to, "key", "left").select(F.coalesce("survivor", "key").alias("key"), "scheme", "code").distinct()


def same_evidence(members: DataFrame, merges: DataFrame) -> DataFrame:
    """subject, scheme, key, code: the classes of national codes that an approved merge declares the same. Two codes of a class with
    different keys are a pair of standing evidence; the pairs are not spelled out, as their number grows with the square. Schemes of
    which the merged keys hold one code only, or which one key alone holds, need none."""
    rows = members.where(bridge_grade(F.col("scheme")) == "national").join(merges.select("subject", "key"), "key").distinct()
    classes = rows.groupBy("subject", "scheme").agg(F.countDistinct("key").alias("k"), F.countDistinct("code").alias("c")).where("k > 1 AND c > 1")
    return rows.join(classes, ["subject", "scheme"], "left_semi").select("subject", "scheme", "key", "code")
