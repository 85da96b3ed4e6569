"""Reads over projected tables: records by legacy id, by code and by key, what a key is now, and the change feed as it is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import codes, registry
from loomline.operators import ledger, legacy

PAGE, MAX_PAGE = 500, 1000
#: Types of identity events that the plain change feed tells; the whole feed tells all.
FEED = ("minted", "members_changed", "reactivated", "merged", "split", "split_into")


def by_legacy(ids: DataFrame, assigned: DataFrame, merges: DataFrame, variants: DataFrame) -> DataFrame:
    """legacy_id, key, merged_from and the variant of each asked id that answers to a record today."""
    return legacy.lands_on(ids, assigned, merges).join(variants, "key").select("legacy_id", "key", "merged_from", *[c for c in variants.columns if c != "key"])


def by_code(asked: DataFrame, members: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """code, key (and the variant) for asked(scheme, value) in any spelling; a held or shared code has several keys. ``members`` filtered
    by code reaches the files where they are sorted by it."""
    wanted = asked.select(registry.code_of(F.col("scheme"), F.col("value")).alias("code")).distinct()
    found = members.where("lane = 'product'").join(wanted, "code").select("code", "key").distinct()
    return found if variants is None else found.join(variants, "key")


def resolve_keys(asked: DataFrame, members: DataFrame) -> DataFrame:
    """scheme, value, key: the key that each code resolves to, the least where several hold it; null where none does."""
    wanted = asked.withColumn("code", registry.code_of(F.col("scheme"), F.col("value")))
    owner = members.groupBy("code").agg(F.min("key").alias("key"))
    return wanted.join(owner, "code", "left").select("scheme", "value", "key")


def statuses(asked: DataFrame, told: DataFrame, members: DataFrame, merges: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """key, status, canonical: active, merged (canonical is the survivor), withdrawn (all its records are, withdrawn(key)), retired, or
    unknown, for each asked key."""
    keys = asked.select("key").distinct()
    live = members.select("key").distinct().withColumn("live", F.lit(True))
    ever = told.where("key IS NOT NULL").select("key").distinct().withColumn("ever", F.lit(True))
    found = keys.join(live, "key", "left").join(ledger.redirects(merges), "key", "left").join(ever, "key", "left")
    gone = F.lit(False)
    if withdrawn is not None:
        found = found.join(withdrawn.select("key").distinct().withColumn("gone", F.lit(True)), "key", "left")
        gone = F.coalesce("gone", F.lit(False))
    status = F.when(F.col("survivor").isNotNull(), "merged").when(F.col("live"), "active").when(gone, "withdrawn").when(F.col("ever"), "retired").otherwise("unknown")
    return found.select("key", status.alias("status"), F.when(status != "unknown", F.coalesce("survivor", "key")).alias("canonical"))


def lineage_status(asked: DataFrame, told: DataFrame, merges: DataFrame) -> DataFrame:
    """key, status, superseded_by, split_into from the log alone: merged into the end of its chain, split if it ever was, or active."""
    parts = told.where("type = 'split'").groupBy("key").agg(F.min_by("into", "order").alias("parts"))
    found = asked.select("key").join(ledger.redirects(merges), "key", "left").join(parts, "key", "left")
    status = F.when(F.col("survivor").isNotNull(), "merged").when(F.col("parts").isNotNull(), "split").otherwise("active")
    return found.select("key", status.alias("status"), F.col("survivor").alias("superseded_by"), F.when(status == "split", F.concat(F.array("key"), "parts")).alias("split_into"))


def lineage(told: DataFrame, key: str) -> DataFrame:
    """The events that concern a key, in order: its own, and merges, splits and proposals that name it."""
    return told.where((F.col("key") == key) | F.array_contains("keys", key) | F.array_contains("into", key)).orderBy("order")


def identity(asked: DataFrame, members: DataFrame, merges: DataFrame, assigned: DataFrame) -> DataFrame:
    """key, canonical, codes, legacy_ids of each asked key: with the ids of the keys that were merged into it, directly or not."""
    ends = ledger.redirects(merges)
    found = asked.select("key").join(ends, "key", "left").withColumn("canonical", F.coalesce("survivor", "key")).drop("survivor")
    held = members.groupBy(F.col("key").alias("canonical")).agg(F.array_sort(F.collect_set(registry.code_order(F.col("code")))).alias("c"))
    behind = ends.select(F.col("survivor").alias("canonical"), F.col("key").alias("held")).union(assigned.select(F.col("key").alias("canonical"), F.col("key").alias("held"))).distinct()
    ids = behind.join(assigned.select(F.col("key").alias("held"), "legacy_id"), "held").groupBy("canonical").agg(F.array_sort(F.collect_set("legacy_id")).alias("legacy_ids"))
    return found.join(held, "canonical", "left").join(ids, "canonical", "left").select("key", "canonical", F.transform("c", lambda x: x["code"]).alias("codes"), "legacy_ids")


def page(told: DataFrame, offset: int, limit: int = PAGE, feed_only: bool = False) -> DataFrame:
    """Events after ``offset``, in order, MAX_PAGE at most; the top of them is taken in each task before one is sorted."""
    rows = told.where(F.col("order") > offset)
    rows = rows.where(F.col("type").isin(*FEED)) if feed_only else rows
    return rows.orderBy("order").limit(max(0, min(limit, MAX_PAGE)))


# How things are written on the wire.
def code_text(code: Column) -> Column:
    return F.concat_ws(":", code["scheme"], code["value"])


def json_value(value: Column) -> Column:
    """A tagged value as JSON: strings quoted, numbers, booleans and lists as they are, null as null."""
    quoted = F.to_json(F.array(value["s"]))
    return F.when(value["t"] == "s", F.regexp_replace(quoted, r"^\[|\]$", "")).when(value["t"] == "n", "null").otherwise(value["s"])


def attribute_view(decided: DataFrame) -> DataFrame:
    """key, view: each decision as one JSON object."""
    options = F.transform("candidates", lambda x: F.concat(F.lit('{"source":'), F.regexp_replace(F.to_json(F.array(x["source"].cast("string"))), r"^\[|\]$", ""), F.lit(',"value":'), json_value(x["value"]), F.lit("}")))
    text = lambda c: F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "")
    parts = [F.lit('{"field":'), text(F.col("field")), F.lit(',"value":'), F.coalesce(json_value(F.col("value")), F.lit("null")), F.lit(',"winner":'), F.coalesce(text(F.col("winner")), F.lit("null")), F.lit(',"status":'), text(F.col("status")), F.lit(',"candidates":['), F.array_join(options, ","), F.lit("]}")]
    return decided.select("key", F.concat(*parts).alias("view"))


def feed_view(told: DataFrame) -> DataFrame:
    """order, view: identity events as JSON objects, with the parts that their type has and no others."""
    c = F.col
    keys, own, into = F.when(F.size("keys") > 0, c("keys")), F.when(c("type").isin("minted", "members_changed", "reactivated", "retracted", "split_into"), c("codes")), F.when(F.size("into") > 0, c("into"))
    return told.select("order", F.to_json(F.struct(c("order").alias("offset"), "type", "key", keys.alias("keys"), own.alias("codes"), into.alias("into"), "subject")).alias("view"))


def withdrawn_keys(revisions: DataFrame, bindings: DataFrame, merges: DataFrame) -> DataFrame:
    """key: those whose bound records, after their last revisions(source, ref, active, order), are withdrawn; followed through merges."""
    last = revisions.groupBy("source", "ref").agg(F.max_by("active", "order").alias("active")).where("NOT active")
    bound = bindings.groupBy("source", "ref").agg(F.max_by("key", "order").alias("key"))
    return last.join(bound, ["source", "ref"]).join(ledger.redirects(merges), "key", "left").select(F.coalesce("survivor", "key").alias("key")).distinct()


def code_lane(code: Column) -> Column:
    return codes.lane(registry.scheme_of(code))
