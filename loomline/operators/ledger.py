"""Reconciling clusters with established keys, lane by lane: mint, keep, reactivate, split, propose, retract; and the events of that.

Clusters have (lane, cluster, scheme, code, bridges), members (lane, key, code). Without a lane, all are of the lane product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import codes, registry
from loomline.functions.codes import bridge_grade
from loomline.session import stored
from loomline.sources import log

LANES = ("product", "substance", "description", "media")
#: The order in which a reconciliation's events are told.
PHASES = ("minted", "reactivated", "split", "split_into", "merge_proposed", "identity_conflict", "identity_swap", "retracted", "members_changed")


def in_lane(df: DataFrame) -> DataFrame:
    return df if "lane" in df.columns else df.withColumn("lane", F.lit("product"))


def key_number(key: Column) -> Column:
    return F.regexp_extract(key, "_([0-9]+)$", 1).try_cast("bigint")


def key_prefix(lane: Column) -> Column:
    return F.coalesce(*[F.when(lane == k, F.lit(v)) for k, v in codes.KEY_PREFIX.items()])


def per_lane(members: DataFrame) -> DataFrame:
    """members(key, code) with the lane that each key's prefix names; a key of no known prefix is a product's."""
    return members.withColumn("lane", F.coalesce(codes.key_lane(F.col("key")), F.lit("product")))


def held_codes(clusters: DataFrame) -> DataFrame:
    """code, clusters (and lane, where given): codes that more than one cluster carries."""
    keys = ["lane", "code"] if "lane" in clusters.columns else ["code"]
    return clusters.groupBy(*keys).agg(F.countDistinct("cluster").alias("clusters")).where("clusters > 1")


def candidates(clusters: DataFrame, members: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """lane, cluster, least, keys: each cluster's least code, and the established keys that share a bridging code with it or that
    ``preferred`` (lane, cluster, key) binds to it. Held codes bridge nothing."""
    clusters, members = in_lane(clusters), in_lane(members)
    bridging = clusters.where("bridges").join(held_codes(clusters).select("lane", "code"), ["lane", "code"], "left_anti")
    met = bridging.join(members, ["lane", "code"]).select("lane", "cluster", "key")
    if preferred is not None:
        met = met.unionByName(in_lane(preferred).select("lane", F.col("cluster").cast(dict(clusters.dtypes)["cluster"]), "key"))
    keys = met.groupBy("lane", "cluster").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    least = clusters.groupBy("lane", "cluster").agg(F.min(registry.code_order(F.col("code"))).alias("least"))
    return least.join(keys, ["lane", "cluster"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def keeper(clusters: DataFrame, members: DataFrame, assigned: DataFrame) -> DataFrame:
    """Add place to assigned(lane, cluster, key): 1 keeps the key. More national codes kept come first, then more codes that are neither
    national nor barcodes, more codes, more national codes of its own, and the least codes in order."""
    clusters, members, assigned = in_lane(clusters), in_lane(members), in_lane(assigned)
    prior = members.select("lane", "key", "code").withColumn("kept", F.lit(True))
    grade = bridge_grade(F.col("scheme"))
    counted = (
        assigned.join(clusters, ["lane", "cluster"])
        .join(prior, ["lane", "key", "code"], "left")
        .groupBy("lane", "cluster", "key")
        .agg(
            F.count_if(F.col("kept") & (grade == "national")).alias("national"),
            F.count_if(F.col("kept") & (grade == "none")).alias("other"),
            F.count_if(F.col("kept")).alias("overlap"),
            F.count_if(grade == "national").alias("own"),
            F.array_sort(F.collect_set(registry.code_order(F.col("code")))).alias("codes"),
        )
    )
    by = W.partitionBy("lane", "key").orderBy(F.desc("national"), F.desc("other"), F.desc("overlap"), F.desc("own"), F.asc("codes"), F.asc("cluster"))
    return counted.withColumn("place", F.row_number().over(by))


def _numbered(rows: DataFrame, order: list[str], starts: DataFrame) -> DataFrame:
    """Add ``new``, the next key of each row's lane in ``order``, from starts(lane, start). Rows are numbered in parallel; the first number
    of each lane (four at most) is joined back."""
    dealt = log.numbered(rows, ["lane", *order], column="n")
    first = dealt.groupBy("lane").agg(F.min("n").alias("first"))
    return dealt.join(F.broadcast(first), "lane").join(F.broadcast(starts), "lane").withColumn("new", F.concat_ws("_", key_prefix(F.col("lane")), F.col("n") - F.col("first") + F.col("start"))).drop("n", "first", "start")


def next_keys(members: DataFrame) -> DataFrame:
    """lane, start: the number after the largest of each lane's keys."""
    lanes = members.sparkSession.createDataFrame([(x,) for x in LANES], "lane string")
    top = in_lane(members).groupBy("lane").agg(F.max(key_number(F.col("key"))).alias("top"))
    return lanes.join(top, "lane", "left").select("lane", (F.coalesce("top", F.lit(0)) + 1).alias("start"))


def decide(clusters: DataFrame, members: DataFrame, starts: DataFrame | None = None, preferred: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """lane, action, cluster, key, keys, code: what becomes of each cluster and each established key.

    mint: no key shares a bridging code; keep: one does, and among its clusters this one comes first; reactivate: the one that does is
    not established any more (only ``preferred`` names such); split: another cluster of that key, under a new key; propose: several do,
    so nothing is merged; held: clusters of several keys carry one code (``code``); retract: nothing touches the key. A lane without
    clusters says nothing of its keys, unless ``complete``: then the clusters are all there is, and its keys are retracted. Minted keys
    are numbered by their clusters' least code, split ones after them by key and codes, from starts(lane, start) on.
    """
    clusters, members = in_lane(clusters), in_lane(members)
    starts = stored(next_keys(members) if starts is None else starts)
    found = stored(candidates(clusters, members, preferred))
    none = F.array().cast("array<string>")
    minted = _numbered(found.where(F.size("keys") == 0), ["least", "cluster"], starts)
    row = lambda action, cluster, key, keys, code: ("lane", F.lit(action).alias("action"), cluster.alias("cluster"), key.alias("key"), keys.alias("keys"), code.cast("string").alias("code"))
    c, null, gone = F.col, F.lit(None), F.lit(None).cast(dict(clusters.dtypes)["cluster"])
    mints = minted.select(*row("mint", c("cluster"), c("new"), none, null))
    placed = stored(keeper(clusters, members, found.where(F.size("keys") == 1).select("lane", "cluster", c("keys")[0].alias("key"))))
    taken = minted.groupBy("lane").agg(F.count("*").alias("minted"))
    after = starts.join(taken, "lane", "left").select("lane", (c("start") + F.coalesce("minted", F.lit(0))).alias("start"))
    new = _numbered(placed.where("place > 1").select("lane", "cluster", "key", "codes"), ["key", "codes", "cluster"], after)
    splits = new.select(*row("split", c("cluster"), c("new"), F.array("key"), null))
    established = members.select("lane", "key").distinct().withColumn("old", F.lit(True))
    first = placed.where("place = 1").join(established, ["lane", "key"], "left")
    keeps = first.where("old").select(*row("keep", c("cluster"), c("key"), F.array("key"), null)).union(first.where("old IS NULL").select(*row("reactivate", c("cluster"), c("key"), F.array("key"), null)))
    many = found.where(F.size("keys") > 1).select(*row("propose", c("cluster"), null.cast("string"), c("keys"), null))
    named = stored(mints.union(keeps).union(splits))
    held = clusters.where("bridges").join(held_codes(clusters).select("lane", "code"), ["lane", "code"])
    across = named.select("lane", "cluster", "key").join(held.select("lane", "cluster", c("code").alias("held")), ["lane", "cluster"]).groupBy("lane", "held").agg(F.array_sort(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    across = across.groupBy("lane", "keys").agg(F.min("held").alias("held")).select(*row("held", gone, null.cast("string"), c("keys"), c("held")))
    proposed = many.union(across)
    touched = keeps.select("lane", "key").union(placed.select("lane", "key")).union(proposed.select("lane", F.explode("keys"))).distinct()
    left = members.select("lane", "key").distinct().join(touched, ["lane", "key"], "left_anti")
    if not complete:
        left = left.join(clusters.select("lane").distinct(), "lane", "left_semi")
    retracts = left.select(*row("retract", gone, c("key"), F.array("key"), null))
    return stored(named.union(proposed).union(retracts))


def reconcile(clusters: DataFrame, members: DataFrame, following: int = 1) -> DataFrame:
    """cluster, action, key, keys of decide() in one lane, whose new keys are numbered from ``following``; held proposals are proposals."""
    starts = clusters.sparkSession.createDataFrame([(x, following) for x in LANES], "lane string, start bigint")
    found = decide(clusters, members, starts, complete=True)
    return found.select("cluster", "action", "key", "keys")


def members_after(clusters: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """lane, key, code once the decisions are taken: assigned keys have their cluster's codes, retracted ones are gone, others as before."""
    clusters, members = in_lane(clusters), in_lane(members)
    own = decisions.where("action IN ('mint', 'keep', 'reactivate', 'split')").select("lane", "cluster", "key")
    assigned = clusters.join(own, ["lane", "cluster"]).select("lane", "key", "code").distinct()
    touched = own.select("lane", "key").union(decisions.where("action = 'retract'").select("lane", "key"))
    return assigned.union(members.join(touched, ["lane", "key"], "left_anti").select("lane", "key", "code"))


def national_swaps(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, code: national codes that a surviving key lost, from (key, scheme, code)."""
    lost = before.where(bridge_grade(F.col("scheme")) == "national").join(after.select("key", "code"), ["key", "code"], "left_anti")
    return lost.join(after.select("key").distinct(), "key", "left_semi").select("key", "code")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """lane, key of those that both have, with other codes. Codes are compared row by row, so no key's codes are gathered."""
    sides = in_lane(before).select("lane", "key", "code", F.lit(1).alias("side")).union(in_lane(after).select("lane", "key", "code", F.lit(2).alias("side")))
    rows = sides.distinct().groupBy("lane", "key", "code").agg(F.sum("side").alias("sides"))
    return rows.groupBy("lane", "key").agg(F.bit_or("sides").alias("seen"), F.count_if(F.col("sides") < 3).alias("differ")).where("seen = 3 AND differ > 0").select("lane", "key")


def events(clusters: DataFrame, members: DataFrame, decisions: DataFrame, following: int = 0) -> DataFrame:
    """order, lane, type, key, keys, codes, into, subject of a reconciliation, gapless from ``following`` on: lane by lane, and in each by
    PHASES. ``codes`` are the key's after it (those it had, if it is retracted); a split tells the new keys in ``into``."""
    clusters, members = in_lane(clusters), in_lane(members)
    after = stored(members_after(clusters, members, decisions))
    listed = lambda df, keys: df.groupBy(*keys).agg(F.array_sort(F.collect_set(registry.code_order(F.col("code")))).alias("o")).select(*keys, F.transform("o", lambda x: x["code"]).alias("codes"))
    now, then, whole = listed(after, ["lane", "key"]), listed(members, ["lane", "key"]), listed(clusters, ["lane", "cluster"])
    c, no_keys, no_text = F.col, F.array().cast("array<string>"), F.lit(None).cast("string")
    row = lambda kind, key, keys, own, into, subject: ("lane", F.lit(PHASES.index(kind)).alias("phase"), F.lit(kind).alias("type"), key.alias("key"), keys.alias("keys"), own.alias("codes"), into.alias("into"), subject.cast("string").alias("subject"))
    act = lambda *names: decisions.where(c("action").isin(*names))
    minted = act("mint").join(now, ["lane", "key"]).select(*row("minted", c("key"), no_keys, c("codes"), no_keys, no_text))
    again = act("reactivate").join(now, ["lane", "key"]).select(*row("reactivated", c("key"), no_keys, c("codes"), no_keys, no_text))
    parted = act("split").groupBy("lane", F.get("keys", F.lit(0)).alias("from")).agg(F.array_sort(F.collect_list(F.struct(key_number(c("key")).alias("n"), c("key").alias("key")))).alias("i"))
    parted = parted.select("lane", c("from").alias("key"), F.transform("i", lambda x: x["key"]).alias("new"))
    split = parted.join(now, ["lane", "key"]).select(*row("split", c("key"), no_keys, c("codes"), c("new"), no_text))
    part = parted.select("lane", F.explode("new").alias("key")).join(now, ["lane", "key"]).select(*row("split_into", c("key"), no_keys, c("codes"), no_keys, no_text))
    proposed = act("propose").join(whole, ["lane", "cluster"]).select("lane", "keys", "codes")
    carriers = act("held").select("lane", "keys", c("code").alias("h")).join(clusters.select("lane", "cluster", c("code").alias("h")), ["lane", "h"]).join(clusters.select("lane", "cluster", "code"), ["lane", "cluster"])
    held = listed(carriers, ["lane", "keys"])
    flagged = proposed.union(held).select(*row("merge_proposed", no_text, c("keys"), c("codes"), no_keys, F.concat(F.lit("merge:"), F.array_join("keys", "+"))))
    conflict = held_codes(clusters.where("bridges")).select(*row("identity_conflict", no_text, no_keys, F.array("code"), no_keys, F.concat(F.lit("code:"), "code")))
    graded = lambda df: df.withColumn("scheme", registry.scheme_of(c("code")))
    lost = national_swaps(graded(members), graded(after)).groupBy("key").agg(F.array_sort(F.collect_set("code")).alias("lost"))
    swap = per_lane(lost).select(*row("identity_swap", c("key"), no_keys, c("lost"), no_keys, F.concat(F.lit("swap:"), "key")))
    retracted = act("retract").select("lane", "key").join(then, ["lane", "key"]).select(*row("retracted", c("key"), no_keys, c("codes"), no_keys, no_text))
    told = parted.select("lane", "key").union(parted.select("lane", F.explode("new"))).union(act("mint", "reactivate").select("lane", "key"))
    moved = changed(members, after).join(told, ["lane", "key"], "left_anti").join(now, ["lane", "key"]).select(*row("members_changed", c("key"), no_keys, c("codes"), no_keys, no_text))
    rows = minted
    for more in (again, split, part, flagged, conflict, swap, retracted, moved):
        rows = rows.union(more)
    lane_no = F.coalesce(*[F.when(c("lane") == x, F.lit(k)) for k, x in enumerate(LANES)])
    order = ["lane_no", "phase", "number", "key", "subject"]
    return log.numbered(rows.withColumns({"lane_no": lane_no, "number": F.coalesce(key_number(c("key")), F.lit(0))}), order, following, "order").drop("lane_no", "phase", "number")


def fold(told: DataFrame) -> DataFrame:
    """lane, key, code after events(order, lane, type, key, codes): the last event of each key counts. Minted, reactivated, changed and
    split keys have the codes they tell, merged and retracted ones none."""
    own = told.where("key IS NOT NULL AND type <> 'identity_swap'").groupBy("lane", "key").agg(F.max_by(F.struct("type", "codes"), "order").alias("e"))
    return own.where("e.type NOT IN ('retracted', 'merged')").select("lane", "key", F.explode("e.codes").alias("code"))


def redirects(merges: DataFrame) -> DataFrame:
    """key, survivor: the end of each chain of merges(key, into), by pointer jumping in a logarithmic number of rounds."""
    ends = stored(merges.select("key", F.col("into").alias("survivor")))
    while True:
        jump = ends.select(F.col("key").alias("survivor"), F.col("survivor").alias("far"))
        new = stored(ends.join(jump, "survivor", "left").select("key", F.coalesce("far", "survivor").alias("survivor"), F.col("far").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("key", "survivor")
        ends = new.select("key", "survivor")


def ancestors(merges: DataFrame) -> DataFrame:
    """survivor, key, number of merged keys behind each survivor: from merges(key, into)."""
    return redirects(merges).groupBy("survivor").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.countDistinct("key").alias("ancestors"))
