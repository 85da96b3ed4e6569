"""The batch fold: histories to claims, clusters, keys and golden records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import codes, registry
from loomline.operators import catalog, cluster, ledger, mapping
from loomline.session import stored
from loomline.sources import log

MEMBERS = "lane string, key string, code string"


@dataclass(frozen=True)
class Rederivation:
    """What a fold of claims comes to: its live claims, clusters, what became of keys, their members, and the identity events."""

    claims: DataFrame
    live: DataFrame
    clusters: DataFrame
    decisions: DataFrame
    members: DataFrame
    before: DataFrame

    def events(self, following: int = 0) -> DataFrame:
        return ledger.events(self.clusters, self.before, self.decisions, following)


def empty_members(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], MEMBERS)


def listings(live: DataFrame) -> DataFrame:
    """lane, listing, code of the identity claims that hold codes; a claim whose codes are of several lanes belongs to none."""
    held = live.where("kind = 'identity'").where(F.size("codes") > 0)
    lane = registry.lane_of_codes(F.col("codes"), F.col("entity"))
    return held.select(lane.alias("lane"), F.col("slot").alias("listing"), F.explode("codes").alias("code")).where("lane IS NOT NULL")


def clusters_of(live: DataFrame, shared: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """lane, cluster, scheme, code, bridges: guarded clusters of live identity claims, lane by lane. Codes that are shared by nature, or
    that ``shared`` (code) declares, never bridge. ``evidence`` (code, to, relation same or distinct) is a steward's."""
    named = listings(live).withColumns({"scheme": registry.scheme_of(F.col("code")), "value": registry.value_of(F.col("code"))})
    never = named.where(codes.never_bridges(F.struct("scheme", "value"))).select("scheme", "value")
    if shared is not None:
        never = never.union(shared.select(registry.scheme_of(F.col("code")), registry.value_of(F.col("code"))))
    never = stored(never.distinct())
    pair = lambda which: None if evidence is None else evidence.where(F.col("relation") == which).select(registry.scheme_of(F.col("code")).alias("l_scheme"), registry.value_of(F.col("code")).alias("l_value"), registry.scheme_of(F.col("to")).alias("r_scheme"), registry.value_of(F.col("to")).alias("r_value"))
    found = cluster.guarded(named.select("lane", "listing", "scheme", "value"), never, pair("distinct"), pair("same"))
    flagged = found.join(never.withColumn("never", F.lit(True)), ["scheme", "value"], "left")
    return stored(flagged.select("lane", F.concat_ws("#", "component", "cluster").alias("cluster"), "scheme", F.concat_ws(":", "scheme", "value").alias("code"), F.col("never").isNull().alias("bridges")))


def rederive(claims: DataFrame, members: DataFrame | None = None, starts: DataFrame | None = None, shared: DataFrame | None = None, preferred: DataFrame | None = None, complete: bool = False) -> Rederivation:
    """Fold claims(mapping.CLAIM, order) onto established members, or onto none."""
    live = stored(mapping.live(claims))
    evidence = live.where("kind = 'identity_evidence' AND source = 'steward'").select("code", "to", "relation")
    clusters = clusters_of(live, shared, None if evidence.isEmpty() else evidence)
    before = empty_members(claims) if members is None else members
    decisions = ledger.decide(clusters, before, starts, preferred, complete)
    return Rederivation(claims, live, clusters, decisions, stored(ledger.members_after(clusters, before, decisions)), before)


def from_events(events: DataFrame, aliases: dict[str, str] | None = None) -> Rederivation:
    """Histories' events to keys: periods, claims, live view, clusters, decisions."""
    events = stored(events)
    listed = stored(mapping.periods(events))
    return rederive(mapping.claims(events, listed, aliases))


def identity_claims(events: DataFrame) -> DataFrame:
    """The identity claims of histories' events: what a fold over days reads, without the attributes, edges and keys of from_events()."""
    own = stored(events.where("kind IN ('identity', 'media')"))
    return mapping.identity_claims(own, stored(mapping.periods(own)))


def golden_records(events: DataFrame, policy: catalog.Policy = None, aliases: dict[str, str] | None = None) -> catalog.Catalog:
    """Golden records of whole histories: sources are ranked by ``policy``, fields renamed by ``aliases``."""
    folded = from_events(events, aliases)
    return catalog.project(folded.members, folded.live, policy)


def record(key: str, members: DataFrame, live: DataFrame, policy: catalog.Policy = None) -> DataFrame:
    """The decisions on one key alone: members and claims are filtered to it before anything is joined."""
    own = members.where(F.col("key") == key)
    return catalog.attributes(own, live.where("kind = 'attribute'").join(F.broadcast(own.select("code").distinct()), "code", "left_semi"), policy)


def affected(members: DataFrame, batch: DataFrame) -> DataFrame:
    """key: the established keys that a batch of claims touches: by its identities' codes, its claims' codes and both ends of its edges."""
    touched = batch.select(F.explode(F.array_distinct(F.array_compact(F.concat(F.coalesce("codes", F.array().cast("array<string>")), F.array("code", "to"))))).alias("code")).distinct()
    return members.join(touched, "code", "left_semi").select("lane", "key").distinct()


def ingest(batch: DataFrame, members: DataFrame, current: DataFrame, starts: DataFrame, shared: DataFrame | None = None) -> Rederivation:
    """Reconcile a batch of claims against the part of the store that it touches: the claims of the affected keys' listings and the batch
    are folded, other keys stay as they are. ``current`` has the live claims of the store, ``shared`` (code) what it ever found shared.
    Listings are followed to the keys that share a code with an affected one, so a cluster is folded whole."""
    keys = stored(affected(members, batch))
    while True:
        own = members.join(keys, ["lane", "key"], "left_semi")
        reach = current.where("kind = 'identity'").select("slot", F.explode("codes").alias("code")).join(own.select("code").distinct(), "code", "left_semi").select("slot").distinct()
        held = current.join(reach, "slot", "left_semi")
        more = members.join(held.select(F.explode("codes").alias("code")).distinct(), "code", "left_semi").select("lane", "key").distinct()
        wider = stored(keys.union(more).distinct())
        if wider.count() == keys.count():
            break
        keys = wider
    about = own.select("code").distinct()
    others = current.where("kind <> 'identity'").join(about, "code", "left_semi")
    claims = stored(held.unionByName(others).drop("slot").unionByName(batch, allowMissingColumns=True))
    return rederive(claims, stored(own), starts, shared)


def replaced(members: DataFrame, folded: Rederivation) -> DataFrame:
    """All members after an ingest(): those of the keys it folded are new, the others as they were."""
    untouched = members.join(folded.before.select("lane", "key").distinct(), ["lane", "key"], "left_anti")
    return untouched.select("lane", "key", "code").union(folded.members.select("lane", "key", "code"))


def numbered_events(folded: Rederivation) -> DataFrame:
    """Identity events numbered after the claims' orders."""
    top = folded.claims.agg(F.max("order")).first()[0]
    return folded.events(0 if top is None else top + 1)


def whole_log(folded: Rederivation) -> DataFrame:
    """order, type, source, key of claims and identity events, one after another: the feed that a fold leaves."""
    told = numbered_events(folded).select("order", "type", F.lit(None).cast("string").alias("source"), "key")
    return log.since(folded.claims.select(F.col("order").alias("offset"), F.lit("claim").alias("type"), "source", F.lit(None).cast("string").alias("key")).union(told.withColumnRenamed("order", "offset")), -1)
