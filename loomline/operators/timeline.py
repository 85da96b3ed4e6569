"""When identity changed, and golden records at two clocks.

fold_forward() reconciles claims date by date. Dates follow each other, but listings that never share a code, at any time, cannot meet, so
each all-time component is folded by itself, in one task, and only the numbers of new keys are dealt over all of them afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline import session
from loomline.functions import codes, registry, temporal
from loomline.functions.codes import BARCODE, NATIONAL
from loomline.operators import catalog, cluster, golden, ledger, mapping
from loomline.session import stored
from loomline.sources import log

Code = tuple[str, str]
EVENTS = "component string, day int, step int, type string, key string, keys array<string>, codes array<string>, into array<string>"


class Keys:
    """The keys of one lane and one component. New ones are called ``~1``, ``~2``, … until they are numbered over all components."""

    def __init__(self):
        self.members: dict[str, frozenset[Code]] = {}
        self.minted = 0

    def _new(self) -> str:
        self.minted += 1
        return f"~{self.minted:09d}"

    def reconcile(self, clusters: list[list[Code]], shared: set[Code]) -> Iterable[tuple]:
        """(type, key, keys, codes, into) of what becomes of the clusters and the keys; see ledger.decide()."""
        before, sets = dict(self.members), [frozenset(c) for c in clusters]
        holders: dict[Code, list[int]] = {}
        for k, own in enumerate(sets):
            for code in own - shared:
                holders.setdefault(code, []).append(k)
        held = {c for c, own in holders.items() if len(own) > 1}
        owner: dict[Code, set[str]] = {}
        for key, own in before.items():
            for code in own - shared - held:
                owner.setdefault(code, set()).add(key)
        assigned: dict[int, str] = {}
        proposed: list[tuple[list[str], frozenset[Code]]] = []
        by_key: dict[str, list[int]] = {}
        minted = []
        for k in sorted(range(len(sets)), key=lambda k: min(sets[k])):
            found = sorted({key for c in sets[k] for key in owner.get(c, ())})
            if not found:
                assigned[k] = key = self._new()
                self.members[key] = sets[k]
                minted.append(key)
            elif len(found) == 1:
                by_key.setdefault(found[0], []).append(k)
            else:
                proposed.append((found, sets[k]))
        parted = []
        for key in sorted(by_key):
            own = sorted(by_key[key], key=lambda k: ([-x for x in self._rank(sets[k], before[key])], sorted(sets[k])))
            self.members[key] = sets[own[0]]
            assigned[own[0]] = key
            into = []
            for k in sorted(own[1:], key=lambda k: sorted(sets[k])):
                assigned[k] = new = self._new()
                self.members[new] = sets[k]
                into.append(new)
            if into:
                parted.append((key, into))
        for code in sorted(held):
            keys = sorted({assigned[k] for k in holders[code] if k in assigned})
            if len(keys) > 1 and all(keys != p for p, _ in proposed):
                proposed.append((keys, frozenset().union(*(sets[k] for k in holders[code]))))
        touched = set(assigned.values()) | {key for keys, _ in proposed for key in keys}
        gone = sorted(set(before) - touched)
        for key in minted:
            yield "minted", key, [], self.members[key], []
        for key, into in parted:
            yield "split", key, [], self.members[key], into
        for key, into in parted:
            for new in into:
                yield "split_into", new, [], self.members[new], []
        for keys, own in proposed:
            yield "merge_proposed", None, keys, own, []
        for key in gone:
            yield "retracted", key, [], self.members.pop(key), []
        told = {key for key, _ in parted}
        for key in sorted(before):
            if key in self.members and key not in told and self.members[key] != before[key]:
                yield "members_changed", key, [], self.members[key], []

    @staticmethod
    def _rank(own: frozenset[Code], prior: frozenset[Code]) -> tuple[int, int, int, int]:
        kept = own & prior
        count = lambda s, g: sum(1 for c in s if (c[0] in NATIONAL) == (g == "national") and (c[0] in BARCODE) == (g == "barcode"))
        return count(kept, "national"), count(kept, "none"), len(kept), count(own, "national")


def fold(history: list[tuple[int, str, list[Code]]], shared: set[Code], allowed: list[tuple[int, tuple[Code, Code]]], voids: dict[int, int | None]) -> Iterable[tuple]:
    """(day, step, type, key, keys, codes, into) of one component's history of (day, listing, codes): from each day on, the listing holds the
    codes. ``allowed`` are pairs of national codes that some listing asserts together, on whatever component, from a day on until (-day).
    ``voids`` are days from which on no listing of the lane holds a code, with the day on which one does again: an empty lane says nothing
    of its keys, so they are retracted on that day only."""
    keys, held, at = Keys(), {}, 0
    history = sorted(history, key=lambda h: h[0])
    changes = sorted(allowed, key=lambda a: abs(a[0]))
    fine: dict = {}
    while at < len(history):
        day = history[at][0]
        while at < len(history) and history[at][0] == day:
            held[history[at][1]] = history[at][2]
            at += 1
        while changes and abs(changes[0][0]) <= day:
            d, pair = changes.pop(0)
            fine[pair] = fine.get(pair, 0) + (1 if d >= 0 else -1)
        sets = [s for s in held.values() if s]
        if not sets and day in voids:
            day = voids[day]
            if day is None or at < len(history) and history[at][0] <= day:
                continue
        found = cluster.guard(sets, shared, {p for p, n in fine.items() if n > 0}, set(), set()) if sets else []
        for step, told in enumerate(keys.reconcile(found, shared)):
            yield (day, step, *told)


def all_time(history: DataFrame) -> DataFrame:
    """lane, listing, component: listings that share a bridging code at any time, or assert one set at any time, even of shared codes only."""
    lane, listing = F.col("lane"), F.col("listing")
    each = history.select("lane", "listing", F.explode("codes").alias("code"))
    bridging = each.where(~codes.never_bridges(registry.parts(F.col("code"))))
    name = F.concat_ws("\x1f", F.lit("l"), lane, listing)
    edges = bridging.select(name.alias("a"), F.concat_ws("\x1f", F.lit("c"), "lane", "code").alias("b"))
    same = history.where(F.size("codes") > 0).select(name.alias("a"), F.concat_ws("\x1f", F.lit("d"), "lane", F.md5(F.concat_ws("\x1e", F.array_sort("codes")))).alias("b"))
    found = cluster.components(edges.union(same).distinct()).where("node LIKE 'l%'")
    parts = F.split("node", "\x1f", 3)
    return found.select(parts[1].alias("lane"), parts[2].alias("listing"), "component")


def empty_days(change: DataFrame) -> DataFrame:
    """lane, voids: the days on which a lane has no codes any more, with the day on which it has again, of change(lane, listing, day, until)."""
    steps = change.select("lane", "day", F.lit(1).alias("d")).union(change.where("until IS NOT NULL").select("lane", F.col("until").alias("day"), F.lit(-1).alias("d"))).groupBy("lane", "day").agg(F.sum("d").alias("d"))
    by = W.partitionBy("lane").orderBy("day")  # a row a day
    later = W.partitionBy("lane").orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)  # a frame that grows: one that shrinks is folded anew for each row
    counted = steps.withColumn("n", F.sum("d").over(by)).withColumn("again", F.min(F.when(F.col("n") > 0, F.col("day"))).over(later))
    return counted.where("n = 0").groupBy("lane").agg(F.collect_list(F.struct("day", F.col("again").cast("int").alias("again"))).alias("voids"))


def fold_forward(claims: DataFrame) -> DataFrame:
    """order, day, lane, type, key, keys, codes, into: the identity events of claims (mapping.claims() or finer_claims()), day by day, keys
    kept from day to day. A listing's last claim of a day counts for the day.

    Keys are numbered by (day, lane, minted before split, least code). Pairs of codes that one listing asserts together count for all
    components of their lane. One component's history is in memory at a time.
    """
    identity = claims.where("kind = 'identity'")
    lane = registry.lane_of_codes(F.col("codes"), F.col("entity"))
    day = F.floor(F.col("recorded_at") / mapping.DAY).cast("int")
    rows = identity.select(mapping.slot().alias("listing"), day.alias("day"), "order", "codes", lane.alias("own"))
    # A withdrawal has no codes and so no lane of its own: it is in the one that its listing has otherwise.
    lanes = rows.where(F.size("codes") > 0).groupBy("listing").agg(F.max_by("own", "order").alias("lane")).where("lane IS NOT NULL")
    daily = rows.join(lanes, "listing").groupBy("lane", "listing", "day").agg(F.max_by("codes", "order").alias("codes"))
    history = stored(daily)
    placed = stored(history.join(all_time(history), ["lane", "listing"], "left").withColumn("component", F.coalesce("component", F.concat_ws("\x1f", F.lit("l"), "lane", "listing"))))
    until = F.lead("day").over(W.partitionBy("lane", "listing").orderBy("day"))
    spans = placed.withColumn("until", until).select("lane", "component", "listing", "day", "until", F.explode("codes").alias("code"))
    national = spans.withColumn("scheme", registry.scheme_of(F.col("code"))).where(F.col("scheme").isin(*NATIONAL))
    other = national.select("lane", "listing", "day", "scheme", F.col("code").alias("right"))
    pairs = national.join(other, ["lane", "listing", "day", "scheme"]).where("code < right").select("lane", F.col("code").alias("left"), "right", "day", "until").distinct()
    side = lambda n: national.select("lane", F.col("code").alias(n), "component").distinct()
    near = stored(pairs.join(side("left"), ["lane", "left"]).join(side("right"), ["lane", "right", "component"]).select(F.col("component").alias("near"), "left", "right", "day", "until"))

    change = spans.select("lane", "listing", "day", "until").distinct()
    voids = empty_days(change)

    def run(key: str, rows: list[tuple]) -> Iterable[tuple]:
        cut = lambda c: tuple(c.split(":", 1))
        history, never, allowed, empty = [], set(), [], {}
        for _, name, day, own, f, again, left, right, until in rows:
            if name is not None:
                history.append((day, name, [cut(c) for c in own]))
                never |= {cut(c) for c, n in zip(own, f, strict=True) if n}
                empty = empty or {v["day"]: v["again"] for v in again or ()}
                continue
            pair = (cut(left), cut(right))
            allowed.append((day, pair))
            if until is not None:
                allowed.append((-until, pair))
        said = lambda own: sorted(f"{s}:{v}" for s, v in own)
        return [(key, d, s, t, k, ks, said(c), into) for d, s, t, k, ks, c, into in fold(history, never, allowed, empty)]

    never = F.transform("codes", lambda c: codes.never_bridges(registry.parts(c)))
    own = placed.join(F.broadcast(voids), "lane", "left").select("component", "listing", "day", "codes", never.alias("never"), "voids")
    rows = own.unionByName(near.withColumnRenamed("near", "component"), allowMissingColumns=True)
    folded = session.folded(rows.select("component", "listing", "day", "codes", "never", "voids", "left", "right", "until"), "component", run, EVENTS)
    told = stored(folded.join(placed.select("component", "lane").distinct(), "component"))
    return _numbered(told)


def _numbered(told: DataFrame) -> DataFrame:
    """Number the keys of all components, and the events."""
    new = told.where("type IN ('minted', 'split_into')").select("lane", "component", "key", "day", F.when(F.col("type") == "minted", 0).otherwise(1).alias("phase"), F.transform("codes", registry.code_order).alias("least"))
    dealt = log.numbered(new, ["lane", "day", "phase", "least", "component"], 1, "n")
    first = dealt.groupBy("lane").agg(F.min("n").alias("first"))
    names = stored(dealt.join(F.broadcast(first), "lane").select("component", "key", F.concat_ws("_", ledger.key_prefix(F.col("lane")), F.col("n") - F.col("first") + 1).alias("name")))
    rows = told.withColumn("id", F.struct("component", "day", "step"))
    listed = lambda column: rows.select("id", "component", F.posexplode(column).alias("at", "key")).join(names, ["component", "key"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("x")).select("id", F.transform("x", lambda x: x["name"]).alias(f"{column}_named"))
    named = rows.join(names.withColumnRenamed("name", "named"), ["component", "key"], "left").join(listed("keys"), "id", "left").join(listed("into"), "id", "left")
    none = F.array().cast("array<string>")
    out = named.select("day", "lane", "type", F.col("named").alias("key"), F.array_sort(F.coalesce("keys_named", none)).alias("keys"), "codes", F.coalesce("into_named", none).alias("into"))
    lane_no = F.coalesce(*[F.when(F.col("lane") == x, F.lit(k)) for k, x in enumerate(ledger.LANES)])
    phase = F.coalesce(*[F.when(F.col("type") == t, F.lit(k)) for k, t in enumerate(ledger.PHASES)])
    order = out.withColumns({"lane_no": lane_no, "phase": phase, "number": F.coalesce(ledger.key_number(F.col("key")), F.lit(0)), "subject": F.array_join("keys", "+")})
    return log.numbered(order, ["day", "lane_no", "phase", "number", "subject"], 0, "order").drop("lane_no", "phase", "number", "subject")


def timeline(told: DataFrame) -> DataFrame:
    """The product lane's events, a repeated proposal only where it first comes."""
    own = told.where("lane = 'product'")
    flags = own.where("type = 'merge_proposed'")
    first = flags.groupBy("keys").agg(F.min("order").alias("order")).select("order")
    return own.where("type <> 'merge_proposed'").unionByName(flags.join(first, "order", "left_semi"))


def members_on(told: DataFrame, day: Column) -> DataFrame:
    """lane, key, code at the end of a day, from fold_forward()'s events."""
    return ledger.fold(told.where(F.col("day") <= F.datediff(day, F.lit("1970-01-01").cast("date"))))


def claims_at(claims: DataFrame, known_at: Column, effective_at: Column) -> DataFrame:
    """Claims that were known at an instant and in force on a date, the last of each slot: selection comes before identity."""
    when = F.timestamp_seconds("recorded_at")
    date = lambda c: F.to_date(F.timestamp_seconds(c))
    known = temporal.known(when, known_at) & temporal.effective(when, date("valid_from"), date("valid_to"), effective_at)
    return mapping.live(claims.where(known))


def golden_as_of(claims: DataFrame, told: DataFrame, day: Column, policy: catalog.Policy = None) -> catalog.Catalog:
    """Golden records as known on a day, from claims and their fold_forward(): members by the events until then, values by the claims. One
    clock: a claim counts from the day it was recorded."""
    end = F.date_add(day, 1).cast("timestamp") - F.expr("INTERVAL 1 SECOND")
    return catalog.project(stored(members_on(told, day)), stored(claims_at(claims, end, day)), policy)


def records_at(revisions: DataFrame, known_at: Column, effective_at: Column) -> DataFrame:
    """Of source-record revisions(source, ref, revision, active, claims, valid_from, valid_to, recorded_at, order), the last of each record
    that was known and in force; dates are dates, recorded_at is a timestamp."""
    said = temporal.known(F.col("recorded_at"), known_at) & temporal.effective(F.col("recorded_at"), F.col("valid_from"), F.col("valid_to"), effective_at)
    rest = [c for c in revisions.columns if c not in ("source", "ref")]
    return revisions.where(said).groupBy("source", "ref").agg(F.max_by(F.struct(*rest), F.struct("recorded_at", "order")).alias("r")).select("source", "ref", "r.*")


def record_claims(selected: DataFrame) -> DataFrame:
    """The claims of active records, under their record's dates; a slot is the record's own."""
    held = selected.where("active").select("source", F.col("ref").alias("record"), "valid_from", "valid_to", "recorded_at", "order", F.explode("claims").alias("c"))
    given = [f.name for f in selected.schema["claims"].dataType.elementType if f.name not in ("source", "ref", "valid_from", "valid_to", "recorded_at", "order", "slot")]
    own = held.select("source", "record", F.col("record").alias("ref"), *[F.col("c")[n].alias(n) for n in given], F.unix_timestamp("recorded_at").alias("recorded_at"), "order")
    slot = F.concat_ws("\x1f", "source", F.lit("record"), "record", F.when(F.col("kind") == "identity", "identity").otherwise(mapping.slot()))
    return own.withColumn("slot", slot)


def boundaries(revisions: DataFrame, known_at: Column, effective_at: Column) -> list:
    """The dates up to ``effective_at`` on which what was known begins or ends to be in force, and that date. They are dates, so as many at
    most as days of history."""
    known = revisions.where(temporal.known(F.col("recorded_at"), known_at))
    ends = known.select(F.explode(F.array(F.coalesce("valid_from", F.to_date("recorded_at")), "valid_to")).alias("d")).where(F.col("d").isNotNull() & (F.col("d") <= effective_at))
    return [r[0] for r in ends.union(revisions.sparkSession.range(1).select(effective_at.cast("date"))).distinct().orderBy("d").collect()]


def state_bitemporal(revisions: DataFrame, known_at: Column, effective_at: Column, bindings: DataFrame | None = None, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, live claims) of source records at two clocks: at each boundary, the applicable records' claims are clustered and reconciled
    with the keys of the boundary before; there, the claims are all there is, so a key nothing speaks for any more is retracted.

    bindings(source, ref, key, order): a record keeps its key, also a retracted one; merges(key, into, valid_from, order): keys that stewards
    merged, from a date on. A boundary is a round of jobs: this is for audits at a point in time.
    """
    spark = revisions.sparkSession
    members = spark.createDataFrame([], golden.MEMBERS)
    starts = spark.createDataFrame([(x, 1) for x in ledger.LANES], "lane string, start bigint")
    live = None
    for day in boundaries(revisions, known_at, effective_at):
        on = F.lit(day)
        chosen = stored(records_at(revisions, known_at, on))
        live = stored(record_claims(chosen))
        ends = None
        if merges is not None:
            due = merges.where(F.col("valid_from") <= on).select("key", "into")
            ends = ledger.redirects(due).withColumnRenamed("key", "merged")
            members = stored(members.join(ends, members["key"] == ends["merged"], "left").select("lane", F.coalesce("survivor", "key").alias("key"), "code").distinct())
        clusters = golden.clusters_of(live)
        preferred = None
        if bindings is not None:
            preferred = bound_clusters(chosen, live, bindings, clusters, ends)
        found = ledger.decide(clusters, members, starts, preferred, complete=True)
        new = found.where("action IN ('mint', 'split')").groupBy("lane").agg(F.max(ledger.key_number(F.col("key"))).alias("top"))
        starts = stored(starts.join(new, "lane", "left").select("lane", F.greatest("start", F.coalesce("top", F.lit(0)) + 1).alias("start")))
        members = stored(ledger.members_after(clusters, members, found))
    return members, live


def bound_clusters(chosen: DataFrame, live: DataFrame, bindings: DataFrame, clusters: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """lane, cluster, key: for each active record with a binding, the cluster that holds all its codes, and the key, followed through
    merges. Subsets are found by counting a record's codes in the clusters that hold any of them."""
    last = bindings.groupBy("source", "ref").agg(F.max_by("key", "order").alias("key"))
    if ends is not None:
        last = last.join(ends, last["key"] == ends["merged"], "left").select("source", "ref", F.coalesce("survivor", "key").alias("key"))
    own = live.where("kind = 'identity'").select("source", F.col("record").alias("ref"), F.explode("codes").alias("code")).distinct()
    size = own.groupBy("source", "ref").agg(F.count("*").alias("size"))
    met = own.join(clusters.select("lane", "cluster", "code"), "code").groupBy("source", "ref", "lane", "cluster").agg(F.count("*").alias("met"))
    within = met.join(size, ["source", "ref"]).where("met = size").groupBy("source", "ref").agg(F.min(F.struct("lane", "cluster")).alias("w"))
    active = chosen.where("active").select("source", "ref")
    return within.join(active, ["source", "ref"], "left_semi").join(last, ["source", "ref"]).select("w.lane", "w.cluster", "key").distinct()


def attributions(members: DataFrame, live: DataFrame) -> DataFrame:
    """key, source: a source belongs to the key that holds all its listing's codes; one whose codes span keys belongs to neither."""
    own = live.where("kind = 'identity' AND size(codes) > 0").select("source", "slot", F.explode("codes").alias("code")).distinct()
    size = own.groupBy("slot").agg(F.count("*").alias("size"))
    met = own.join(members.select("key", "code"), "code").groupBy("slot", "source", "key").agg(F.count("*").alias("met"))
    return met.join(size, "slot").where("met = size").select("key", "source").distinct()


def retired(members: DataFrame, live: DataFrame) -> DataFrame:
    """lane, key: keys none of whose codes any source still claims."""
    claimed = live.where("kind = 'identity'").select(F.explode("codes").alias("code")).distinct()
    alive = members.join(claimed, "code", "left_semi").select("lane", "key")
    return members.select("lane", "key").distinct().join(alive, ["lane", "key"], "left_anti")


def standing_proposals(told: DataFrame, members: DataFrame, live: DataFrame, day: Column) -> DataFrame:
    """keys, bridge: merges proposed until a day between keys that are all still claimed, with the codes that the sources of each of the
    keys claim now."""
    until = told.where("type = 'merge_proposed'").where(F.col("day") <= F.datediff(day, F.lit("1970-01-01").cast("date"))).select("keys").distinct()
    gone = retired(members, live).select("key")
    alive = members.select("key").distinct().join(gone, "key", "left_anti")
    each = until.select("keys", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    open_ = each.join(alive, "key").groupBy("keys", "n").agg(F.count("*").alias("k")).where("k = n").select("keys", "n")
    sourced = attributions(members, live).join(live.where("kind = 'identity'").select("source", F.explode("codes").alias("code")), "source").select("key", "code").distinct()
    met = open_.select("keys", "n", F.explode("keys").alias("key")).join(sourced, "key").groupBy("keys", "n", "code").agg(F.count("*").alias("k")).where("k = n")
    bridges = met.groupBy("keys").agg(F.array_sort(F.collect_set("code")).alias("bridge"))
    return open_.select("keys").join(bridges, "keys", "left")
