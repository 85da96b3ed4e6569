"""From the events of histories to claims about codes: periods of code sets, anchors, claims, and what has to be refused.

Events have entity, source_system, order (an event's number in its entity), recorded_at, valid_from, source, op, kind, scheme, code, field,
locale, collection, value STRUCT(t, s). Codes are ``scheme:value`` in canonical form. A listing is an (entity, source).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import codes, dimensions, registry
from loomline.operators import slots
from loomline.session import stored
from loomline.sources import envelope, log

DAY = 86_400
# Collections whose members are records of their own -> (scheme, lane, relation to the product).
LANE_COLLECTIONS = {"descriptions": ("text_id", "description", "describes"), "media": ("asset_id", "media", "depicts"), "leaflets": ("leaflet_id", "media", "depicts")}
# Which of a listing's codes stands for it, the first first. After them come GTINs, unrestricted ones first, and THIRTEEN.
PRIMARY = ("cnk", "cip_acl7", "cefip", "pzn", "sukl", "pzn_austria", "national_code", "cn")
THIRTEEN = ("acl13", "cip13")

VALUE = "struct<t: string, s: string>"
#: The columns of a claim; null where its kind has none.
CLAIM = {
    "kind": "string", "source": "string", "ref": "string", "codes": "array<string>", "entity": "string", "code": "string", "field": "string", "value": VALUE,
    "product": "bigint", "asset": "string", "role": "string", "uri": "string", "relation": "string", "to": "string", "valid_from": "bigint", "valid_to": "bigint", "recorded_at": "bigint",
}


def as_history(decoded: DataFrame, source_system: str) -> DataFrame:
    """Events of decoded deltas with a number in their entity, in the order of deltas and of events within one; they are in force from
    when they were recorded."""
    by = W.partitionBy("entity").orderBy("delta", "at")
    return decoded.select("*", F.lit(source_system).alias("source_system"), F.col("recorded_at").alias("valid_from"), (F.row_number().over(by) - 1).alias("order")).drop("delta", "at")


def _apply(held: dict[str, dict], op: str, scheme: str, raw: str | None, canonical: str | None) -> None:
    """One identity event on what a listing holds: scheme -> {code as said: canonical code}."""
    if op == "add" and raw is not None:
        held.setdefault(scheme, {})[raw] = canonical
    elif op == "remove":
        held.get(scheme, {}).pop(raw, None)
    elif op == "set" and raw is not None:
        held[scheme] = {raw: canonical}
    elif op in ("set", "delete"):
        held.pop(scheme, None)


def _sets(events: DataFrame, finer: bool) -> DataFrame:
    """The code sets of each listing in turn. Its events stream through one task in order; only what it holds now, and the period that is
    open, is in memory. ``finer`` takes a set after each change, whatever the day, but none before the first code."""
    identity = events.where("kind = 'identity'").select("entity", F.col("source").alias("source"), "order", "op", "scheme", "code", registry.code_of(registry.scheme(F.col("scheme")), F.col("code")).alias("canonical"), "recorded_at")
    place = ["recorded_at", "order"] if finer else ["order"]
    names = ["entity", "source", "n", "from_at", "to_at", "codes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, open_, n = None, {}, None, 0

        def close(to) -> tuple:
            return (*at, n - 1, open_[0], to, sorted(open_[1], key=lambda c: (c.split(":", 1)[0] not in registry.KNOWN, c)))

        for batch in batches:
            out = []
            for entity, source, _, op, scheme, raw, canonical, when in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                if (entity, source) != at:
                    if open_:
                        out.append(close(None))
                    at, held, open_, n = (entity, source), {}, None, 0
                _apply(held, op, scheme, raw, canonical)
                now = {c for own in held.values() for c in own.values()}
                if open_ and open_[1] == now or finer and not open_ and not now:
                    continue
                if open_ and not finer and open_[0] // DAY == when // DAY:
                    open_ = (open_[0], now)
                    continue
                if open_:
                    out.append(close(when))
                open_, n = (when, now), n + 1
            yield pd.DataFrame(out, columns=names).astype({"to_at": "Int64"})
        if open_:
            yield pd.DataFrame([close(None)], columns=names).astype({"to_at": "Int64"})

    rows = identity.repartition("entity", "source").sortWithinPartitions("entity", "source", *place)
    return rows.mapInPandas(run, "entity bigint, source string, n int, from_at bigint, to_at bigint, codes array<string>")


def periods(events: DataFrame) -> DataFrame:
    """entity, source, n, from_at, to_at, codes: what each listing held, half-open, the last open. Runs of one set are one period, a later
    set of a UTC day replaces the day's earlier one, and an empty set is a period too: a delisting."""
    return _sets(events, False)


def snapshots(events: DataFrame) -> DataFrame:
    """As periods(), of every change and dated by day (``day``): the finer fold. Empty sets before the first code are left out."""
    return _sets(events, True).withColumn("day", F.to_date(F.timestamp_seconds("from_at")))


def primary(held: Column) -> Column:
    """The code of an array that stands for its listing: a short national code, a GTIN, a 13-digit one, or the least."""

    def place(code: Column) -> Column:
        scheme, n = registry.scheme_of(code), len(PRIMARY)
        rank = F.coalesce(*[F.when(scheme == s, F.lit(k)) for k, s in enumerate(PRIMARY)], *[F.when(scheme == s, F.lit(n + 2 + k)) for k, s in enumerate(THIRTEEN)], F.lit(n + 4))
        return F.when(scheme == "gtin", F.when(codes.restricted(registry.parts(code)), F.lit(n + 1)).otherwise(F.lit(n))).otherwise(rank)

    return F.array_min(F.transform(held, lambda c: F.struct(place(c).alias("rank"), registry.code_order(c).alias("code"))))["code"]["code"]


def _held_at(points: DataFrame, facts: DataFrame, first: bool) -> DataFrame:
    """Add ``held``, the codes of the listing's last fact (listing, at, codes) at or before each point, or of its first if ``first``. Both
    are sorted together in one shuffle by listing, so no pair of them is formed."""
    point = F.struct(*points.columns)
    both = points.select("listing", F.col("at").alias("at"), point.alias("point"), F.lit(None).cast("array<string>").alias("codes"), F.lit(1).alias("side"))
    both = both.unionByName(facts.select("listing", "at", F.lit(None).cast(both.schema["point"].dataType).alias("point"), "codes", F.lit(0).alias("side")))
    by = W.partitionBy("listing").orderBy("at", "side")
    past = F.last("codes", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    begin = F.first("codes", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return both.withColumn("held", F.coalesce(past, begin) if first else past).where("side = 1").select("point.*", "held")


def anchored(events: DataFrame, listed: DataFrame) -> DataFrame:
    """Each event with the codes it is about, a row for each: those its source held, the last it held before, or else the first it came to
    hold. An event without a source is about all that its entity's listings held then; at the instant of a delisting that is what the
    listing held until then. Events about nothing have no row. ``listed`` has periods()."""
    listing = F.struct("entity", "source").alias("listing")
    facts = listed.select(listing, F.col("from_at").alias("at"), "codes", "n", "entity", "source")
    points = events.withColumn("at", F.col("recorded_at"))
    sourced = _held_at(points.where("source IS NOT NULL").select("*", listing), facts.where(F.size("codes") > 0), True)
    before = F.lag("codes").over(W.partitionBy("listing").orderBy("n"))
    # At a delisting's own instant its period has the codes of the one before; from the next second on, none.
    whole = facts.withColumn("before", before)
    parting = whole.where((F.size("codes") == 0) & F.col("before").isNotNull())
    steps = whole.select("listing", (F.col("at") + F.when((F.size("codes") == 0) & F.col("before").isNotNull(), 1).otherwise(0)).alias("at"), "codes").union(parting.select("listing", "at", F.col("before").alias("codes")))
    own = listed.select("entity", listing).distinct()
    unsourced = _held_at(points.where("source IS NULL").join(own, "entity"), steps, False)
    each = lambda held: held.drop("listing", "at").withColumn("code", F.explode("held")).drop("held")
    # A listing's codes are a set, so only listings that an event without a source meets together say a code twice.
    return each(sourced).unionByName(each(unsourced).dropDuplicates(["entity", "order", "code"]))


def refs(events: DataFrame) -> DataFrame:
    """entity, source, collection, id, valid_from, recorded_at of media that additions and removals leave, with their last mention. An
    event without a source speaks for its source system."""
    listed = events.where("kind = 'media' AND value IS NOT NULL AND value.t <> 'n'").where(F.col("collection").isin(*LANE_COLLECTIONS))
    named = listed.select("entity", F.coalesce("source", "source_system").alias("source"), "collection", F.col("value.s").alias("id"), "order", "op", "valid_from", "recorded_at")
    last = named.groupBy("entity", "source", "collection", "id").agg(F.max_by(F.struct("op", "valid_from", "recorded_at"), "order").alias("l"))
    return last.where("l.op <> 'remove'").select("entity", "source", "collection", "id", "l.valid_from", "l.recorded_at")


def attribute_value(field: Column, value: Column) -> Column:
    """A value with a list of one as its element, and a declared quantity in its base unit: a whole number, or a decimal one."""
    items = F.from_json(F.when(value["t"] == "j", value["s"]), "array<variant>")
    flat = codes.let(items, lambda a: F.when(F.size(a) == 1, envelope.tagged(F.get(a, F.lit(0)))).otherwise(value))

    def measured(v: Column) -> Column:
        based = lambda q: F.when((v["t"] == "s") & (q != v["s"]), F.struct(F.when(q.rlike("^[0-9]+$"), "i").otherwise("f").alias("t"), q.alias("s"))).otherwise(v)
        return codes.let(codes.quantity(field, v["s"]), based)

    return codes.let(flat, measured)


def _claims(rows: DataFrame, kind: str | Column, **columns: Column) -> DataFrame:
    given = {"kind": F.lit(kind), **columns}
    return rows.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in CLAIM.items()], given["place"].alias("place"))


def _place(kind: int | Column, *rest: Column) -> Column:
    """Where a claim comes among those of its instant: by kind, entity, source, number and code."""
    entity, source, n, code = rest
    return F.struct(F.lit(kind).alias("kind"), entity.cast("bigint").alias("entity"), source.alias("source"), n.cast("bigint").alias("n"), code.alias("code"))


def _identity(listed: DataFrame) -> DataFrame:
    c = F.col
    return _claims(listed, "identity", ref=F.concat_ws(":", "entity", "source"), codes=c("codes"), place=_place(0, c("entity"), c("source"), c("n"), F.lit("")), valid_from=c("from_at"), valid_to=c("to_at"), recorded_at=c("from_at"), source=c("source"))


def _records(kept: DataFrame) -> DataFrame:
    """Identity claims of refs(): each is a record of its own, in its collection's lane."""
    c = F.col
    which = lambda k: F.coalesce(*[F.when(c("collection") == n, F.lit(v[k])) for n, v in LANE_COLLECTIONS.items()])
    own = F.concat_ws(":", which(0), "id")
    return _claims(kept, "identity", source=c("source"), ref=F.concat_ws(":", "collection", "id"), codes=F.array(own), entity=which(1), place=_place(4, c("entity"), c("source"), F.lit(0), own), valid_from=F.coalesce("valid_from", "recorded_at"), recorded_at=c("recorded_at"))


def identity_claims(events: DataFrame, listed: DataFrame) -> DataFrame:
    """The identity claims among claims(), in the same order, numbered by themselves: all that a fold of identity alone reads. ``events``
    need no attributes or edges."""
    return log.numbered(stored(_identity(listed).unionByName(_records(refs(events)))), ["recorded_at", "place"], column="order").drop("place")


def claims(events: DataFrame, listed: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """placed_claims() without their places."""
    return placed_claims(events, listed, aliases).drop("place")


def placed_claims(events: DataFrame, listed: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """The claims of histories, with ``order``: gapless, by when they were recorded. Identity and grouping claims cover a period each;
    attributes and memberships are claimed of every code their source held; media and descriptions are records in lanes of their own,
    tied to the codes that their entity held. ``aliases`` renames fields and collections. ``place.entity`` tells whose history a claim is
    from: it depends on no other's, so the claims of some entities are those of all that have their places."""
    aliases = aliases or {}
    c = F.col
    interval = {"valid_from": c("from_at"), "valid_to": c("to_at"), "recorded_at": c("from_at"), "source": c("source")}
    each = listed.withColumn("code", F.explode("codes"))
    grouping = _claims(each, "grouping", code=c("code"), product=c("entity"), place=_place(1, c("entity"), c("source"), c("n"), c("code")), **interval)

    said = anchored(events.where("kind = 'attribute' OR kind = 'edge' AND op IN ('set', 'add') AND value IS NOT NULL AND value.t <> 'n'"), listed)
    when = {"valid_from": c("valid_from"), "recorded_at": c("recorded_at"), "source": c("source"), "code": c("code")}
    name = dimensions.resolve(dimensions.field_name(c("field"), c("locale")), aliases)
    value = F.coalesce(attribute_value(c("field"), c("value")), F.struct(F.lit("n").alias("t"), F.lit("").alias("s")))
    is_value = c("kind") == "attribute"
    member = F.concat_ws(":", dimensions.resolve(c("collection"), aliases), c("value.s"))
    place = _place(F.when(is_value, 2).otherwise(3), c("entity"), c("source"), c("order"), c("code"))
    told = {"field": F.when(is_value, name), "value": F.when(is_value, value), "relation": F.when(~is_value, "member_of"), "to": F.when(~is_value, member)}
    spoken = _claims(said.where(is_value | ~c("collection").isin(*LANE_COLLECTIONS)), F.when(is_value, "attribute").otherwise("edge"), place=place, **told, **when)  # both in one pass: what they are about is found by a sort of all

    kept = refs(events)
    which = lambda k: F.coalesce(*[F.when(c("collection") == n, F.lit(v[k])) for n, v in LANE_COLLECTIONS.items()])
    own = F.concat_ws(":", which(0), "id")
    told = {"valid_from": F.coalesce("valid_from", "recorded_at"), "recorded_at": c("recorded_at")}
    points = kept.select("*", own.alias("own")).select("entity", F.lit(None).cast("string").alias("source"), F.xxhash64("source", "own").alias("order"), F.col("source").alias("said_by"), "collection", "own", "valid_from", "recorded_at")
    tied = anchored(points, listed)
    edge = _claims(tied, "edge", source=c("said_by"), code=c("own"), relation=which(2), to=c("code"), place=_place(5, c("entity"), c("said_by"), F.lit(0), F.concat_ws(">", "own", "code")), **told)

    whole = _identity(listed)
    for more in (grouping, spoken, _records(kept), edge):
        whole = whole.unionByName(more)
    return log.numbered(stored(whole), ["recorded_at", "place"], column="order")


def finer_claims(events: DataFrame, snaps: DataFrame) -> DataFrame:
    """Identity and grouping claims of snapshots(), dated by day, and attributes and memberships claimed of one code: the primary code of
    what the source held on the day, or else of what it held last; without a source, of what the entity's listings held last."""
    c = F.col
    day = {"valid_from": c("from_at"), "recorded_at": c("from_at"), "source": c("source")}
    identity = _claims(snaps, "identity", ref=F.concat_ws(":", "entity", "source"), codes=c("codes"), place=_place(0, c("entity"), c("source"), c("n"), F.lit("")), **day)
    grouping = _claims(snaps.withColumn("code", F.explode("codes")), "grouping", code=c("code"), product=c("entity"), place=_place(1, c("entity"), c("source"), c("n"), c("code")), **day)
    said = primaries(events.where("kind = 'attribute' OR kind = 'edge' AND op IN ('set', 'add') AND value IS NOT NULL AND value.t <> 'n'"), snaps).where("code IS NOT NULL")
    when = {"valid_from": c("valid_from"), "recorded_at": c("recorded_at"), "source": c("source"), "code": c("code")}
    value = F.coalesce(attribute_value(c("field"), c("value")), F.struct(F.lit("n").alias("t"), F.lit("").alias("s")))
    attribute = _claims(said.where("kind = 'attribute'"), "attribute", field=dimensions.field_name(c("field"), c("locale")), value=value, place=_place(2, c("entity"), c("source"), c("order"), c("code")), **when)
    members = said.where("kind = 'edge'").where(~c("collection").isin(*LANE_COLLECTIONS))
    member_of = _claims(members, "edge", relation=F.lit("member_of"), to=F.concat_ws(":", "collection", "value.s"), place=_place(3, c("entity"), c("source"), c("order"), c("code")), **when)
    whole = identity.unionByName(grouping).unionByName(attribute).unionByName(member_of)
    return log.numbered(stored(whole).withColumn("day", F.floor(F.col("recorded_at") / DAY)), ["day", "place"], column="order").drop("place", "day")


def primaries(events: DataFrame, snaps: DataFrame) -> DataFrame:
    """Each event with ``code``: the primary code as of its day (see finer_claims()), null where its source never held one."""
    listing = F.struct("entity", "source").alias("listing")
    held = snaps.where(F.size("codes") > 0).select(listing, F.floor(F.col("from_at") / DAY).alias("at"), "n", F.array(primary(F.col("codes"))).alias("codes"), F.col("codes").alias("whole"), "entity")
    daily = held.groupBy("listing", "at").agg(F.max_by("codes", "n").alias("codes"))
    final = held.groupBy("entity", "listing").agg(F.max_by(F.struct("codes", "whole"), "n").alias("l")).select("entity", "listing", F.col("l.codes").alias("last"), "l.whole")
    points = events.withColumn("at", F.floor(F.col("recorded_at") / DAY))
    sourced = _held_at(points.where("source IS NOT NULL").select("*", listing), daily, False)
    sourced = sourced.join(final.select(F.col("listing").alias("__l"), "last"), F.col("listing") == F.col("__l"), "left").withColumn("code", F.get(F.coalesce("held", "last"), F.lit(0))).drop("__l", "last", "held", "listing")
    entity = final.groupBy("entity").agg(primary(F.array_distinct(F.flatten(F.collect_list("whole")))).alias("code"))
    unsourced = points.where("source IS NULL").join(entity, "entity", "left")
    return sourced.unionByName(unsourced).drop("at")


def rejected(events: DataFrame, listed: DataFrame) -> DataFrame:
    """entity, order, source, kind, detail, recorded_at, reason of events that cannot become claims: ``unsourced`` and
    ``source_held_no_code`` are about nothing; ``unsupported_edge_op``, ``empty_edge_value`` and ``unknown_lane_collection`` say nothing."""
    known = F.col("collection").isin(*LANE_COLLECTIONS)
    asked = events.where((F.col("kind") == "attribute") | (F.col("kind") == "edge") & ~known | (F.col("kind") == "media") & ~known)
    found = anchored(asked.where("kind <> 'media'"), listed).select("entity", "order").distinct().withColumn("found", F.lit(True))
    empty = F.col("value").isNull() | (F.col("value.t") == "n")
    reason = (
        F.when(F.col("kind") == "media", "unknown_lane_collection")
        .when((F.col("kind") == "edge") & ~F.col("op").isin("set", "add"), "unsupported_edge_op")
        .when((F.col("kind") == "edge") & empty, "empty_edge_value")
        .when(F.col("found").isNull(), F.when(F.col("source").isNull(), "unsourced").otherwise("source_held_no_code"))
    )
    detail = F.when(F.col("kind") == "attribute", dimensions.field_name(F.col("field"), F.col("locale"))).otherwise(F.col("collection"))
    named = asked.join(found, ["entity", "order"], "left").select("entity", "order", "source", "kind", detail.alias("detail"), "recorded_at", reason.alias("reason"))
    return named.where("reason IS NOT NULL")


def slot() -> Column:
    """What a later claim of the same source replaces."""
    c, parts = F.col, {"identity": ["ref"], "grouping": ["code"], "attribute": ["code", "field"], "media": ["asset", "code"], "edge": ["code", "relation", "to"], "identity_evidence": ["code", "to"]}
    own = F.coalesce(*[F.when(c("kind") == k, F.concat_ws("\x1f", c("source"), c("kind"), *map(c, names))) for k, names in parts.items()])
    return F.coalesce(own, F.concat_ws("\x1f", c("source"), c("kind")))


def live(claimed: DataFrame) -> DataFrame:
    """The last claim of each slot."""
    return slots.current(claimed.withColumn("slot", slot()), ["slot"], ["order"])
