"""Taking batches of claims into a store: validated whole, winnowed, reconciled with the keys they touch, and committed or only simulated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import codes, registry
from loomline.functions.codes import bridge_grade
from loomline.operators import catalog, golden, ledger, legacy, mapping, slots, validate
from loomline.session import stored
from loomline.sources import log, store

#: Claims of a batch, and histories of a backfill, at most.
MAX_CLAIMS, MAX_HISTORIES = 10_000, 1_000
EVENTS = "order bigint, lane string, type string, key string, keys array<string>, codes array<string>, into array<string>, subject string"


class Refused(Exception):
    def __init__(self, status: int, reason: str, findings: list | None = None):
        super().__init__(reason)
        self.status, self.reason, self.findings = status, reason, findings or []


def checked(raw: DataFrame) -> DataFrame:
    """The warnings of a raw batch (see validate.findings()); one error refuses the whole of it, with all errors."""
    found = stored(validate.findings(raw))
    errors = found.where("level = 'error'").orderBy("index", "field").limit(MAX_CLAIMS).collect()
    if errors:
        raise Refused(422, f"{len(errors)} errors", [tuple(r) for r in errors])
    return found


def limited(batch: DataFrame, limit: int = MAX_CLAIMS) -> DataFrame:
    """The batch, if it has no more rows than a request may; the count stops at the limit."""
    if batch.limit(limit + 1).count() > limit:
        raise Refused(413, f"more than {limit} rows")
    return batch


def content() -> Column:
    """A claim's content: what makes it the claim it is, whenever it is recorded and by whichever spelling of its codes."""
    names = [c for c in mapping.CLAIM if c != "recorded_at"]
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"}), 256)


def fingerprint(batch: DataFrame) -> str:
    """A digest of a batch's contents, whatever the order of its rows."""
    r = batch.select(content().alias("c")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"), F.sum(F.crc32(F.col("c").cast("binary"))).alias("s")).first()
    return ":".join(str(x) for x in r)


def winnowed(batch: DataFrame, current: DataFrame | None) -> DataFrame:
    """The claims of a batch (mapping.CLAIM and index) that change something: equal claims count once, at their first place, and a claim
    equal to the one before it in its slot, in the batch or in ``current``, is dropped."""
    keyed = batch.withColumns({"slot": mapping.slot(), "content": content()})
    held = keyed.select("slot", "content").limit(0) if current is None else current.select("slot", content().alias("content"))
    kept = slots.winnowed(keyed, held, ["slot"], "content", ["index"]).select("slot", "content", "index")
    return keyed.join(kept, ["slot", "content", "index"], "left_semi").drop("content")


def changing(rows: DataFrame, current: DataFrame | None) -> DataFrame:
    """winnowed() of compacted rows: with one claim a slot there are no repeats, only what ``current`` holds already."""
    keyed = rows.withColumn("slot", mapping.slot())
    if current is None:
        return keyed
    held = current.select("slot", content().alias("stored"))
    return keyed.withColumn("content", content()).join(held, "slot", "left").where(~F.col("content").eqNullSafe(F.col("stored"))).drop("content", "stored")


def compacted(batch: DataFrame) -> DataFrame:
    """The last claim of each slot, in the batch's order: a cut-over takes the source's present, not its history."""
    return slots.current(batch.withColumn("slot", mapping.slot()), ["slot"], ["index"]).drop("slot")


@dataclass(frozen=True)
class Outcome:
    accepted: int
    skipped: int
    compacted: int
    events: DataFrame
    members: DataFrame
    live: DataFrame
    claims: DataFrame
    shared: DataFrame
    ids: DataFrame
    starts: DataFrame


def _starts(kept: store.Store, members: DataFrame) -> DataFrame:
    return kept.read("starts") if kept.has("starts") else ledger.next_keys(members)


@dataclass(frozen=True)
class Fresh:
    """The claims of a batch that change something, and how many there are of them and of those that do not."""

    claims: DataFrame
    accepted: int
    skipped: int
    compacted: int


def fresh_of(kept: store.Store, batch: DataFrame, compact: bool = False) -> Fresh:
    size = batch.count()
    rows = stored(compacted(batch)) if compact else batch
    current = kept.read("live") if kept.has("live") else None
    claims = stored(changing(rows, current) if compact else winnowed(rows, current))
    accepted, given = claims.count(), rows.count() if compact else size
    return Fresh(claims, accepted, given - accepted, size - given)


def simulate(kept: store.Store, batch: DataFrame, compact: bool = False) -> Outcome:
    """What taking a batch would come to, without taking it. claims(mapping.CLAIM, index); an index is a claim's place in the batch."""
    return _outcome(kept, fresh_of(kept, batch, compact))


def _outcome(kept: store.Store, found: Fresh) -> Outcome:
    fresh, accepted = found.claims, found.accepted
    current = kept.read("live") if kept.has("live") else None
    members = kept.read("members") if kept.has("members") else kept.spark.createDataFrame([], golden.MEMBERS)
    following = 0
    for table in ("claims", "events"):
        top = kept.read(table).agg(F.max("order")).first()[0] if kept.has(table) else None
        following = following if top is None else max(following, top + 1)
    ordered = log.numbered(fresh.drop("slot"), ["index"], following, "order").drop("index")
    before = ordered.withColumn("slot", mapping.slot()).limit(0) if current is None else current
    natural = ordered.where("kind = 'identity'").select(F.explode("codes").alias("code")).where(codes.never_bridges(registry.parts(F.col("code"))))
    shared = natural.distinct() if not kept.has("shared") else kept.read("shared").union(natural).distinct()
    shared = stored(shared)
    folded = golden.ingest(ordered, members, before, _starts(kept, members), shared)
    events = folded.events(following + accepted)
    after = stored(golden.replaced(members, folded))
    live = stored(slots.current(before.unionByName(ordered.withColumn("slot", mapping.slot()), allowMissingColumns=True), ["slot"], ["order"]))
    grouped = live.where("kind = 'grouping'").select("code", "product", "source")
    assigned = kept.read("ids") if kept.has("ids") else None
    ids = legacy.allocate(after.where("lane = 'product'"), grouped, None if assigned is None else assigned.select("key", "legacy_id"))
    new = folded.decisions.where("action IN ('mint', 'split')").groupBy("lane").agg(F.max(ledger.key_number(F.col("key"))).alias("top"))
    starts = stored(_starts(kept, members).join(new, "lane", "left").select("lane", F.greatest("start", F.coalesce("top", F.lit(0)) + 1).alias("start")))
    return Outcome(accepted, found.skipped, found.compacted, stored(events), after, live, ordered, shared, stored(ids), starts)


def take(kept: store.Store, batch: DataFrame, idempotency_key: str | None = None, compact: bool = False) -> dict:
    """Take a batch into the store in one commit and tell what it did. The same idempotency key with the same content answers again as it
    did, and with other content is refused (409); a batch that changes nothing commits nothing but its key."""
    mark = fingerprint(batch) if idempotency_key is not None else None
    if idempotency_key is not None and kept.has("batches"):
        seen = kept.read("batches").where(F.col("idempotency_key") == idempotency_key).first()
        if seen is not None:
            if seen.fingerprint != mark:
                raise Refused(409, "the idempotency key was used with other claims")
            return {"accepted": seen.accepted, "skipped": seen.skipped, "compacted": seen.compacted, "replayed": True}
    fresh = fresh_of(kept, batch, compact)
    answer = {"accepted": fresh.accepted, "skipped": fresh.skipped, "compacted": fresh.compacted, "replayed": False}
    appended = {}
    if idempotency_key is not None:
        appended["batches"] = kept.spark.createDataFrame([(idempotency_key, mark, fresh.accepted, fresh.skipped, fresh.compacted)], "idempotency_key string, fingerprint string, accepted bigint, skipped bigint, compacted bigint")
    if fresh.accepted:  # what changes nothing is not folded
        found = _outcome(kept, fresh)
        appended |= {"claims": found.claims, "events": found.events, "ids": found.ids}
        kept.commit({"members": found.members, "live": found.live, "shared": found.shared, "starts": found.starts}, appended)
    elif appended:
        kept.commit({}, appended)
    return answer


def backfill(kept: store.Store, events: DataFrame, idempotency_key: str | None = None) -> dict:
    """Take histories' events (see mapping) into the store: those of entities whose history the store has seen with the same content are
    left out."""
    rest = [c for c in events.columns if c != "entity"]
    marks = stored(events.groupBy("entity").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*rest)))).alias("x"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*rest)), F.lit(1))).alias("y")))
    fresh = marks if not kept.has("seen") else stored(marks.join(kept.read("seen"), ["entity", "n", "x", "y"], "left_anti"))
    own = events.join(fresh.select("entity"), "entity", "left_semi")
    listed = stored(mapping.periods(own))
    batch = mapping.claims(own, listed).withColumnRenamed("order", "index")
    answer = take(kept, batch, idempotency_key)
    kept.commit({}, {"seen": fresh})
    return answer | {"histories": fresh.count()}


def suspects(found: Outcome) -> DataFrame:
    """lane, keys, suspect: proposals of an outcome. A proposal is suspect if one of its keys hangs together with the rest by barcodes only:
    among the key's codes in listings that also hold codes outside it, none is national."""
    never = found.shared.select("code")
    proposed = found.events.where("type = 'merge_proposed'").select("lane", "keys", "codes").distinct().withColumn("id", F.monotonically_increasing_id())
    proposed = stored(proposed)
    bare = proposed.select("id", F.explode("codes").alias("code")).join(never, "code", "left_anti")
    own = proposed.select("id", F.explode("keys").alias("key")).join(found.members.select("key", "code"), "key").join(never, "code", "left_anti")
    listed = found.live.where("kind = 'identity'").select("slot", F.explode("codes").alias("code")).distinct().join(never, "code", "left_anti")
    inside = own.join(listed, "code").select("id", "key", "slot", "code")
    held = bare.join(listed, "code").select("id", "slot", "code")
    # A listing reaches beyond a key if it holds a code of the proposal that the key does not own.
    reach = held.join(proposed.select("id", F.explode("keys").alias("key")), "id").join(own.select("id", "key", "code").withColumn("mine", F.lit(True)), ["id", "key", "code"], "left").where("mine IS NULL").select("id", "key", "slot").distinct()
    attached = inside.join(reach, ["id", "key", "slot"], "left_semi")
    trusted = attached.where(bridge_grade(registry.scheme_of(F.col("code"))) == "national").select("id", "key").distinct().withColumn("trusted", F.lit(True))
    each = proposed.select("id", F.explode("keys").alias("key")).join(trusted, ["id", "key"], "left")
    weak = each.groupBy("id").agg(F.max(F.col("trusted").isNull()).alias("suspect"))
    return proposed.join(weak, "id").select("lane", "keys", "suspect")


def report(found: Outcome, policy: catalog.Policy = None) -> DataFrame:
    """section, subject, detail of what an outcome leaves to people: mints, merge candidates, attribute conflicts, code collisions, and the
    queue of the last three."""
    c, text = F.col, lambda x: x.cast("string")
    row = lambda section, subject, detail: (F.lit(section).alias("section"), text(subject).alias("subject"), text(detail).alias("detail"))
    mints = found.events.where("type = 'minted' AND lane = 'product'").select(*row("mint", c("key"), F.array_join("codes", ",")))
    joined = suspects(found)
    merges = joined.select(*row("merge_candidate", F.concat(F.lit("merge:"), F.array_join("keys", "+")), F.when(c("suspect"), "suspect").otherwise("trusted")))
    open_ = catalog.attributes(found.members, found.live, policy).where("status = 'needs_review'")
    options = F.array_join(F.transform("candidates", lambda x: F.concat_ws("=", text(x["source"]), catalog.tagged_text(x["value"]))), ",")
    ties = open_.select(*row("conflict", F.concat(F.lit("attr:"), "key", F.lit("/"), "field"), options))
    clashes = catalog.collisions(found.members, found.live).select(*row("code_collision", F.concat(F.lit("collision:"), "key"), F.array_join(F.transform("products", text), ",")))
    work = merges.union(ties).union(clashes)
    return mints.union(work).union(work.select(F.lit("queue").alias("section"), "subject", "detail"))


def funnel(found: Outcome, reported: DataFrame) -> str:
    n = {r.section: r.n for r in reported.groupBy("section").agg(F.count("*").alias("n")).collect()}
    weak = reported.where("section = 'merge_candidate' AND detail = 'suspect'").count()
    of = lambda s: n.get(s, 0)
    return (
        f"{found.accepted} claim(s) would be accepted ({found.skipped} skipped); {of('mint')} product(s) would be minted; {of('conflict')} conflict(s), "
        f"{of('merge_candidate')} merge candidate(s) ({weak} suspect), {of('code_collision')} code collision(s); {of('queue')} item(s) for the queue"
    )


def rebuilt(kept: store.Store) -> tuple[DataFrame, DataFrame]:
    """(members, live) folded anew from the store's events and claims."""
    return ledger.fold(kept.read("events")), slots.current(kept.read("claims").withColumn("slot", mapping.slot()), ["slot"], ["order"])


def drift(kept: store.Store) -> DataFrame:
    """table, side, n: rows that only the store's tables have, or only those folded anew. None if the store is what its log says."""
    members, live = rebuilt(kept)
    names = ["slot", "order"]

    def sides(own: DataFrame, anew: DataFrame, table: str) -> DataFrame:
        rows = own.withColumn("side", F.lit(1)).union(anew.withColumn("side", F.lit(2)))  # each is read once
        seen = rows.groupBy(*own.columns).agg(F.bit_or("side").alias("side")).where("side < 3")
        return seen.select(F.lit(table).alias("table"), F.when(F.col("side") == 1, "stored").otherwise("folded").alias("side"))

    own = kept.read("members").select("lane", "key", "code")
    both = sides(own, members.select("lane", "key", "code"), "members").union(sides(kept.read("live").select(*names), live.select(*names), "live"))
    return both.groupBy("table", "side").agg(F.count("*").alias("n"))
