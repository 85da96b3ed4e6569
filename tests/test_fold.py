import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import codes, registry
from loomline.operators import cluster, golden, ledger, legacy, mapping, parity, policy, steward, timeline, writes
from loomline.sources import envelope, store

EVENT = "entity bigint, source_system string, `order` bigint, recorded_at bigint, valid_from bigint, source string, op string, kind string, scheme string, code string, field string, locale string, collection string, value struct<t: string, s: string>"
DAY = mapping.DAY


def event(entity, order, at, source, op, kind, *, scheme=None, code=None, field=None, collection=None, value=None):
    return (entity, "app", order, at, at, source, op, kind, scheme, code, field, None, collection, value and ("s", value))


def test_periods_and_anchors(spark):
    rows = [
        event(1, 0, 10 * DAY, "a", "set", "identity", scheme="cnk", code="1"),
        event(1, 1, 10 * DAY + 5, "a", "add", "identity", scheme="ean", code="5400000000001"),
        event(1, 2, 12 * DAY, "a", "delete", "identity", scheme="cnk"),
        event(1, 3, 12 * DAY + 9, "a", "remove", "identity", scheme="ean", code="5400000000001"),
        event(1, 4, 14 * DAY, "b", "set", "identity", scheme="cnk", code="2"),
        event(1, 5, 9 * DAY, "a", "set", "attribute", field="x", value="before"),
        event(1, 6, 12 * DAY, None, "set", "attribute", field="x", value="parting"),
        event(1, 7, 13 * DAY, None, "set", "attribute", field="x", value="nothing"),
        event(1, 8, 13 * DAY, "a", "set", "attribute", field="x", value="gap"),
        event(1, 9, 15 * DAY, "c", "set", "attribute", field="x", value="stranger"),
    ]
    events = spark.createDataFrame(rows, EVENT)
    found = mapping.periods(events).orderBy("entity", "source", "n").collect()
    gtin = "gtin:05400000000001"
    # The codes of the 12th go in two steps of one day: the later, empty set stands for the day.
    assert [(r.source, r.from_at, r.to_at, r.codes) for r in found] == [("a", 10 * DAY, 12 * DAY, ["cnk:1", gtin]), ("a", 12 * DAY, None, []), ("b", 14 * DAY, None, ["cnk:2"])]
    listed = mapping.periods(events)
    about = {}
    for r in mapping.anchored(events.where("kind = 'attribute'"), listed).collect():
        about.setdefault(r.value.s, set()).add(r.code)
    assert about == {"before": {"cnk:1", gtin}, "parting": {"cnk:1", gtin}, "gap": {"cnk:1", gtin}}
    assert {(r.order, r.reason) for r in mapping.rejected(events, listed).collect()} == {(7, "unsourced"), (9, "source_held_no_code")}
    assert [(r.n, r.codes) for r in mapping.snapshots(events).where("source = 'a'").orderBy("n").collect()] == [(0, ["cnk:1"]), (1, ["cnk:1", gtin]), (2, [gtin]), (3, [])]
    assert golden.golden_records(events.limit(0)).variants().count() == 0


def test_primary_and_values(spark):
    held = [["gtin:02012345678901", "mpn:1"], ["acl13:1", "gtin:05400000000001"], ["pzn:1", "cnk:2", "gtin:05400000000001"], ["zz:1", "cip13:3"], ["zz:1", "mpn:2"]]
    df = spark.createDataFrame([(h,) for h in held], "h array<string>").select(mapping.primary(F.col("h")).alias("p"))
    assert [r.p for r in df.collect()] == ["gtin:02012345678901", "gtin:05400000000001", "cnk:2", "cip13:3", "mpn:2"]
    values = [("species", ("j", '["human"]')), ("weight", ("s", "0.065_kg")), ("weight", ("s", "4_stone")), ("depth", ("j", '["4.35_cm"]')), ("depth", ("i", "43")), ("x", ("j", "[1,2]")), ("hs", ("s", "859"))]
    rows = spark.createDataFrame(values, "f string, v struct<t: string, s: string>").select(mapping.attribute_value(F.col("f"), F.col("v")).alias("v"))
    assert [tuple(r.v) for r in rows.collect()] == [("s", "human"), ("i", "65"), ("s", "4_stone"), ("f", "43.5"), ("i", "43"), ("j", "[1,2]"), ("s", "859")]


def random_history(rng, n=14, days=4):
    """(day, listing, codes), a listing changing its mind now and then."""
    pool = [("cnk", str(k)) for k in range(6)] + [("gtin", f"{k:014d}") for k in range(5)] + [("mpn", str(k)) for k in range(3)]
    out = []
    for k in range(n):
        for day in sorted(rng.sample(range(days), rng.randint(1, days))):
            out.append((day, f"l{k}", sorted(rng.sample(pool, rng.randint(0, 3)))))
    return out


def pairs_of(sets):
    return {tuple(sorted((a, b))) for s in sets for a in s for b in s if a[0] == b[0] == "cnk" and a < b}


def test_folding_by_component_equals_folding_all_at_once(spark):
    rng = random.Random(4)
    for _ in range(2):
        history = random_history(rng)
        keys, held, want = timeline.Keys(), {}, []
        never = {("mpn", str(k)) for k in range(3)}
        for day in range(4):
            due = [h for h in history if h[0] == day]
            held |= {name: own for _, name, own in due}
            sets = [s for s in held.values() if s]
            if due and sets:
                list(keys.reconcile(cluster.guard(sets, never, pairs_of(sets), set(), set()), never))
                want.append((day, sorted(sorted(f"{s}:{v}" for s, v in m) for m in keys.members.values())))
        rows = [("identity", "s", name, [f"{s}:{v}" for s, v in own], None, d * DAY, n) for n, (d, name, own) in enumerate(sorted(history))]
        claims = spark.createDataFrame(rows, "kind string, source string, ref string, codes array<string>, entity string, recorded_at bigint, `order` bigint")
        for c in ("code", "field", "asset", "relation", "to"):
            claims = claims.withColumn(c, F.lit(None).cast("string"))
        told = timeline.fold_forward(claims)
        told.cache()
        for day, members in want:
            got = {}
            for r in ledger.fold(told.where(F.col("day") <= day)).collect():
                got.setdefault(r.key, []).append(r.code)
            assert sorted(sorted(x) for x in got.values()) == members
        assert [r.order for r in told.orderBy("order").collect()] == list(range(told.count()))


def test_reconcile_equals_the_plain_ledger(spark):
    rng = random.Random(9)
    keys, members = timeline.Keys(), spark.createDataFrame([], golden.MEMBERS)
    pool = [("cnk", str(k)) for k in range(7)] + [("gtin", f"{k:014d}") for k in range(7)]
    starts = None
    for _ in range(3):
        sets = [sorted(rng.sample(pool, rng.randint(1, 3))) for _ in range(8)]
        found = cluster.guard(sets, set(), pairs_of(sets), set(), set())
        list(keys.reconcile(found, set()))
        rows = [("product", f"c{k}", s, f"{s}:{v}", True) for k, own in enumerate(found) for s, v in own]
        clusters = spark.createDataFrame(rows, "lane string, cluster string, scheme string, code string, bridges boolean")
        decided = ledger.decide(clusters, members, starts)
        told = ledger.events(clusters, members, decided)
        after = ledger.members_after(clusters, members, decided)
        got = {}
        for r in after.collect():
            got.setdefault(r.key, []).append(r.code)
        assert sorted(sorted(x) for x in got.values()) == sorted(sorted(f"{s}:{v}" for s, v in m) for m in keys.members.values())
        assert len({r.key for r in told.where("type = 'minted'").collect()}) == decided.where("action = 'mint'").count()
        members = spark.createDataFrame(after.collect(), after.schema)


def test_empty_lane_is_skipped_unless_the_snapshot_is_whole(spark):
    members = spark.createDataFrame([("product", "SK_1", "cnk:1"), ("substance", "SUB_1", "cas:1")], golden.MEMBERS)
    clusters = spark.createDataFrame([("product", "c", "cnk", "cnk:1", True)], "lane string, cluster string, scheme string, code string, bridges boolean")
    told = lambda **kw: {(r.action, r.key) for r in ledger.decide(clusters, members, **kw).collect()}
    assert told() == {("keep", "SK_1")} and told(complete=True) == {("keep", "SK_1"), ("retract", "SUB_1")}
    bound = spark.createDataFrame([("product", "c", "SK_9")], "lane string, cluster string, key string")
    assert {(r.action, r.key) for r in ledger.decide(clusters, members.where("lane = 'substance'"), preferred=bound).collect()} == {("reactivate", "SK_9")}


def test_two_clocks(spark):
    claim = lambda codes, value: [("identity", codes, None, None, None), ("attribute", None, codes[0], "name", ("s", value))]
    rows = [
        ("a", "1", "r1", True, claim(["cnk:1"], "old"), "2024-01-01", None, "2024-01-01", 1),
        ("a", "1", "r2", True, claim(["cnk:1"], "future"), "2024-03-01", None, "2024-01-05", 2),
        ("b", "2", "r1", True, claim(["cnk:2"], "short"), "2024-01-01", "2024-02-01", "2024-01-01", 3),
        ("a", "1", "r3", True, claim(["cnk:1"], "corrected"), "2024-01-10", "2024-01-20", "2024-02-15", 4),
    ]
    schema = "source string, ref string, revision string, active boolean, claims array<struct<kind: string, codes: array<string>, code: string, field: string, value: struct<t: string, s: string>>>, f string, t string, r string, `order` bigint"
    revisions = spark.createDataFrame(rows, schema).select("source", "ref", "revision", "active", "claims", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"), F.to_timestamp("r").alias("recorded_at"), "order")
    text = lambda x, c: x.withField(c, F.lit(None).cast("string"))
    revisions = revisions.withColumn("claims", F.transform("claims", lambda x: text(text(text(text(x, "asset"), "relation"), "to"), "entity")))

    def at(known, effective):
        members, live = timeline.state_bitemporal(revisions, F.lit(known).cast("timestamp"), F.lit(effective).cast("date"))
        return {(r.key, r.code) for r in members.collect()}, {r.value.s for r in live.where("kind = 'attribute'").collect()}

    assert at("2024-01-06", "2024-01-15") == ({("SK_1", "cnk:1"), ("SK_2", "cnk:2")}, {"old", "short"})
    assert at("2024-03-01", "2024-01-15") == ({("SK_1", "cnk:1"), ("SK_2", "cnk:2")}, {"corrected", "short"})
    assert at("2024-03-01", "2024-03-02") == ({("SK_1", "cnk:1")}, {"future"})


def test_stewards(spark):
    members = {"SK_1": ["cnk:1", "gtin:a"], "SK_2": ["cnk:2"], "SK_10": ["mpn:x"]}
    seen = {"codes": ["gtin:a"]}
    case = steward.Case("c1", ("merge", ("SK_1", "SK_2")), steward.digest(seen), 7)
    request = {"kind": "approve_merge", "case_id": "c1", "evidence_offset": 7, "keys": ["SK_2", "SK_1"]}

    def refused(reason, *args, **kw):
        with pytest.raises(steward.Refused) as e:
            steward.decide(*args, **kw)
        assert e.value.reason == reason

    refused("actor_spoofing", request | {"by": "eve"}, "ann", case, seen, members)
    refused("wrong_offset", request | {"evidence_offset": 8}, "ann", case, seen, members)
    refused("stale", request, "ann", case, {"codes": []}, members)
    refused("duplicate_keys", request | {"keys": ["SK_1", "SK_1"]}, "ann", case, seen, members)
    refused("missing", request | {"case_id": "c2"}, "ann", case, seen, members)
    refused("case_required", {"kind": "reject_merge"}, "ann", case, seen, members)
    assert steward.decide(request, "ann", case, seen, members)[0] == "propose_merge"
    refused("four_eyes", request, "ann", case, seen, members)
    applied, events = steward.decide(request, "bob", case, seen, members)
    assert applied == "approve_merge" and [e["type"] for e in events] == ["review_case_endorsed", "claim", "merged", "members_changed", "decision"]
    assert (events[1]["code"], events[1]["to"], events[2]["into"], events[3]["codes"]) == ("cnk:1", "cnk:2", "SK_1", ["cnk:1", "cnk:2", "gtin:a"])
    refused("closed", request, "cid", case, seen, members)
    repair = steward.Case("c3", ("split", "SK_1"), steward.digest(seen), 9)
    split = {"kind": "split", "case_id": "c3", "evidence_offset": 9, "key": "SK_1", "codes": ["gtin:a"]}
    refused("empty_key", split | {"codes": ["cnk:1", "gtin:a"]}, "ann", repair, seen, members)
    refused("unowned_codes", split | {"codes": ["cnk:9"]}, "ann", repair, seen, members)
    refused("cross_lane", split | {"codes": ["gtin:a", "cas:1"]}, "ann", repair, seen, members)
    assert steward.decide(split, "ann", repair, seen, members)[0] == "propose_split"
    _, events = steward.decide(split, "bob", repair, seen, members, following=11)
    assert events[1] == {"type": "split", "key": "SK_1", "codes": ["cnk:1"], "into": [{"key": "SK_11", "codes": ["gtin:a"]}]}
    tie = steward.Case("c4", ("attr", "SK_1", "name"), steward.digest(seen), 3, (("a", "x"), ("b", "y")))
    pick = {"kind": "resolve_attribute", "case_id": "c4", "evidence_offset": 3, "key": "SK_1", "field": "name", "value": "z"}
    refused("unknown_candidate", pick, "ann", tie, seen, members)
    assert steward.decide(pick | {"value": "y"}, "ann", tie, seen, members)[1][0]["decision"] == "pick y"
    verdicts = spark.createDataFrame([("merge:SK_1+SK_2", 5, "approved"), ("code:gtin:a", 6, "shared")], "subject string, `order` bigint, decision string")
    flags = spark.createDataFrame([("merge:SK_1+SK_2", 4), ("merge:SK_1+SK_2", 8), ("attr:SK_1/x", 2), ("attr:SK_1/x", 9)], "subject string, `order` bigint")
    assert {tuple(r) for r in steward.open_items(flags, verdicts).collect()} == {("merge:SK_1+SK_2", 8), ("attr:SK_1/x", 2)}
    assert [r.code for r in steward.shared_codes(verdicts).collect()] == ["gtin:a"]


def test_registry(spark):
    document = {
        "schema_version": "1",
        "schemes": [{"name": "isbn13", "class": "identity", "bridge_grade": "national", "aliases": ["isbn"]}, {"name": "sku", "class": "external_ref", "normalizer": {"kind": "pad_left", "width": 5}}, {"name": "compound", "class": "identity", "entity_type": "substance"}],
        "relations": [{"name": "prints", "from": ["product"], "to": ["substance"]}],
    }
    found = registry.registry(document)
    df = spark.createDataFrame([("isbn", " 1 "), ("sku", "7"), ("compound", "x"), ("ean", "5400000000001")], "s string, v string")
    c = found.canonical(F.col("s"), F.col("v"))
    assert [tuple(r) for r in df.select(c["scheme"], c["value"], found.lane(F.col("s"))).collect()] == [("isbn13", "1", "product"), ("sku", "00007", "product"), ("compound", "x", "substance"), ("gtin", "05400000000001", "product")]
    assert spark.range(1).select(found.signature_ok(F.lit("prints"), F.lit("sku"), F.lit("compound"))).first()[0]
    for wrong, words in (
        ({"schema_version": "2", "schemes": []}, "unsupported"),
        ({"schema_version": "1", "schemes": [{"name": "Bad", "class": "identity"}]}, "snake_case"),
        ({"schema_version": "1", "schemes": [{"name": "a", "class": "wish"}]}, "unknown value"),
        ({"schema_version": "1", "schemes": [{"name": "a", "class": "identity", "aliases": ["x"]}, {"name": "x", "class": "identity"}]}, "more than once"),
        ({"schema_version": "1", "schemes": [{"name": "a", "class": "identity", "normalizer": {"kind": "pad_left", "width": 0}}]}, "normalizer"),
        ({"schema_version": "1", "schemes": [], "relations": [{"name": "r", "from": [], "to": None}]}, "non-empty"),
    ):
        with pytest.raises(registry.Invalid, match=words):
            registry.registry(wrong)
    named = {r.wire_name: r for r in registry.metadata(spark).collect()}
    assert (named["cipOrAcl7"].canonical_name, named["ean"].canonical_name, named["cas"].lane, named["uuid"].lane) == ("cip_acl7", "gtin", "substance", None)


def test_strict_types_and_codec(spark):
    whole = '{"schema_version":"1","source_system":"x","legacy_entity":%d,"events":[%s]}'
    good = '{"recorded_at":5,"op":"set","kind":"identity","scheme":"cnk","source":"3","code":"%s"}'
    lines = [whole % (1, good % "1"), whole % (2, good % ("1" * 161)), whole % (3, (good % "1").replace('"source":"3"', '"source":3')), whole % (4, (good % "1").replace("5", '"5"')), whole % (5, "7"), '{"schema_version":"1","legacy_entity":6}']
    rows = envelope.envelope_events(envelope.envelopes_of(spark.createDataFrame([(x,) for x in lines], "line string"))).collect()
    assert {r.entity: r.error for r in rows}.items() >= {1: None, 2: "code_too_long", 3: "bad_type source", 4: "bad_type recorded_at", 6: "missing_events"}.items()
    assert next(r.error for r in rows if r.entity == 5) is not None
    values = [("s", 'a"b'), ("i", "7"), ("f", "1.5"), ("b", "true"), ("n", ""), ("j", '["x",1]')]
    df = spark.createDataFrame([(v,) for v in values], "v struct<t: string, s: string>")
    assert [tuple(r.w) for r in df.select(envelope.decoded(envelope.encoded(F.col("v"))).alias("w")).collect()] == values


def test_store_and_writes(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one, two = store.Store(spark, path), store.Store(spark, path)
    assert one.commit({"t": spark.range(3)}) == 1
    with pytest.raises(store.Conflict):
        two.commit({"t": spark.range(5)})
    again = store.Store(spark, path)
    again.commit({}, {"t": spark.range(2)})
    assert again.read("t").count() == 5 and one.read("t").count() == 3

    def batch(*rows):
        """(kind, source, ref, codes, code, field, value, product)"""
        full = [(k, s, r, c, None, code, f, v and ("s", v), p, None, None, None, None, None, 0, None, 0, n) for n, (k, s, r, c, code, f, v, p) in enumerate(rows)]
        return spark.createDataFrame(full, ", ".join(f"`{n}` {t}" for n, t in mapping.CLAIM.items()) + ", index bigint")

    kept = store.Store(spark, f"file://{tmp_path}/claims")
    first = batch(("identity", "a", "1", ["cnk:1", "gtin:05400000000001"], None, None, None, None), ("attribute", "a", None, None, "cnk:1", "name", "x", None), ("grouping", "a", None, None, "cnk:1", None, None, 40))
    assert writes.take(kept, first, "k1") == {"accepted": 3, "skipped": 0, "compacted": 0, "replayed": False}
    assert writes.take(kept, first, "k1")["replayed"]
    with pytest.raises(writes.Refused) as e:
        writes.take(kept, first.limit(1), "k1")
    assert e.value.status == 409
    found = writes.simulate(kept, batch(("attribute", "a", None, None, "cnk:1", "name", "x", None), ("identity", "b", "2", ["cnk:2"], None, None, None, None)))
    assert (found.accepted, found.skipped) == (1, 1) and {r.key for r in found.members.collect()} == {"SK_1", "SK_2"}
    assert {(r.section, r.subject) for r in writes.report(found).collect()} == {("mint", "SK_2")}
    assert {(r.key, r.legacy_id) for r in kept.read("ids").collect()} == {("SK_1", 40)} and writes.drift(kept).count() == 0


def test_parity_documents_and_xref(spark):
    good = '{"schema_version":"1","legacy_entity":1,"identity":["cnk:1"],"attributes":{"w":859},"edges":[],"media":[],"descriptions":[]}'
    read = lambda x: parity.from_documents(spark, spark.createDataFrame([(x,)], "line string"))
    assert {tuple(r)[1:4] for r in read(good).collect()} == {("attribute", "w", "i:859"), ("identity", "cnk:1", None)}
    for bad in (good.replace('"edges":[],', ""), good.replace('"1","legacy', '"2","legacy')):
        with pytest.raises(Exception, match="snapshot"):
            read(bad).collect()
    members = spark.createDataFrame([("product", "SK_2", "gtin:1"), ("product", "SK_10", "cnk:1")], golden.MEMBERS)
    said = spark.createDataFrame([("gtin:1", 1, "a"), ("cnk:1", 1, "a"), ("gtin:1", 1, "b")], "code string, product bigint, source string")
    row = legacy.xref(members, said).first()
    assert (row.relation, row.primary, row["keys"]) == ("split", "SK_10", ["SK_2", "SK_10"])
    assert "needs review: 0" in " ".join(legacy.diff_summary(legacy.migration_diff(legacy.xref(members, said), spark.createDataFrame([], "code string, keys array<string>"))).split())


def test_policy_and_same(spark):
    context = policy.Context(field_scores={"w": {"g": 5, "3": 9}}, group_of={"1": "g"}, product_orgs=("1",), labo_orgs=("2",), system_sources=("9",), source_order=("2", "1"))
    df = spark.createDataFrame([(s,) for s in ("1", "2", "3", "9")], "source string")
    ranks = lambda c: [r[0] for r in df.select(policy.rank_of(c)(F.lit("w"), F.col("source"))).collect()]
    assert ranks(context) == [-5_000_000 + 1, 0, 1_000_000 + 999_999, 999_999]
    assert ranks(policy.replace(context, region="fr", penalty=False))[2] == -9_000_000 + 999_999
    assert spark.range(1).select(codes.same(F.lit("ean"), F.lit("5400000000001"), F.lit("gtin"), F.lit("05400000000001"))).first()[0]
