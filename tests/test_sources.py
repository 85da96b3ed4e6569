import json

from loomline.sources import envelope, log


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def lines(spark, *docs):
    return spark.createDataFrame([(json.dumps(x),) for x in docs], "line string")


def delta(events, **more):
    return {"id": 1, "tag": None, "entity": 9, "events": events, "created_at": 100, "created_by": 4} | more


def test_values_keep_their_type(spark):
    events = [["1", "a", 859], ["1", "a", "859"], ["1", "a", 1.5], ["1", "a", 1.0], ["1", "a", True], ["1", "a", None], ["1", "a", [1, 2]]]
    got = envelope.decode(envelope.deltas_of(lines(spark, delta(events)))).orderBy("at")
    assert [(r["value"]["t"], r["value"]["s"]) for r in rows(got)][:3] == [("i", "859"), ("s", "859"), ("f", "1.5")]
    assert [r["value"]["t"] for r in rows(got)][3:] == ["f", "b", "n", "j"]


def test_clear_delete_and_recompute(spark):
    events = [["1", "eanGtin14:1034", None], ["4", "eanGtin13", 1034], ["update_sources", "x", 1], ["1", "legacyId", 3], ["2", "publicCategories:7", 5], ["1", "name:fr:12", "N"]]
    got = rows(envelope.decode(envelope.deltas_of(lines(spark, delta(events)))).orderBy("at"))
    assert [(r["op"], r["kind"], r["source"], r["scheme"], r["code"], r["collection"], r["field"], r["locale"]) for r in got] == [
        ("set", "identity", "1034", "eanGtin14", None, None, None, None),
        ("delete", "identity", "1034", "eanGtin13", None, None, None, None),
        ("add", "edge", "7", None, None, "publicCategories", None, None),
        ("set", "attribute", "12", None, None, None, "name", "fr"),
    ]


def test_touch_only_deltas_count_and_bump(spark):
    docs = [delta([["1", "cnk:1", "5"]]), delta([["1", "updatedAt", 900]], id=2), delta([["1", "updatedAt", "999"]], id=3), delta([], id=4, entity=10)]
    got = rows(envelope.touched(envelope.deltas_of(lines(spark, *docs))).orderBy("entity"))
    assert got == [{"entity": 9, "last_touched_at": 900, "dropped_meta_count": 2}, {"entity": 10, "last_touched_at": 100, "dropped_meta_count": 1}]


def test_snapshot_and_csv_become_deltas(spark, tmp_path):
    shot = {"entity": 9, "at": 50, "sources": {"12": {"fields": {"name:fr": "N", "cnk": "cnk_77"}, "collections": {"brands": [3, 4]}}}}
    got = envelope.decode(envelope.snapshot_deltas(lines(spark, shot))).orderBy("at")
    assert [(r["op"], r["kind"], r["source"], r["code"], r["value"] and r["value"]["s"]) for r in rows(got)] == [("set", "attribute", "12", None, "N"), ("set", "identity", "12", "77", None), ("add", "edge", "12", None, "3"), ("add", "edge", "12", None, "4")]
    (tmp_path / "d.csv").write_text('id,tag,entity,events,created_at,created_by\n1,,9,"[[""1"",""cnk:2"",""8""]]",5,6\n')
    assert [(r["entity"], r["source"], r["code"]) for r in rows(envelope.decode(envelope.csv_deltas(spark, str(tmp_path))))] == [(9, "2", "8")]


def test_envelope_files_are_taken_whole_or_not(spark, tmp_path):
    good = {"schema_version": "1", "source_system": "x", "legacy_entity": 1, "events": [{"recorded_at": 5, "op": "set", "kind": "identity", "scheme": "cnk", "code": "1"}]}
    bad = good | {"legacy_entity": 2, "events": [*good["events"], {"recorded_at": 5, "op": "set", "kind": "attribute"}]}
    for name, doc in (("a", good), ("b", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    events = envelope.envelope_events(envelope.read_envelopes(spark, str(tmp_path)))
    assert {(r["entity"], r["error"]) for r in rows(events)} == {(1, None), (2, None), (2, "missing_field")}
    assert [(r["entity"], r["valid_from"]) for r in rows(envelope.accepted(events))] == [(1, 5)]


def test_own_identity_comes_first(spark):
    events = envelope.decode(envelope.deltas_of(lines(spark, delta([["1", "name", "N"]]))))
    got = rows(envelope.with_own_identity(events, "text_id", "x").orderBy("recorded_at", "delta", "at"))
    assert [(r["kind"], r["scheme"], r["code"], r["at"]) for r in got] == [("identity", "text_id", "9", -1), ("attribute", None, None, 0)]


def test_log_is_gapless_and_a_retried_batch_does_not_double(spark, tmp_path):
    path = str(tmp_path / "log")
    part = lambda a, b: spark.range(a, b).selectExpr("id", "sha2(cast(id as string), 256) AS fingerprint")
    for number, (a, b) in enumerate(((0, 100), (100, 100), (100, 350))):
        log.append(spark, path, part(a, b), number, ["id"])
    log.append(spark, path, part(100, 350), 2, ["id"])
    held = spark.read.parquet(path)
    assert [(r.id, r.offset) for r in log.since(held, -1).collect()] == [(k, k) for k in range(350)]
    assert [r.offset for r in log.since(held, 97, 5).collect()] == [98, 99, 100, 101, 102]
    assert sorted(r.id for r in log.unseen(part(340, 360).union(part(355, 360)), held, "fingerprint").collect()) == list(range(350, 360))
