"""Taking batches into a store: what changes nothing is not folded, and a timeline's claims are those of the whole fold."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import golden, ledger, mapping, timeline, writes
from loomline.plans import fold
from loomline.session import stored
from loomline.sources import store

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def placed(spark):
    rows = stored(fold.events(spark, SMALL).where("entity < 24"))
    return rows, mapping.placed_claims(rows, stored(mapping.periods(rows)))


def test_a_batch_sent_again_is_not_folded(spark, placed, tmp_path, monkeypatch):
    batch = placed[1].drop("place").withColumnRenamed("order", "index")
    kept = store.Store(spark, str(tmp_path))
    first = writes.take(kept, batch, compact=True)
    monkeypatch.setattr(golden, "ingest", None)
    again = writes.take(kept, batch, compact=True)
    assert first["accepted"] and again == {**first, "accepted": 0, "skipped": first["accepted"]} and kept.number == 1
    assert writes.drift(kept).isEmpty()


def test_drift_tells_both_sides(spark, placed, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    writes.take(kept, placed[1].drop("place").withColumnRenamed("order", "index"), compact=True)
    own = kept.read("members")
    kept.commit({"members": own.where("code <> 'gtin:05400000000003'").union(own.limit(1).withColumn("code", F.lit("x:1")))})
    assert {tuple(r) for r in writes.drift(kept).collect()} == {("members", "stored", 1), ("members", "folded", own.where("code = 'gtin:05400000000003'").count())}


def test_changing_rows_are_those_that_winnowing_keeps(spark, placed):
    live = mapping.live(placed[1].drop("place")).withColumn("value", F.when(F.col("order") % 3 > 0, F.col("value")))
    rows = stored(writes.compacted(placed[1].drop("place").withColumnRenamed("order", "index")))
    told = lambda df: sorted(map(repr, df.select("slot", "index", "kind", "code", "value").collect()))
    assert told(writes.changing(rows, live)) == told(writes.winnowed(rows, live)) and 0 < len(told(writes.changing(rows, live))) < rows.count()
    assert told(writes.changing(rows, None)) == told(writes.winnowed(rows, None))


def test_claims_of_some_entities_are_those_with_their_places(spark, placed):
    rows, whole = placed
    part = rows.where("entity % 3 = 0")
    want = mapping.claims(part, stored(mapping.periods(part))).drop("order")
    got = whole.where("place.entity % 3 = 0").orderBy("order").select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count()


def test_the_timeline_folds_identity_claims_alone(spark, placed, monkeypatch):
    rows, whole = placed
    media = rows.limit(2).withColumns({"kind": F.lit("media"), "op": F.lit("add"), "scheme": F.lit(None).cast("string"), "collection": F.lit("media"), "value": F.struct(F.lit("i").alias("t"), F.lit("77").alias("s"))})
    more = stored(rows.unionByName(media))
    want = mapping.claims(more, stored(mapping.periods(more))).where("kind = 'identity'").orderBy("order").drop("order").collect()
    monkeypatch.setattr(ledger, "decide", None)
    got = golden.identity_claims(more)
    assert got.orderBy("order").drop("order").collect() == want and any(r.entity == "media" for r in want)
    assert timeline.fold_forward(got).where("lane = 'media'").count()
