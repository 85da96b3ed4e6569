from loomline.operators import cluster


def test_sets_that_nothing_refuses_are_not_folded_though_a_listing_joins_two_hubs(spark, monkeypatch):
    monkeypatch.setattr(cluster, "LARGE", 50)
    rows = [(f"l{i}", s, v) for i in range(400) for s, v in (("gtin", str(i % 100)), ("cnk", str(i % 3)))] + [(f"b{i}", "gtin", str(i)) for i in range(100)]
    rows += [("both", "cnk", "0"), ("both", "cnk", "1")]
    seen = []
    whole = cluster.folded
    monkeypatch.setattr(cluster, "folded", lambda rows, *rest: (seen.append(rows.count()), whole(rows, *rest))[1])
    got = {}
    for r in cluster.guarded(spark.createDataFrame(rows, "listing string, scheme string, value string")).collect():
        got.setdefault((r.component, r.cluster), []).append((r.scheme, r.value))
    sets = {}
    for name, s, v in rows:
        sets.setdefault(name, []).append((s, v))
    want = cluster.guard(list(sets.values()), set(), {(("cnk", "0"), ("cnk", "1"))}, set(), set())
    assert sorted(sorted(x) for x in got.values()) == want and len(want) == 2 and max(seen) < 10


def test_listings_of_many_rows_are_one_set(spark):
    rows = [(name, "mpn", f"{name}{k % 40}") for name in ("a", "b") for k in range(90)] + [("a", "gtin", "1"), ("b", "gtin", "2"), ("c", "gtin", "1"), (None, "mpn", "n")]
    got = {}
    for r in cluster.guarded(spark.createDataFrame(rows, "listing string, scheme string, value string")).collect():
        got.setdefault((r.component, r.cluster), []).append((r.scheme, r.value))
    sets = {}
    for name, s, v in rows:
        sets.setdefault(name, set()).add((s, v))
    assert sorted(sorted(x) for x in got.values()) == cluster.guard([list(x) for x in sets.values()], set(), set(), set(), set())
