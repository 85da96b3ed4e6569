import random

import pytest

from loomline.operators import cluster


@pytest.mark.parametrize("seed", [3, 4])
def test_large_components_are_clustered_as_small_ones_are(spark, monkeypatch, seed):
    monkeypatch.setattr(cluster, "LARGE", 3)
    rng = random.Random(seed)
    rows = [(f"l{i}", s, v) for i in range(90) for s, v in {(rng.choice(("cnk", "gtin", "gtin", "mpn", "acl13", "fred")), str(rng.randrange(22))) for _ in range(rng.randint(1, 3))}]
    never = {("mpn", str(k)) for k in range(22)}
    sets = {}
    for name, s, v in rows:
        sets.setdefault(name, []).append((s, v))
    allowed = {tuple(sorted((a, b))) for own in sets.values() for a in own for b in own if a[0] == b[0] and a[0] in ("cnk", "fred") and a < b}
    want = cluster.guard(list(sets.values()), never, allowed, set(), set())
    got = {}
    shared = spark.createDataFrame(sorted(never), "scheme string, value string")
    for r in cluster.guarded(spark.createDataFrame(rows, "listing string, scheme string, value string"), shared).collect():
        got.setdefault((r.component, r.cluster), []).append((r.scheme, r.value))
    assert sorted(sorted(x) for x in got.values()) == want and len(want) > 10


def test_a_large_component_is_not_folded_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(cluster, "LARGE", 50)
    rows = [(f"l{i}", s, v) for i in range(400) for s, v in (("gtin", str(i % 100)), ("cnk", str(i % 3)))] + [(f"b{i}", "gtin", str(i)) for i in range(100)]
    seen = []
    whole = cluster.folded
    monkeypatch.setattr(cluster, "folded", lambda rows, *rest: (seen.append(rows.count()), whole(rows, *rest))[1])
    found = cluster.guarded(spark.createDataFrame(rows, "listing string, scheme string, value string")).collect()
    assert len({(r.component, r.cluster) for r in found}) == 3 and max(seen) == 0
