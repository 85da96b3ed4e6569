import random

from loomline.operators import cluster

SAME = {(("cnk", "1"), ("cnk", "2"))}


def both_ways(sets, **kw):
    kw = {"shared": set(), "allowed": set(), "distinct": set(), "same": set()} | kw
    found = cluster.guard(sets, **kw)
    assert cluster.guard(sets[::-1], **kw) == found
    return found


def test_shared_code_joins_two_sources():
    assert both_ways([[("cnk", "1"), ("gtin", "a")], [("cnk", "1"), ("mpn", "b")]]) == [[("cnk", "1"), ("gtin", "a"), ("mpn", "b")]]


def test_one_barcode_two_national_codes_is_held_unless_a_steward_says_same():
    sets = [[("cnk", "1"), ("gtin", "a")], [("cnk", "2"), ("gtin", "a")]]
    assert len(both_ways(sets)) == 2
    assert len(both_ways(sets, same=SAME)) == 1
    assert len(both_ways(sets, same=SAME, distinct=SAME)) == 2


def test_a_barcode_alone_does_not_join_sets_that_stand_alone():
    assert len(both_ways([[("mpn", "x"), ("gtin", "a")], [("fred", "y"), ("gtin", "a")]])) == 2
    assert len(both_ways([[("mpn", "x"), ("gtin", "a")], [("gtin", "a"), ("acl13", "b")]])) == 1


def test_codes_of_one_listing_are_aliases(spark):
    rows = [("l1", "cnk", "1"), ("l1", "cnk", "2"), ("l2", "cnk", "1"), ("l2", "gtin", "a"), ("l3", "cnk", "2"), ("l3", "gtin", "b")]
    got = cluster.guarded(spark.createDataFrame(rows, "listing string, scheme string, value string")).collect()
    assert len({(r.component, r.cluster) for r in got}) == 1 and len(got) == 4


def test_guard_by_component_equals_guard_over_all(spark):
    rng = random.Random(3)
    rows = [(f"l{i}", s, v) for i in range(60) for s, v in {(rng.choice(("cnk", "gtin", "mpn", "acl13")), str(rng.randrange(25))) for _ in range(rng.randint(1, 3))}]
    sets = {}
    for name, s, v in rows:
        sets.setdefault(name, []).append((s, v))
    allowed = {tuple(sorted((a, b))) for own in sets.values() for a in own for b in own if a[0] == b[0] == "cnk" and a < b}
    want = cluster.guard(list(sets.values()), set(), allowed, set(), set())
    got = {}
    for r in cluster.guarded(spark.createDataFrame(rows, "listing string, scheme string, value string")).collect():
        got.setdefault((r.component, r.cluster), []).append((r.scheme, r.value))
    assert sorted(sorted(x) for x in got.values()) == want
