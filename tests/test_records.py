import datetime

from loomline.operators import records

REQUEST = f"source string, ref string, seq bigint, operation string, revision string, base_revision string, valid_from date, valid_to date, claims array<{records.CLAIM}>, removed array<string>"
DAY = datetime.date(2026, 1, 1)
ID = ("identity", "identity", ["cnk:1"], None)


def attribute(name, value="v"):
    return (name, "attribute", None, value)


def answers(spark, *requests):
    rows = [("s", "r", k, op, rev, base, *more) for k, (op, rev, base, *more) in enumerate(requests)]
    got = records.revise(spark.createDataFrame(rows, REQUEST)).orderBy("seq").collect()
    return [(r.status, r.outcome, r.active, r.slots) for r in got]


def test_lifecycle_replay_and_gates(spark):
    first = ("replace", "1", None, DAY, None, [ID, attribute("a")], [])
    both = ["a", "identity"]
    assert answers(
        spark,
        ("patch", "0", None, DAY, None, [ID], []),
        ("replace", "0", "x", DAY, None, [ID], []),
        first,
        first,
        ("replace", "1", None, DAY, None, [ID], []),
        ("patch", "2", "0", DAY, None, [attribute("b")], []),
        ("patch", "2", "1", DAY, None, [attribute("b")], ["a"]),
        ("reactivate", "3", "2", DAY, None, [ID], []),
        ("withdraw", "3", "2", DAY, None, [attribute("b")], []),
        ("withdraw", "3", "2", DAY, None, [], None),
        ("replace", "4", "3", DAY, None, [ID], []),
        ("reactivate", "4", "3", DAY, None, [ID], []),
    ) == [
        (409, "refused", False, []), (412, "refused", False, []), (200, "revised", True, both), (200, "replay", True, both), (409, "refused", True, both), (412, "refused", True, both),
        (200, "revised", True, ["b", "identity"]), (409, "refused", True, ["b", "identity"]), (422, "refused", True, ["b", "identity"]), (200, "revised", False, ["b", "identity"]),
        (409, "refused", False, ["b", "identity"]), (200, "revised", True, ["identity"]),
    ]


def test_wrong_requests(spark):
    wrong = [("replace", "1", None, DAY, DAY, [ID], []), ("replace", "1", None, None, None, [ID], []), ("replace", " ", None, DAY, None, [ID], []), ("replace", "1", None, DAY, None, [attribute("a")], []),
             ("replace", "1", None, DAY, None, [("identity", "identity", [], None)], []), ("replace", "1", None, DAY, None, None, None)]
    assert answers(spark, *wrong) == [(422, "refused", False, [])] * 6


def test_no_requests(spark):
    assert answers(spark) == []
