import json

import pytest

from loomline.sources import trade


def dump(spark, member, *records):
    return spark.createDataFrame([(json.dumps({"about": "x", member: list(records)}),)], "line string")


def claimed(spark, feed, *records):
    got = trade.claims(trade.records(dump(spark, feed.member, *records), feed), feed).collect()
    return [(r.kind, r.ref, r.codes, r.code, r.product, r.field, tuple(r.value) if r.value else None) for r in got]


def test_ten_and_thirteen_digits_meet_in_one_code(spark):
    own = claimed(spark, trade.CATALOGUE, {"id": 7, "isbn": "0-8044-2957-x", "title": "A", "pages": 240, "binding": None})
    code = "isbn13:9780804429573"
    assert own == [("identity", "librex-7", [code], None, None, None, None), ("grouping", "librex-7", None, code, 7, None, None), ("attribute", "librex-7", None, code, None, "title", ("s", "A")), ("attribute", "librex-7", None, code, None, "pages", ("i", "240"))]
    feed = claimed(spark, trade.ITEMS, {"sku": "B", "isbns": ["978-0-8044-2957-3", "979-10-90636-07-1"], "title": False, "imprint": "I"})
    assert feed == [("identity", "B", [code, "isbn13:9791090636071"], None, None, None, None), ("attribute", "B", None, code, None, "imprint", ("s", "I"))]


@pytest.mark.parametrize("isbns", [["978-0-8044-2957-4"], [], None, [None], ["12"]])
def test_bad_isbns_fail_the_job(spark, isbns):
    with pytest.raises(Exception, match="ISBN"):
        claimed(spark, trade.ITEMS, {"sku": "B", "isbns": isbns})


def test_a_dump_without_records(spark):
    assert claimed(spark, trade.CATALOGUE) == []
