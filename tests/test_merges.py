from loomline.operators import stewardship


def test_four_eyes_survivor_and_evidence(spark):
    proposals = spark.createDataFrame([(1, "SK_2"), (1, "SK_10"), (2, "SK_3"), (2, "SK_4")], "subject int, key string")
    votes = spark.createDataFrame([(1, "ann"), (1, "bo"), (2, "ann"), (2, "ann"), (2, None)], "subject int, actor string")
    members = spark.createDataFrame([("SK_2", "cnk", "a"), ("SK_10", "cnk", "b"), ("SK_2", "gtin", "x"), ("SK_10", "gtin", "y"), ("SK_2", "pzn", "p"), ("SK_10", "pzn", "p"), ("SK_3", "cnk", "c")], "key string, scheme string, code string")
    merges = stewardship.approved_merges(proposals, votes)
    assert sorted(map(tuple, merges.select("subject", "key", "survivor").collect())) == [(1, "SK_10", "SK_10"), (1, "SK_2", "SK_10")]
    after = sorted(map(tuple, stewardship.members_after(members, merges).collect()))
    assert after == [("SK_10", "cnk", "a"), ("SK_10", "cnk", "b"), ("SK_10", "gtin", "x"), ("SK_10", "gtin", "y"), ("SK_10", "pzn", "p"), ("SK_3", "cnk", "c")]
    same = sorted(map(tuple, stewardship.same_evidence(members, merges).collect()))
    assert same == [(1, "cnk", "SK_10", "b"), (1, "cnk", "SK_2", "a")]


def test_no_votes(spark):
    proposals = spark.createDataFrame([(1, "SK_2")], "subject int, key string")
    assert stewardship.approved_merges(proposals, spark.createDataFrame([], "subject int, actor string")).count() == 0
