from loomline.llm import simhash


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    a, b = "a b c d e f", "p q r s t u v w"
    rows = [(None, a), (None, a), (1, b), (1, b), (3, "one two"), (1, "one two"), (None, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, a), (1, b), (1, "one two"), (None, "")], key=repr)
