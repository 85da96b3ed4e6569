import random

from pyspark.sql import functions as F

from loomline import session
from loomline.operators import timeline


def test_days_without_codes_are_found_in_one_pass_over_the_days(spark):
    rng = random.Random(1)
    rows = [("product", f"l{k}", d, d + rng.randint(1, 2) if k % 20 else None) for k, d in enumerate(sorted(rng.sample(range(400), 60), reverse=True))]
    change = spark.createDataFrame([r if r[3] else (*r[:3], r[2] + 3) for r in rows], "lane string, listing string, day int, until int")
    found = timeline.empty_days(change)
    held = {d for _, _, a, b in change.collect() for d in range(a, b)}
    ends = {b for _, _, _, b in change.collect()}
    want = {(e, min((d for d in held if d > e), default=None)) for e in ends if e not in held}
    assert {(v.day, v.again) for v in found.first().voids} == want and len(want) > 5
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()  # such a frame is folded anew for each day


def test_groups_of_a_small_table_are_folded_by_many_tasks_each_whole(spark):
    rows = spark.range(4000).select((F.col("id") % 50).cast("string").alias("k"), "id")
    got = session.folded(rows, "k", lambda key, own: [(key, len(own), sum(r[1] for r in own), {r[0] for r in own} == {key})], "k string, n bigint, total bigint, alone boolean")
    assert {tuple(r) for r in got.collect()} == {(str(k), 80, sum(range(k, 4000, 50)), True) for k in range(50)}
    assert got.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 2
    assert session.folded(rows.limit(0), "k", lambda key, own: [], "k string").count() == 0
