import pytest
from pyspark.sql import functions as F

from loomline.llm import rules


@pytest.mark.parametrize("junk", [12, 30, 45])
def test_a_group_full_of_junk_keeps_its_limit(spark, junk):
    """1,200 clean texts in other groups of the language, and a group of 400 with ``junk`` percent symbol junk."""
    k = F.col("id")
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("word"), (i * 37 + k).cast("string"))), " ")
    own = k < 400
    bad = own & (k % 100 < junk)
    docs = spark.range(1600).select(k.alias("doc_id"), F.when(bad, F.concat(words, F.lit(" " + "#$%&" * 30))).otherwise(words).alias("text"), F.lit("en").alias("lang"), F.when(own, "a").otherwise("b").alias("source"))
    kept = {r.doc_id for r in rules.keep(docs).select("doc_id").collect()}
    assert kept == {i for i in range(1600) if not (i < 400 and i % 100 < junk)}
