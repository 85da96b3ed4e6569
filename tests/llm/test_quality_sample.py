from loomline.llm import quality


def test_the_sample_has_texts_of_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 40_000)
    rows = [(k, ("long " if k % 2 else "tiny ") * (200 if k % 2 else 2)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.extend(zip(texts, labels, strict=True)))
    quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, quality int"))
    long = [t for t, y in seen if y]
    assert sum(len(t) for t, _ in seen) == 40_000 and long and len(seen) - len(long) < 80
    assert abs(len(long) - len(seen) / 2) < len(seen) / 4
