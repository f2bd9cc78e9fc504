"""The bounds of the classifier's sample."""

from pyspark.sql import functions as F

from rampwise.llm import quality


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Model, "train", lambda self, rows: seen.append([x.shape[0] for x, _ in rows]) or self)
    docs = spark.createDataFrame([(i % 40, "w" * (3000 if i % 40 else 200_000)) for i in range(200)] + [(k, f"other {k}") for k in range(5)] + [(6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality.fit(docs, labels)
    quality.fit(docs, labels, sample_bytes=30_000)
    quality.fit(docs, labels, sample=7)
    quality.fit(docs, labels, usable=F.col("doc_id") < 0)
    assert len(seen[0]) == 46 and sum(seen[1]) * 1000 <= 33_000 and 5 <= len(seen[1]) < 40 and len(seen[2]) == 7 and len(seen) == 3
