"""Rounds that join what the round before wrote."""

from pyspark.sql import functions as F

from waymark.operators.graph import checkpoint


def test_estimated_sizes_do_not_grow_with_rounds(spark):
    rows = spark.range(4)
    for _ in range(7):
        rows = checkpoint(rows.join(rows.select(F.col("id").alias("other")), F.col("id") == F.col("other")).select("id"))
        assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
    assert sorted(r["id"] for r in rows.collect()) == [0, 1, 2, 3]
