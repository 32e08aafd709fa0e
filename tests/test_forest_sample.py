"""The rows that an isolation forest is built from."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from chronoloom.operators import detect


@pytest.mark.parametrize("dense", [False, True])
def test_a_forest_draws_the_rows_of_smallest_hash_without_a_full_share_of_every_task(spark, monkeypatch, dense):
    rows = spark.range(6000, numPartitions=12).withColumnRenamed("id", "row_id").withColumns({"x": F.col("row_id") % 7 * 1.0, "y": F.col("row_id") * 1.0})
    forest = detect.IsolationForest(["x", "y"] if dense else "v", trees=4, sample=8)
    train = rows if dense else rows.withColumn("v", array_to_vector(F.array("x", F.lit(0.0), "y")))
    sorted_rows, order = [], type(rows).orderBy
    monkeypatch.setattr(type(rows), "orderBy", lambda self, *c: sorted_rows.append(self.count()) or order(self, *c))
    got = forest._sampled(train)
    assert sorted_rows[0] < 6 * 32  # 32 are wanted; before, each of the 12 tasks handed in 32
    ids = [r["row_id"] for r in rows.select("row_id", F.xxhash64(F.lit(0), "row_id").alias("h")).collect()]
    h = {r["row_id"]: r["h"] for r in rows.select("row_id", F.xxhash64(F.lit(0), "row_id").alias("h")).collect()}
    want = sorted(ids, key=lambda i: h[i])[:32]
    assert got.tolist() == [[i % 7, i] if dense else [i % 7, 0, i] for i in want]
