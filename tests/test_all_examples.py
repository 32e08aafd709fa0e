"""The recurrent model is learned from all training examples, whatever their number and the tasks'."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.operators import recurrent, sequence
from chronoloom.plans import results

from .test_recurrent import cycle


def apart(spark, n=26_000, first=20_000):
    """(row_id, late): ``late`` rows are none of the ``first`` by their hash."""
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.xxhash64(F.lit(0), "id").alias("h"))
    cut = sorted(r["h"] for r in rows.collect())[first]
    return rows.select("row_id", (F.col("h") >= cut).alias("late"))


def test_examples_of_late_hashes_are_learned(spark):
    event = F.when(F.col("late"), 2).otherwise(1)
    examples = apart(spark).select("row_id", F.array(*[event] * 10).alias("context"), (event + 2).alias("target"))
    weights = recurrent.train(examples, 5, rounds=1)
    told = recurrent.GatedNetwork(5).load(weights).log_probabilities(np.array([[1] * 10, [2] * 10]))
    assert told[0, 3] > np.log(0.9) and told[1, 4] > np.log(0.9)


def test_tasks_and_partitions_make_no_difference(spark):
    rows = cycle(spark)
    first = recurrent.fit(rows, 6, workers=1, rounds=2, share=400)
    for workers, parts in ((2, 1), (3, 7)):
        assert np.allclose(recurrent.fit(rows.repartition(parts), 6, workers=workers, rounds=2, share=400), first, atol=1e-8)


def test_every_example_counts_once_a_round(spark, tmp_path):
    dealt = sequence.sliding_sequences(cycle(spark, n=500), 10).select("context", "target", F.pmod("row_id", F.lit(3)).cast("int").alias("share")).orderBy("share", "context", "target")
    with open(tmp_path / "kept", "wb+") as file:
        sizes = recurrent._keep(dealt.toArrow().to_batches(70), file)
        file.seek(0)
        kept = np.frombuffer(file.read(), "<i4").reshape(-1, 11)
    want = dealt.toPandas()
    assert sizes == list(want.groupby("share").size().items())
    assert np.array_equal(kept, np.column_stack([np.stack(want["context"]), want["target"]]))


def test_native_judges_by_nodes_of_late_hashes(spark):
    """One node always says the same; forty whose rows have late hashes go through a cycle, and half of them leave it in the test period."""
    place = F.row_number().over(Window.partitionBy("late").orderBy("row_id")) - 1
    rows = apart(spark, n=34_000, first=30_000).withColumn("k", place)
    node, at = F.col("k") % 40, F.floor(F.col("k") / 40)  # a hundred events a late node
    wrong = F.col("late") & (node % 2 == 0) & (at == 95)
    said = F.when(~F.col("late"), "same").when(wrong, "p0").otherwise(F.concat(F.lit("p"), (at % 3).cast("string")))
    events = rows.select(
        "row_id", F.timestamp_seconds(F.when(F.col("late"), at * 9_000).otherwise(F.col("k") * 30)).alias("timestamp"),
        F.when(F.col("late"), F.concat(F.lit("n"), node.cast("string"))).otherwise("m").alias("node"), wrong.alias("anomaly"), said.alias("event_template"),
    )
    got = results.recurrent_native(events).first()
    assert got["n_positive_cells"] == 20 and got["auc_roc"] > 0.95
