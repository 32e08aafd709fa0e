"""The gated network: gradients, training in step, and its likelihood beside the back-off model's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import detect, recurrent, sequence, windows
from chronoloom.plans import queries as plans

from .conftest import SF


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(3)
    net = recurrent.GatedNetwork(7, embedding=4, hidden=5, seed=1)
    context, target = rng.integers(0, 7, (6, 4)), rng.integers(0, 7, 6)
    v = net.vector()
    loss, g = net.gradient(context, target)
    assert np.isclose(loss, -net.log_probabilities(context)[np.arange(6), target].mean())
    for i in rng.choice(len(v), 120, replace=False):
        d = np.zeros(len(v))
        d[i] = 1e-6
        up, down = (net.load(v + s * d).gradient(context, target)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-7


def cycle(spark, n=1500, noise=0.1):
    """Two nodes that go through a cycle of five events, every other time backwards, with some noise."""
    rng = np.random.default_rng(0)
    ids = [1 + (k % 5 if (k // 5) % 2 else 4 - k % 5) for k in range(n)]
    ids = [int(rng.integers(1, 6)) if rng.random() < noise else i for i in ids]
    rows = [(k, k // 2, "ab"[k % 2], i) for k, i in enumerate(x for x in ids for _ in range(2))]
    return spark.createDataFrame(rows, "row_id long, t long, node string, template_id int").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")


@pytest.mark.parametrize("workers", [1, 2])
def test_training_in_step_learns_the_order(spark, workers):
    rows = cycle(spark)
    train, test = rows.where("row_id < 2000"), rows.where("row_id >= 2000")
    weights = recurrent.fit(train, 6, workers=workers, rounds=4)
    got = recurrent.scores(test, weights, 6, top_k=1).where("score > 0").toPandas()
    assert len(got) == test.count() - 20
    assert got["score"].mean() < 0.9 < np.log(5) and got["flag"].mean() < 0.25


def test_likelihood_of_held_out_events_beats_back_off(spark):
    events = plans.events(spark, SF)
    split = sequence.chronological_split(events, 0.7)
    train = split.where("is_train").drop("is_train", "cutoff_us")
    vocab = windows.sorted_vocabulary(train)
    seen, test = (windows.encode(d, vocab) for d in (train, split.where("not is_train").drop("is_train", "cutoff_us")))
    n = vocab.count()
    weights = recurrent.fit(seen, n + 1, rounds=3)
    nll = lambda d: d.where("score > 0").agg(F.avg("score")).first()[0]
    own = nll(recurrent.scores(test, weights, n + 1))
    assert own < nll(detect.next_event_scores(test, detect.next_event_counts(seen, 10), n))


def test_short_and_empty_sequences(spark):
    rows = cycle(spark).where("row_id < 10")
    weights = recurrent.GatedNetwork(6).vector()
    got = recurrent.scores(rows, weights, 6).collect()
    assert len(got) == 10 and all(r["score"] == 0 and not r["flag"] for r in got)
    assert np.allclose(recurrent.fit(rows, 6, rounds=1), weights)  # no example: the weights that it starts with
