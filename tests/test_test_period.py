"""Next-event detectors that judge the test period alone say of it what they say when they judge all events."""

import numpy as np

from chronoloom.operators import recurrent, sequence, windows
from chronoloom.plans import experiments as ex
from chronoloom.plans import queries as plans
from chronoloom.schema import SPARSE

from .conftest import SF


def test_test_period_alone_is_judged_the_same(spark):
    e = plans.events(spark, SF)
    told = lambda d: {r["row_id"]: (round(r["score"], 9), r["flag"]) for r in d.collect()}
    whole = told(sequence.chronological_split(ex.next_event_rows(e, e), SPARSE.train_fraction).where("not is_train"))
    assert whole and told(ex.next_event_rows(e, e, test_only=True)) == whole
    split = sequence.chronological_split(e, SPARSE.train_fraction)
    vocab = windows.sorted_vocabulary(split.where("is_train and not anomaly"))
    n = vocab.count() + 1
    weights = recurrent.GatedNetwork(n, seed=4).vector()
    encoded, later = windows.encode(e, vocab), ex._asked(e, split.select("cutoff_us").limit(1), True)[1]
    every, some = told(recurrent.scores(encoded, weights, n)), told(recurrent.scores(encoded, weights, n, wanted=later))
    assert set(some) == set(whole) and all(np.isclose(every[k][0], v[0]) and every[k][1] == v[1] for k, v in some.items())
