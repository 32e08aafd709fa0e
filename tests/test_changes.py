"""Runs that differ from the clean table in few cells, against runs over the whole table."""

import numpy as np
import pytest

from chronoloom.operators import detect, evaluate, inject
from chronoloom.plans import experiments as ex
from chronoloom.plans import queries as plans
from chronoloom.schema import SPARSE

from .conftest import SF


@pytest.fixture(scope="module")
def clean(spark):
    return ex.Clean.of(plans.events(spark, SF))


@pytest.mark.parametrize("kind", ["stall", "burst"])
def test_cells_of_planned_nodes_and_clean_ones_equal_those_of_the_whole_table(clean, kind):
    moved, _, labelled = ex.injected(clean.events, kind, seed=5, clean=clean)
    whole = evaluate.with_cell_truth(ex.long_form(ex._cells(clean, ex.wide_rows(clean, moved, ex.ALL), ex.ALL), ex.ALL, "node", "window_idx"), labelled)
    by = ["detector", "node", "window_idx"]
    want, got = (d.toPandas().sort_values(by).reset_index(drop=True) for d in (whole, ex.all_cells(clean, kind, 5)[0]))
    columns = [*by, "truth", "flag"]
    assert want["truth"].any() and got[columns].equals(want[columns]) and np.allclose(got["score"], want["score"], rtol=1e-12)


def test_all_seeds_take_one_fit_and_equal_single_runs(spark, clean, monkeypatch):
    fits, fit = [], detect.IsolationForest.fit
    monkeypatch.setattr(detect.IsolationForest, "fit", lambda self, train: fits.append(1) or fit(self, train))
    seeds, key = (42, 7), ["fault_type", "seed", "detector"]
    got = ex.multi_seed(clean.events, ("stall", "burst"), seeds, all_detectors=True).toPandas().sort_values(key).reset_index(drop=True)
    assert len(fits) == 1 and len(got) == 16
    for (kind, seed), one in got.groupby(["fault_type", "seed"]):
        want = evaluate.auc(ex.all_cells(clean, kind, int(seed))[0], ["detector"]).toPandas().sort_values("detector").reset_index(drop=True)
        columns = ["detector", "n_eval_cells", "n_positive_cells"]
        assert one.reset_index(drop=True)[columns].equals(want[columns])
        figures = ["auc_roc", "auc_pr", "no_skill_baseline", "auc_pr_ratio"]
        assert np.allclose(one[figures], want[figures], rtol=1e-12)


def test_changed_figures_of_a_run_without_changes_and_of_ties(spark):
    cells = spark.createDataFrame([("d", i, float(i % 3), i % 2 == 0) for i in range(12)], "detector string, i int, score double, flag boolean")
    runs = spark.createDataFrame([(1,), (2,)], "run int")
    new = [(1, "d", 1.0, True, True, 1), (1, "d", 9.0, True, False, 1), (1, "d", 1.0, False, False, -1), (1, "d", 1.0, False, False, 1), (1, "d", 1.0, False, True, -1)]
    changes = spark.createDataFrame(new, "run int, detector string, score double, truth boolean, flag boolean, weight int")
    got = {r["run"]: r for r in evaluate.changed_auc(cells, changes, runs, ["detector"]).collect()}
    neg, pos = [0.0] * 4 + [1.0] * 3 + [2.0] * 4, [1.0, 9.0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert np.isclose(got[1]["auc_roc"], want) and np.isclose(got[1]["auc_pr"], 0.5 * 1 + 0.5 * 2 / 9) and got[1]["n_eval_cells"] == 13
    assert got[2]["auc_roc"] is None and got[2]["auc_pr"] is None and (got[2]["n_eval_cells"], got[2]["n_positive_cells"]) == (12, 0)
    figures = {r["run"]: r for r in evaluate.changed_confusion(cells, changes, runs, ["detector"]).collect()}
    assert [figures[1][k] for k in ("tp", "fp", "fn", "tn", "n_cells")] == [1, 5, 1, 6, 13]
    assert [figures[2][k] for k in ("tp", "fp", "fn", "tn", "n_cells")] == [0, 6, 0, 6, 12]


def test_plans_of_several_seeds_equal_single_plans(clean):
    for kind in ("stall", "burst"):
        key = lambda d: sorted(map(tuple, d.select("seed", "injection_id", "node", "start_pos", "burst_length", "intensity").collect()))
        both = key(inject.plans_by_hash(clean.context, clean.nodes, clean.pooled, kind, SPARSE, (1, 2), clean.sizes))
        assert both == sorted(key(inject.plan_by_hash(clean.context, clean.nodes, clean.pooled, kind, SPARSE, 1)) + key(inject.plan_by_hash(clean.context, clean.nodes, clean.pooled, kind, SPARSE, 2)))
