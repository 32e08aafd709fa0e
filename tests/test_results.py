"""Result tables of all four detectors against plain numpy and pandas, from the rows to every figure."""

import numpy as np
import pandas as pd
import pytest

from chronoloom.operators import detect, windows
from chronoloom.plans import experiments as ex
from chronoloom.plans import queries as plans
from chronoloom.schema import SPARSE

from .conftest import SF

CELL = ["node", "window_idx"]


@pytest.fixture(scope="module")
def clean(spark):
    return ex.Clean.of(plans.events(spark, SF))


@pytest.fixture(scope="module", params=["stall", "burst"])
def run(request, spark, clean):
    """One fault: moved events, labelled cells, rows of all detectors, their cells and result rows."""
    moved, _, labelled = ex.injected(clean.events, request.param, clean=clean)
    cells, labelled_too = ex.all_cells(clean, request.param)
    return {
        "moved": moved, "labelled": labelled.toPandas(), "rows": ex.all_rows(clean, moved).toPandas(), "cells": cells.toPandas(),
        "labelled_too": labelled_too.toPandas(), "result": ex.result_rows(cells, labelled_too).toPandas().set_index("detector"),
    }


def plain_windows(pdf, size):
    pdf = pdf.sort_values(["node", "timestamp", "row_id"]).reset_index(drop=True)
    return pdf.assign(window_idx=pdf.groupby("node").cumcount() // size)


def plain_vectors(pdf, vocabulary):
    """(keys, labels, count matrix) of windows of consecutive events."""
    at = {t: i for i, t in enumerate(vocabulary)}
    keys, labels, x = [], [], []
    for key, g in pdf.groupby(CELL):
        v = np.zeros(SPARSE.vocabulary)
        for t in g["event_template"]:
            if t in at:
                v[at[t]] += 1
        keys.append(key)
        labels.append(bool(g["anomaly"].any()))
        x.append(v)
    return keys, np.array(labels), np.array(x)


def plain_training(clean):
    """Training windows without an anomaly as vectors, and the vocabulary."""
    pdf = clean.events.toPandas()
    us = pdf["timestamp"].astype("datetime64[us]").astype("int64")
    train = plain_windows(pdf[us <= np.quantile(us, SPARSE.train_fraction)], SPARSE.window_events)
    first = train.groupby("event_template")["row_id"].agg(["size", "min"]).sort_values(["size", "min"], ascending=[False, True])
    vocabulary = first.index[: SPARSE.vocabulary].tolist()
    _, labels, x = plain_vectors(train, vocabulary)
    return x[~labels], vocabulary


def of_rows(run, name):
    return run["rows"][run["rows"]["detector"] == name].set_index("row_id")


def test_count_pca_rows_equal_plain_singular_vectors(clean, run):
    x, vocabulary = plain_training(clean)
    mean = x.mean(0)
    axes = np.linalg.svd(x - mean, full_matrices=False)[2][: max(1, min(SPARSE.pca_components, len(x) - 1, x.shape[1]))]
    error = lambda v: np.maximum(((v - mean) ** 2).sum(1) - (((v - mean) @ axes.T) ** 2).sum(1), 0)
    limit = np.quantile(error(x), SPARSE.threshold_quantile)
    moved = plain_windows(run["moved"].toPandas(), SPARSE.window_events)
    keys, _, vectors = plain_vectors(moved, vocabulary)
    score = dict(zip(keys, error(vectors)))
    got = of_rows(run, "count_vector_pca")
    assert len(got) == len(moved)
    want = np.array([score[k] for k in zip(moved["node"], moved["window_idx"])])
    have = got.loc[moved["row_id"], "score"].to_numpy()
    assert np.allclose(have, want, rtol=1e-6, atol=1e-8)
    clear = np.abs(want - limit) > 1e-6
    assert (got.loc[moved["row_id"], "flag"].to_numpy()[clear] == (want > limit)[clear]).all() and clear.mean() > 0.9


def test_count_forest_rows_equal_a_walk_through_the_trees(spark, clean, run):
    x, vocabulary = plain_training(clean)
    train = windows.by_count(ex.training_period(clean.context, SPARSE), SPARSE.window_events)
    vocab = windows.vocabulary(train, SPARSE.vocabulary)
    assert [r["event_template"] for r in vocab.orderBy("term_id").collect()] == vocabulary
    forest = detect.IsolationForest("counts", SPARSE.trees).fit(windows.count_vectors(train, vocab, SPARSE.vocabulary).where("not label"))
    assert forest.psi == min(256, len(x)) and len(forest.forest) == SPARSE.trees

    def path(tree, v):
        at = 0
        while tree.feature[at] >= 0:
            at = tree.left[at] if v[tree.feature[at]] < tree.value[at] else tree.right[at]
        return tree.value[at]

    n = forest.psi
    norm = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    score = lambda v: 2.0 ** (-np.mean([path(t, v) for t in forest.forest]) / norm)
    limit = np.quantile([score(v) for v in x], SPARSE.threshold_quantile)
    moved = plain_windows(run["moved"].toPandas(), SPARSE.window_events)
    keys, _, vectors = plain_vectors(moved, vocabulary)
    of = {k: score(v) for k, v in zip(keys, vectors)}
    got = of_rows(run, "isolation_forest_counts")
    want = np.array([of[k] for k in zip(moved["node"], moved["window_idx"])])
    assert np.allclose(got.loc[moved["row_id"], "score"].to_numpy(), want, rtol=1e-9)
    clear = np.abs(want - limit) > 1e-9
    assert (got.loc[moved["row_id"], "flag"].to_numpy()[clear] == (want > limit)[clear]).all()


def plain_cells(rows, labelled):
    """Cells of the grid from rows: largest score, any flag, truth by label."""
    rows = rows.assign(score=rows["score"].fillna(0.0), flag=rows["flag"].fillna(False).astype(bool))
    origin = rows.groupby("node")["timestamp"].transform("min")
    rows["window_idx"] = np.floor((rows["timestamp"] - origin).dt.total_seconds() / SPARSE.grid_s).astype("int64")
    cells = rows.groupby(["detector", *CELL], as_index=False).agg(score=("score", "max"), flag=("flag", "any"))
    marked = set(map(tuple, labelled[CELL].to_numpy()))
    return cells.assign(truth=[(n, w) in marked for n, w in zip(cells["node"], cells["window_idx"])])


def test_cells_equal_plain(run):
    by = ["detector", *CELL]
    want = plain_cells(run["rows"], run["labelled"]).sort_values(by).reset_index(drop=True)
    got = run["cells"].sort_values(by).reset_index(drop=True)
    assert got[by].equals(want[by]) and (got["truth"] == want["truth"]).all() and (got["flag"] == want["flag"]).all()
    assert np.allclose(got["score"], want["score"], rtol=1e-9)
    assert set(got["detector"]) == {"z_score_threshold", "log_ratio_threshold", "count_vector_pca", "isolation_forest_counts"} and want["truth"].any()


def plain_auc(score, truth):
    """(ROC area by pairs, step average precision)."""
    pos, neg = score[truth], score[~truth]
    roc = np.mean([(pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()])
    total, recall = 0.0, 0.0
    for s in sorted(set(score), reverse=True):
        above = score >= s
        r = truth[above].sum() / truth.sum()
        total += (r - recall) * truth[above].mean()
        recall = r
    return roc, total


def test_figures_equal_plain(run):
    labelled = run["labelled_too"]
    assert len(run["result"]) == 4
    for name, c in run["cells"].groupby("detector"):
        got, t, p = run["result"].loc[name], c["truth"].to_numpy(bool), c["flag"].to_numpy(bool)
        tp, fp, fn, tn = (int(x.sum()) for x in (t & p, ~t & p, t & ~p, ~t & ~p))
        assert (got["tp"], got["fp"], got["fn"], got["tn"], got["n_cells"]) == (tp, fp, fn, tn, len(c))
        precision, recall, share = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn), (tp + fp) / len(c)
        f1 = 2 * precision * recall / (precision + recall) if tp else 0.0
        assert np.allclose([got["precision"], got["recall"], got["f1"], got["flagged_frac"]], [precision, recall, f1, share])
        assert np.isclose(got["lift"], recall / share) if share else pd.isna(got["lift"])
        roc, ap = plain_auc(c["score"].to_numpy(), t)
        assert np.allclose([got["auc_roc"], got["auc_pr"], got["no_skill_baseline"], got["auc_pr_ratio"]], [roc, ap, t.mean(), ap / t.mean()])
        flags = dict(zip(zip(c["node"], c["window_idx"]), p))
        found, chance = [], []
        for _, g in labelled.groupby("injection_id"):
            seen = [flags[k] for k in zip(g["node"], g["window_idx"]) if k in flags]
            found.append(any(seen))
            chance.append(1 - (1 - share) ** len(seen))
        assert (got["n_detected"], got["n_injections"]) == (sum(found), len(found))
        assert np.allclose([got["detection_rate"], got["expected_by_chance"]], [np.mean(found), np.mean(chance)])


def test_natively_fitted_detectors_on_several_grids_equal_plain(spark, clean):
    sizes = (43_200, SPARSE.grid_s)
    test, flags, own = ex.native_flags(clean.events)
    got = ex.on_grids(test, flags, sizes).toPandas()
    rows, marks = test.toPandas(), flags.toPandas()
    assert set(marks["detector"]) == set(own) and len(got) == 6
    for r in got.itertuples():
        flag = marks[marks["detector"] == r.detector].set_index("row_id")["flag"]
        d = rows.assign(flag=rows["row_id"].map(flag).fillna(False).astype(bool))
        at = np.floor((d["timestamp"] - d.groupby("node")["timestamp"].transform("min")).dt.total_seconds() / r.grid_size_s)
        c = d.assign(at=at).groupby(["node", "at"]).agg(t=("anomaly", "any"), p=("flag", "any"))
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(int(x.sum()) for x in (c.t & c.p, ~c.t & c.p, c.t & ~c.p, ~c.t & ~c.p))
