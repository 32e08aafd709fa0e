"""Long nodes in blocks, the EWMA scan and medians of every key, against pandas and DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import ordered, quantile
from chronoloom.operators import baseline, detect, features, inject, sequence, windows
from chronoloom.schema import SYSTEM_LOG
from chronoloom.sources import events as ev

from .conftest import SF


def skewed(spark, n=6000, nodes=20, seed=4):
    """Events of which a third are on one node, with ties in time and a null node."""
    rng = np.random.default_rng(seed)
    node = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, nodes, n).astype(str)).astype(object)
    node[rng.random(n) < 0.02] = None
    return spark.createDataFrame(
        pd.DataFrame({
            "row_id": rng.permutation(n), "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, n // 2, n) * 1_370_003, unit="us"),
            "node": node, "anomaly": rng.random(n) < 0.05, "event_template": rng.integers(0, 9, n).astype(str), "template_id": rng.integers(1, 9, n),
        })
    )


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 150)
    monkeypatch.setattr(ordered, "SAMPLES", 4)


def in_order(pdf):
    return pdf.sort_values(["node", "timestamp", "row_id"], na_position="first").reset_index(drop=True)


def test_context_of_a_long_node_equals_pandas(spark, small_blocks):
    events = skewed(spark)
    got = sequence.add_sequence_context(events).toPandas().sort_values("row_id").reset_index(drop=True)
    pdf = in_order(events.toPandas())
    by = pdf.groupby("node", dropna=False)
    pdf["prev_template"], pdf["next_template"] = by["event_template"].shift(1), by["event_template"].shift(-1)
    pdf["gap_prev_s"] = by["timestamp"].diff().dt.total_seconds()
    want = pdf.sort_values("row_id").reset_index(drop=True)
    assert len(got) == len(want)
    for c in ("prev_template", "next_template"):
        assert got[c].where(got[c].notna(), None).tolist() == want[c].where(want[c].notna(), None).tolist()
    assert np.allclose(got["gap_prev_s"], want["gap_prev_s"], equal_nan=True)


def test_no_task_has_more_than_a_tenth_of_a_long_node(spark, small_blocks):
    events = skewed(spark)
    seen = []

    def compute(rows, w, earlier):
        seen.append("_block" in rows.columns)
        block = F.col("_block") if seen[-1] else F.lit(-1)
        return rows.withColumn("size", F.count("*").over(w.rowsBetween(ordered.Window.unboundedPreceding, ordered.Window.unboundedFollowing))).withColumn("at", block)

    done = ordered.by_node(events, compute, before=3, after=2)
    assert seen == [False, True]
    assert done.count() == events.count()
    assert done.where("at >= 0").agg(F.max("size")).first()[0] < 600 < done.where("node = 'hot'").count()
    assert done.where("node = 'hot'").select("at").distinct().count() > 5


@pytest.mark.parametrize("samples", [1, 4])
def test_frames_reach_over_short_blocks(spark, monkeypatch, samples):
    """Blocks of a row or two, frames of more than several of them."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ordered, "SAMPLES", samples)
    events = skewed(spark, 400, 3)
    got = sequence.sliding_sequences(events, 7).toPandas()
    pdf = in_order(events.toPandas())
    want = {}
    for _, g in pdf.groupby("node", dropna=False):
        ids = g["template_id"].tolist()
        want |= {r: (ids[i - 7 : i], ids[i]) for i, r in enumerate(g["row_id"]) if i >= 7}
    assert {r.row_id: (list(r.context), r.target) for r in got.itertuples()} == want


def test_positions_and_windows_of_a_long_node(spark, small_blocks):
    events = skewed(spark)
    pdf = in_order(events.toPandas())
    place = dict(zip(pdf["row_id"], pdf.groupby("node", dropna=False).cumcount()))
    assert {r["row_id"]: r["position"] for r in sequence.add_position(events).collect()} == place
    assert {r["row_id"]: r["window_idx"] for r in windows.by_count(events, 50).collect()} == {k: v // 50 for k, v in place.items()}
    by_id = pdf.sort_values("row_id")
    place = dict(zip(by_id["row_id"], by_id.groupby("node", dropna=False).cumcount()))
    assert {r["row_id"]: r["position"] for r in ev.position_order(events).collect()} == place


def test_bursts_on_a_long_node_are_the_same_in_blocks(spark, monkeypatch):
    events = skewed(spark).where("node is not null")
    plan = spark.createDataFrame([("hot", 300, 200, 4.0), ("3", 20, 50, 2.0)], "node string, start_pos long, burst_length int, intensity double")
    whole = sorted(map(tuple, inject.apply_bursts(events, plan).select("row_id", "timestamp", "injected_row").collect()))
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 120)
    monkeypatch.setattr(ordered, "SAMPLES", 4)
    assert sorted(map(tuple, inject.apply_bursts(events, plan).select("row_id", "timestamp", "injected_row").collect())) == whole


def test_next_events_of_a_long_node_are_the_same_in_blocks(spark, monkeypatch):
    events = skewed(spark, 2000).where("node is not null")
    score = lambda: {r["row_id"]: (round(r["score"], 9), r["flag"]) for r in detect.next_event_scores(events, detect.next_event_counts(events, 3), 9, order=3, history=3).collect()}
    whole = score()
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 90)
    monkeypatch.setattr(ordered, "SAMPLES", 4)
    assert score() == whole


def test_rolling_features_of_a_long_node_equal_pandas(spark, small_blocks):
    context = sequence.add_sequence_context(skewed(spark, 4000))
    got = features.add_rolling_features(context).toPandas().sort_values("row_id").reset_index(drop=True)
    pdf = in_order(context.toPandas())
    before = pdf.groupby("node", dropna=False)["gap_prev_s"].shift(1)
    by = before.groupby(pdf["node"], dropna=False)
    p = SYSTEM_LOG
    pdf["rolling_mean"] = by.transform(lambda g: g.rolling(p.rolling, min_periods=p.min_periods).mean())
    pdf["rolling_std"] = by.transform(lambda g: g.rolling(p.rolling, min_periods=p.min_periods).std())
    pdf["ewma_residual"] = pdf["gap_prev_s"] - by.transform(lambda g: g.ewm(span=p.ewma_span, adjust=True, min_periods=p.min_periods).mean())
    want = pdf.sort_values("row_id").reset_index(drop=True)
    for c in ("rolling_mean", "rolling_std", "ewma_residual"):
        assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-9, equal_nan=True), c


@pytest.mark.parametrize("span", [1, 2, 20, 400])
def test_ewma_of_a_hundred_thousand_values_equals_pandas(spark, span):
    """Stretches end within the node for short spans; values of very different size."""
    n = 100_000
    rng = np.random.default_rng(span)
    g = rng.gamma(0.5, 2, n) * 10.0 ** rng.integers(-3, 6, n)
    g[rng.random(n) < 0.01] = np.nan
    pdf = pd.DataFrame({"node": "a", "row_id": np.arange(n), "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s"), "g": g})
    pdf["c"] = pdf["g"].notna().cumsum().shift(1, fill_value=0)
    rows = spark.createDataFrame(pdf).withColumn("g", F.when(~F.isnan("g"), F.col("g")))
    got = features.ewma_before(rows, "g", "c", span, "e").select("row_id", "e").toPandas().sort_values("row_id")["e"].to_numpy()
    seen = pdf["g"].dropna().reset_index(drop=True).ewm(span=span, adjust=True).mean().to_numpy()
    want = np.concatenate([[np.nan], seen])[pdf["c"].to_numpy()]
    assert np.allclose(got, want, rtol=1e-9, atol=0, equal_nan=True)


@pytest.mark.parametrize("few,bins", [(10, 4), (50, 16), (10**6, 512)])
def test_medians_of_every_key_equal_duckdb(spark, few, bins):
    rng = np.random.default_rng(few)
    n = 5000
    key = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 40, n).astype(str)).astype(object)
    key[:100] = None
    v = np.where(rng.random(n) < 0.3, 0.0, rng.gamma(0.3, 50, n))
    v[rng.random(n) < 0.01] = np.inf
    v[rng.random(n) < 0.01] = -np.inf
    v[2000:2600] = 7.25  # many ties
    pdf = pd.DataFrame({"k": key, "v": v})
    want = {r[0]: r[1:] for r in duckdb.sql("SELECT k, count(*), median(v) FROM pdf GROUP BY k").fetchall()}
    got = {r["k"]: (r["n"], r["median"]) for r in quantile.grouped_medians(spark.createDataFrame(pdf), "k", "v", few=few, bins=bins).collect()}
    assert got == want


def test_quantiles_of_infinite_values(spark):
    pdf = pd.DataFrame({"v": [np.inf] * 30 + [-np.inf] * 30 + list(np.linspace(0, 1, 101))})
    df = spark.createDataFrame(pdf)
    for k in (0, 29, 30, 31, 80, 130, 131, 160):
        assert quantile.exact_quantile(df, "v", k / 160, bins=8, small=10) == sorted(pdf["v"])[k]


def test_baselines_are_the_same_by_selection(spark, monkeypatch):
    gaps = sequence.add_sequence_context(ev.from_event_stream(ev.read_events(spark, f"{SF}/events.parquet"))).where("gap_prev_s is not null")
    whole = sorted(map(tuple, baseline.node_baselines(gaps).collect()))
    monkeypatch.setattr(quantile, "FEW", 5)
    monkeypatch.setattr(quantile.grouped_medians, "__kwdefaults__", {"few": 5, "bins": 8, "rows": None})
    assert sorted(map(tuple, baseline.node_baselines(gaps).collect())) == whole
