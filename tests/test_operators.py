"""Operators on small hand-made tables."""

from dataclasses import replace
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.functions.templates import TemplateMiner, assign_templates, train_templates
from chronoloom.operators import audit, baseline, detect, evaluate, features, inject, sequence, windows
from chronoloom.schema import SPARSE, SYSTEM_LOG
from chronoloom.sources import events as ev
from chronoloom.sources import logs, sinks

from .conftest import SF

EVENT = "row_id long, timestamp timestamp, node string, anomaly boolean, event_template string"


def table(spark, rows):
    """Events from (node, second, anomaly, template)."""
    return spark.createDataFrame([(i, float(s), n, a, t) for i, (n, s, a, t) in enumerate(rows)], "row_id long, s double, node string, anomaly boolean, event_template string").select(
        "row_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("timestamp"), "node", "anomaly", "event_template"
    )


def stream(spark):
    return ev.from_event_stream(ev.read_events(spark, f"{SF}/events.parquet"))


def test_baseline_boundaries(spark):
    gaps = [("nine", float(i)) for i in range(9)] + [("ten", float(i)) for i in range(10)] + [("flat", 5.0)] * 12
    found = {r["node"]: r["status"] for r in baseline.node_baselines(spark.createDataFrame(gaps, "node string, gap_prev_s double")).collect()}
    assert found == {"nine": "low_count", "ten": "valid", "flat": "zero_mad"}


def test_first_event_follows_nothing_normal(spark):
    rows = sequence.add_sequence_context(table(spark, [("a", 0, True, "x"), ("a", 1, False, "x"), ("a", 2, False, "x"), ("b", 0, False, "x")]))
    assert [r["row_id"] for r in rows.where(sequence.normal_transition()).collect()] == [2]


def test_ties_keep_row_order(spark):
    rows = sequence.add_sequence_context(table(spark, [("a", 5, False, "x"), ("a", 5, False, "y"), ("a", 5, False, "z")])).orderBy("row_id").collect()
    assert [r["prev_template"] for r in rows] == [None, "x", "y"] and [r["gap_prev_s"] for r in rows] == [None, 0.0, 0.0]


def test_exact_quantile_matches_numpy(spark):
    values = np.random.default_rng(1).lognormal(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    for q in (0.0, 0.5, 0.95, 1.0):
        assert np.isclose(baseline.exact_quantile(df, "v", q, bins=16, small=50), np.quantile(values, q), rtol=1e-12)
    assert baseline.exact_quantile(df.limit(0), "v", 0.5) is None


def test_ewma_matches_pandas(spark):
    rng = np.random.default_rng(0)
    rows = sequence.add_sequence_context(table(spark, [("a", float(s), False, "x") for s in np.cumsum(rng.exponential(10, 900)).round(3)]))
    got = features.add_rolling_features(rows).orderBy("row_id").toPandas()
    prior = got["gap_prev_s"].shift(1)
    want = got["gap_prev_s"] - prior.ewm(span=20, min_periods=3).mean()
    np.testing.assert_allclose(got["ewma_residual"].astype(float), want, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got["rolling_std"].astype(float), prior.rolling(20, min_periods=3).std(), rtol=1e-9)


def test_pure_order_truth_table(spark):
    normal = [("a", i, False, t) for i, t in enumerate("xyxyxy")]
    rows = table(spark, normal + [("a", 10, True, "x"), ("a", 11, True, "x"), ("a", 12, True, "q"), ("b", 0, True, "x"), ("c", 0, False, "x"), ])
    got = {r["row_id"]: (r["order_status"], r["pure_order"]) for r in audit.pure_order(sequence.add_sequence_context(rows)).collect()}
    assert got[6] == ("judged", True)  # y->x is known, x->x isn't
    assert got[7] == ("unknown_template", None) and got[8] == ("unknown_template", None) and got[9] == ("unknown_template", None)
    assert got[10] == ("no_context", None)


def test_window_of_unknown_templates_survives(spark):
    rows = table(spark, [("a", 0, False, "x"), ("a", 1, False, "x"), ("a", 2, False, "q"), ("a", 3, False, "r")])
    vocab = windows.vocabulary(rows.where("row_id < 2"), 5)
    got = windows.count_vectors(windows.by_count(rows, 2), vocab, 5).orderBy("window_idx").collect()
    assert [r["counts"].toArray().sum() for r in got] == [2.0, 0.0]


def test_injection_keeps_order_and_everything_else(spark):
    e = stream(spark)
    context = sequence.add_sequence_context(e)
    gaps = context.where(sequence.normal_transition())
    nodes, pooled = baseline.node_baselines(gaps), baseline.pooled_baseline(gaps)
    before = inject.with_position(e).toPandas().set_index("row_id")
    for kind in ("stall", "burst"):
        plan = inject.plan_by_generator(context, nodes, pooled, kind, SPARSE)
        if kind == "stall":
            plan = inject.stall_plan_scaled(plan, nodes, pooled, SPARSE)
        moved = (inject.apply_stalls if kind == "stall" else inject.apply_bursts)(e, plan, SPARSE)
        after = moved.toPandas().set_index("row_id").loc[before.index]
        for c in ("node", "anomaly", "event_template", "raw_message"):
            assert (after[c] == before[c]).all()
        changed = after.assign(position=before["position"]).sort_values(["node", "position"])
        assert (changed.groupby("node")["timestamp"].diff().dropna() >= pd.Timedelta(0)).all()
        lengths = plan.agg(F.sum("burst_length")).first()[0]
        assert after["injected_row"].sum() == lengths


def test_generator_plan_replays_numpy(spark):
    """The plan equals one drawn directly from the node's gaps, on the draws' own terms."""
    e = stream(spark)
    context = sequence.add_sequence_context(e)
    gaps = context.where(sequence.normal_transition())
    nodes, pooled = baseline.node_baselines(gaps), baseline.pooled_baseline(gaps)
    profile = replace(SPARSE, n_injections=4)
    plan = inject.plan_by_generator(context, nodes, pooled, "burst", profile).orderBy("injection_id").collect()
    scored = baseline.with_baseline(context, nodes, pooled).withColumn("z", F.abs(baseline.z_of("gap_prev_s"))).toPandas().sort_values(["node", "timestamp", "row_id"])
    names = sorted(r["node"] for r in inject.eligible_nodes(context, nodes, profile.burst_min_events, profile).collect())
    master = np.random.default_rng(profile.burst_seed)
    chosen = master.choice(names, size=4, replace=False)
    seeds = master.integers(0, 2**31 - 1, size=4)
    for row, node, seed in zip(plan, chosen, seeds):
        z = scored.loc[scored["node"] == node, "z"].to_numpy()
        rng = np.random.default_rng(int(seed))
        length = int(rng.choice(profile.burst_lengths))
        lo = int(len(z) * 0.2)
        hi = min(max(int(len(z) * 0.7), lo + 1), len(z) - length - 1)
        start = None
        for _ in range(profile.tries):
            c = int(rng.integers(lo, hi))
            if z[c + 1 : c + 1 + length].max() <= 3.0:
                start = c
                break
        start = int(rng.integers(lo, hi)) if start is None else start
        assert (row["node"], row["burst_length"], row["start_pos"], row["intensity"]) == (node, length, start, float(rng.choice(profile.intensities)))


def test_half_even_rounding_of_burst_gaps(spark):
    e = table(spark, [("a", i * 25e-6, False, "x") for i in range(4)])
    plan = spark.createDataFrame([(0, "a", 4, 0, 2, 10.0, 1)], "injection_id int, node string, node_n long, start_pos long, burst_length int, intensity double, seed long")
    got = [r["us"] for r in inject.apply_bursts(e, plan).orderBy("row_id").select(F.unix_micros("timestamp").alias("us")).collect()]
    assert got == [0, 2, 4, 29]


def test_auc_with_ties_and_single_class(spark):
    rng = np.random.default_rng(3)
    score, truth = rng.integers(0, 8, 400).astype(float), rng.random(400) < 0.3
    cells = spark.createDataFrame(pd.DataFrame({"score": score, "truth": truth}))
    got = evaluate.auc(cells).first()
    pos, neg = score[truth], score[~truth]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert np.isclose(got["auc_roc"], want)
    ap = sum(((score == s) & truth).sum() / truth.sum() * ((score >= s) & truth).sum() / (score >= s).sum() for s in np.unique(score))
    assert np.isclose(got["auc_pr"], ap)
    assert evaluate.auc(cells.where("truth")).first()["auc_roc"] is None


def test_pca_matches_numpy(spark):
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(0).poisson(2.0, (60, 6)).astype(float)
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["row_id", "counts"])
    got = detect.CountPCA(3).fit(df).score(df).orderBy("row_id").toPandas()["score"]
    c = x - x.mean(0)
    v = np.linalg.svd(c, full_matrices=False)[2][:3].T
    np.testing.assert_allclose(got, ((c - c @ v @ v.T) ** 2).sum(1), rtol=1e-6, atol=1e-8)


def test_isolation_forest_ranks_an_outlier_first(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(300, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(301), "a": x[:, 0], "b": x[:, 1]}))
    forest = detect.IsolationForest(["a", "b"], trees=50)
    got = forest.fit(df).score(df).orderBy(F.desc("score")).first()
    assert got["row_id"] == 300 and 0.5 < got["score"] < 1


def test_log_grammars_edge_lines(spark):
    lines = spark.createDataFrame(
        [(0, "  - 1 2005.06.03 R02 2005-06-03-15.42.50.675872 R02 RAS KERNEL INFO hello  world "), (1, "- 1 2 3"), (2, "APPREAD 1 d R02 2005-06-03-15.42.50.675872 R02 RAS KERNEL INFO")],
        "row_id long, line string",
    )
    rows = {r["row_id"]: r for r in logs.parse_bgl(lines).collect()}
    assert rows[0]["raw_message"] == "hello  world " and not rows[0]["anomaly"] and not rows[0]["malformed"]
    assert rows[1]["malformed"] and rows[2]["raw_message"] == "" and rows[2]["anomaly"]
    hdfs = spark.createDataFrame([(0, "081109 203615 148 INFO got blk_-1 and blk_2 dest: /10.0.0.1:80"), (1, "081109 203615 148 INFO nothing here"), (2, "081109 203615 148 INFO blk_7")], "row_id long, line string")
    rows = {r["row_id"]: r for r in logs.parse_hdfs(hdfs).collect()}
    assert (rows[0]["block_id"], rows[0]["node"]) == ("blk_-1", "10.0.0.1") and rows[1]["malformed"] and rows[2]["node"] is None


def test_lines_split_as_python_splits_them(spark):
    """The content is the rest of the line: its trailing blanks and odd line separators stay; any white space parts fields."""
    texts = [
        "- 1 d R02 2005-06-03-15.42.50.675872 R02 RAS KERNEL INFO a\u2028b\x85c  ", "-\u00a01\u2003d\tR02 2005-06-03-15.42.50.675872 R02 RAS KERNEL INFO x", "\x1c- 1 d\x1fR02 t R02 RAS K I c",
        "- 1 d n t n T C L   ", "- 1 d n t n T C   ", "", "   ",
    ]
    got = {r["row_id"]: r for r in logs.parse_bgl(spark.createDataFrame(list(enumerate(texts)), "row_id long, line string")).collect()}
    for i, t in enumerate(texts):
        parts = t.split(None, 9)
        assert got[i]["malformed"] == (len(parts) < 9)
        if len(parts) >= 9:
            assert (got[i]["label"], got[i]["node"], got[i]["raw_message"]) == (parts[0], parts[3], parts[9] if len(parts) > 9 else "")


def test_sinks_round_trip(spark, tmp_path):
    events = sequence.add_sequence_context(stream(spark).limit(200))
    sinks.write_injection(events, events.select("row_id", "timestamp"), events.select("row_id", "node"), inject.run_config(spark, "stall", SPARSE, 7), str(tmp_path / "run"))
    back = ev.read_events(spark, str(tmp_path / "run/events"))
    assert back.count() == 200 and not set(sinks.CONTEXT_COLUMNS) & set(back.columns)
    labels = sinks.read_table(spark, str(tmp_path / "run/labels"), "row_id long, timestamp timestamp")
    assert sorted(labels.collect()) == sorted(events.select("row_id", "timestamp").collect())
    config = spark.read.json(str(tmp_path / "run/config")).first()
    assert config["n_eligible"] == 7 and config["grid_s"] == SPARSE.grid_s


def test_a_sweep_that_was_stopped_goes_on(spark, tmp_path):
    path, runs, done = str(tmp_path / "sweep"), [{"scheme": s, "seed": k} for s in "ab" for k in (1, 2)], []

    def compute(scheme, seed, fail_at=None):
        if (scheme, seed) == fail_at:
            raise InterruptedError
        done.append((scheme, seed))
        return spark.createDataFrame([(f"{scheme}{seed}", seed / 10)], "detector string, auc double")

    with pytest.raises(InterruptedError):
        sinks.sweep(spark, path, runs, lambda **r: compute(**r, fail_at=("b", 1)))
    assert len(sinks.published(spark, path)) == 2 and sinks.read_runs(spark, path).count() == 2
    whole = sinks.sweep(spark, path, runs, compute)
    assert done == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]  # nothing was worked out twice
    want = [(f"{s}{k}", k / 10, s, k) for s in "ab" for k in (1, 2)]
    assert sorted(map(tuple, whole.select("detector", "auc", "scheme", "seed").collect())) == want
    # a second writer of a published run is not seen, nor a run without a mark, nor one with an empty mark
    assert not sinks.publish_run(compute("a", 1), path, runs[0])
    compute("z", 9).write.parquet(f"{path}/data/unmarked")
    (tmp_path / "sweep/runs/0.json").write_text("")
    assert sorted(map(tuple, sinks.read_runs(spark, path).select("detector", "auc", "scheme", "seed").collect())) == want
    assert sinks.sweep(spark, path, runs[:1], compute).count() == 1 and sinks.read_runs(spark, str(tmp_path / "none")) is None


def test_a_mark_left_empty_is_taken_over(spark, tmp_path):
    path, run = str(tmp_path / "sweep"), {"seed": 1}
    results = spark.createDataFrame([(0.5,)], "auc double")
    (tmp_path / "sweep/runs").mkdir(parents=True)
    Path(sinks._marker(path, run)).write_text("")
    assert sinks.published(spark, path) == []
    assert sinks.publish_run(results, path, run) and sinks.read_runs(spark, path).first()["seed"] == 1


def test_next_event_scores_match_plain_back_off(spark):
    rows = table(spark, [(n, t, False, "x") for n in "ab" for t in range(120)]).withColumn("template_id", F.pmod(F.xxhash64(F.floor(F.col("row_id") / 2) % 7, F.col("row_id") % 3), F.lit(4)).cast("int"))
    ids = {n: [r["template_id"] for r in rows.where(F.col("node") == n).orderBy("row_id").collect()] for n in "ab"}
    counts = {}
    for x in ids.values():
        for i, t in enumerate(x):
            for k in range(min(i, 3) + 1):
                of = counts.setdefault(tuple(x[i - k : i]), {})
                of[t] = of.get(t, 0) + 1
    got = {r["row_id"]: r for r in detect.next_event_scores(rows, detect.next_event_counts(rows, 3), 4, order=3, history=3, top_k=2).collect()}
    for j, n in enumerate("ab"):
        for i, t in enumerate(ids[n]):
            r = got[j * 120 + i]
            if i < 3:
                assert r["score"] == 0 and not r["flag"]
                continue
            of = next(counts[c] for k in range(3, -1, -1) if (c := tuple(ids[n][i - k : i])) in counts)
            rank = sorted(of, key=lambda x: (-of[x], x)).index(t) + 1
            assert np.isclose(r["score"], -np.log((of[t] + 1) / (sum(of.values()) + 5))) and r["flag"] == (rank > 2)


def test_areas_match_a_plain_count_over_several_ranges(spark):
    rng = np.random.default_rng(5)
    score, truth = np.round(rng.normal(size=400), 1), rng.random(400) < 0.2
    cells = spark.createDataFrame([(str(i % 2), float(s), bool(t)) for i, (s, t) in enumerate(zip(score, truth))], "g string, score double, truth boolean")
    for r in evaluate.auc(cells.repartition(7), ["g"]).collect():
        s, t = score[int(r["g"]) :: 2], truth[int(r["g"]) :: 2]
        pairs = [(a > b) + 0.5 * (a == b) for a in s[t] for b in s[~t]]
        steps = [(sum(t[s == v]) / t.sum()) * (t[s >= v].sum() / (s >= v).sum()) for v in np.unique(s)]
        assert np.isclose(r["auc_roc"], np.mean(pairs)) and np.isclose(r["auc_pr"], sum(steps))


def test_consolidation_wants_one_area_a_key(spark):
    rows, areas = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), spark.createDataFrame([("a", 0.5)], "k string, auc double")
    with pytest.raises(ValueError):
        evaluate.consolidate([rows], areas, ["k"])
    with pytest.raises(ValueError):
        evaluate.consolidate([rows.where("k = 'a'")], areas.unionByName(areas), ["k"])
    found = evaluate.consolidate([rows.where("k = 'a'"), rows.where("k = 'a'")], areas, ["k"])
    assert [tuple(r) for r in found.collect()] == [("a", 1.0, 0.5)]


def test_every_message_is_mined(spark):
    rows = spark.createDataFrame([(i, f"{'open' if i % 2 else 'close'} file f{i} at {i * 7}") for i in range(300)] + [(999, "a rare kind of message")], "row_id long, raw_message string")
    found = {r["event_template"] for r in assign_templates(rows, train_templates(rows.repartition(5))).collect()}
    assert found == {"open file <*> at <*>", "close file <*> at <*>", "a rare kind of message"}


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"".join(b"line %d\n" % i for i in range(2000)) + b"bad \xff byte\n")
    rows = logs.read_lines(spark, str(tmp_path / "log"), limit=2001).orderBy("row_id").collect()
    assert [r["line"] for r in rows[:2000]] == [f"line {i}" for i in range(2000)] and rows[2000]["line"] == "bad � byte"


def test_template_miner_generalises():
    miner = TemplateMiner()
    assert miner.add("open file a.txt now") == "open file a.txt now"
    assert miner.add("open file b.txt now") == "open file <*> now"
    assert miner.match("open file c.txt now") == "open file <*> now" and miner.match("something else") is None
    assert miner.templates() == ["open file <*> now"]
    assert miner.add("") == ""


def test_bootstrap_weighs_injections(spark):
    cells = spark.createDataFrame([("a", i, float(i), i >= 8) for i in range(10)], "node string, window_idx long, score double, truth boolean")
    labelled = spark.createDataFrame([(0, "a", 8), (1, "a", 9)], "injection_id int, node string, window_idx long")
    got = evaluate.bootstrap_ci(cells, labelled, 2, replicates=50).first()
    assert got["auc_roc"] == 1.0 and got["ci_low"] == 1.0 and not got["crosses_chance"] and got["n_replicates"] == 50


def test_profiles_bound_stalls():
    assert SYSTEM_LOG.max_mad_eff_s == 120.0 and SPARSE.max_mad_eff_s == 30_000.0


def test_steps_by_node_of_a_bucketed_table_show_no_exchange(spark, tmp_path):
    events = ev.from_event_stream(ev.read_events(spark, f"{SF}/events.parquet"))
    table = sinks.bucketed_events(events, "bucketed_events_test", str(tmp_path / "t"), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        context = sequence.add_sequence_context(table)
        steps = {
            "context": context,
            "windows": windows.by_count(table, 10),
            "sizes": table.groupBy("node").count(),
            "join": context.join(table.groupBy("node").count(), "node"),
        }
        for name, d in steps.items():
            plan = d._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan, name
        key = lambda d: sorted(map(tuple, d.select("row_id", "prev_template", "gap_prev_s").collect()))
        assert key(context) == key(sequence.add_sequence_context(events))
        assert "Exchange hashpartitioning" in sequence.add_sequence_context(events)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_events_test")
