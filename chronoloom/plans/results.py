"""Queries of whole result tables: both faults and profiles, sweeps, seeds, and what is made of their figures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import baseline, detect, evaluate, inject, sequence, windows
from ..schema import SPARSE, SPARSE_SECOND
from ..sources import events as ev
from ..sources.sinks import stage, together
from . import experiments as ex
from . import sql as q
from .queries import _GRID_RESULTS, _NORMAL, _SIZES, _SORTED, _SQL, seq_context, AUC, CONFUSION, context, grid_results, query, r6, rounded

FAULTS = ("stall", "burst")
#: Names to show, in the order to show them.
LABELS = {
    "count_vector_pca": "Count PCA", "z_score_threshold": "Gap z-score", "log_ratio_threshold": "Gap log ratio", "isolation_forest_counts": "Count isolation forest",
}
_PARTS = {"stall": q.STALL, "burst": q.BURST}
_GRID = {"stall": "stg", "burst": "bgl"}
_LONG = "SELECT 'z_score_threshold' AS detector, node, window_idx, z AS score, fz AS flag, truth FROM {0}_c UNION ALL SELECT 'log_ratio_threshold', node, window_idx, r, fr, truth FROM {0}_c"


def hour_clock(e: DataFrame) -> DataFrame:
    """The events under a one-hour clock."""
    return e.withColumn("timestamp", F.date_trunc("HOUR", "timestamp"))


def long_cells(clean: ex.Clean, kind: str) -> tuple[DataFrame, DataFrame]:
    """The timing detectors' cells in long form, written, and the labelled cells."""
    return ex.all_cells(clean, kind, detectors=ex.TIMING)


# --- the second profile ------------------------------------------------------------


def _second(kind: str) -> None:
    def core(e):
        cells, _ = long_cells(ex.Clean.of(hour_clock(e), SPARSE_SECOND), kind)
        return rounded(evaluate.confusion(cells, by=["detector"]).select("detector", *CONFUSION))

    def area(e):
        cells, _ = long_cells(ex.Clean.of(hour_clock(e), SPARSE_SECOND), kind)
        return rounded(evaluate.auc(cells, ["detector"]).select("detector", *AUC))

    core.__name__, area.__name__ = f"second_core_result_{kind}", f"second_auc_table_{kind}"
    base = f"WITH {q.BASE}, {_PARTS[kind]}, {q.scored_injected(kind)}"
    query(q.second(f"{base}, lo AS ({_LONG.format(kind)}) " + q.confusion("lo", "truth", "flag", "detector,", "detector")))(core)
    z, r = (q.auc(f"(SELECT {c} AS score, truth FROM {kind}_c)", f"'{n}' AS detector,") for c, n in (("z", "z_score_threshold"), ("r", "log_ratio_threshold")))
    query(q.second(f"{base} {z} UNION ALL {r}"))(area)


for _kind in FAULTS:
    _second(_kind)


@query(q.second(f"WITH {q.BASE}, {q.BURST} SELECT row_id, node, us, injected_row FROM bui"))
def second_inject_burst(e):
    return ex.injected(hour_clock(e), "burst", SPARSE_SECOND)[0].select("row_id", "node", F.unix_micros("timestamp").alias("us"), "injected_row")


@query(q.second(f"WITH {q.BASE}, {q.STALL} SELECT row_id, node, us, injected_row FROM sti"))
def second_inject_stall(e):
    return ex.injected(hour_clock(e), "stall", SPARSE_SECOND)[0].select("row_id", "node", F.unix_micros("timestamp").alias("us"), "injected_row")


# --- four detectors ------------------------------------------------------------------


def four_detectors(e: DataFrame, profile, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(cells, result rows) of both faults and all four detectors."""
    clean, cells, rows = ex.Clean.of(e, profile), [], []
    for kind in FAULTS:
        one, labelled = ex.all_cells(clean, kind)
        named = lambda d: d.withColumns({"dataset": F.lit(dataset), "fault_type": F.lit(kind)})  # noqa: B023, E731
        cells.append(named(one.join(labelled.groupBy(*windows.CELL).agg(F.max("injection_id").alias("injection_id")), windows.CELL, "left")))
        rows.append(named(ex.result_rows(one, labelled)))
    return cells[0].unionByName(cells[1]), rows[0].unionByName(rows[1])


RESULT = ["dataset", "fault_type", "detector", *CONFUSION, "n_detected", "n_injections", "detection_rate", "expected_by_chance", *AUC, "auc_pr_ratio"]


@query()
def result_table(e):
    """The whole table: two profiles, two faults, four detectors."""
    rows = four_detectors(e, SPARSE, "system")[1].unionByName(four_detectors(hour_clock(e), SPARSE_SECOND, "second")[1])
    return rounded(rows.select(*RESULT))


@query()
def fusion_all(e):
    """Agreement and gains of every pair of detectors on stalls."""
    cells, _ = ex.all_cells(ex.Clean.of(e), "stall")
    names, out = sorted(LABELS), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            pair = evaluate.fusion(*[cells.where(F.col("detector") == d).select(*windows.CELL, "truth", "flag") for d in (a, b)])
            pair = pair.select(F.lit(a).alias("detector_a"), F.lit(b).alias("detector_b"), "*")
            out = pair if out is None else out.unionByName(pair)
    return rounded(out)


@query()
def injected_row_diag(e):
    """Features, score and flag of the injected rows under the isolation forest on timing features."""
    return ex.timing_forest_on(ex.Clean.of(e), ex.injected(e, "stall")[0]).where("injected_row").select("row_id", "node", *ex.features.FEATURES, "score", "threshold", "flag")


@query()
def common_unit_rescoring(e):
    """Three detectors' test-period flags in their own units and on the common grid."""
    return rounded(ex.rescored(e))


# --- windows back to rows, spans, orders ------------------------------------------------


@query(f"""WITH {q.EV}, w AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY us, row_id) - 1) // 10 AS widx FROM ev),
f AS (SELECT node, widx, count(DISTINCT event_template) >= 9 AS flag FROM w GROUP BY ALL), b AS (SELECT w.* EXCLUDE (widx), flag FROM w JOIN f USING (node, widx)), {q.cells('g', 'b')},
c AS (SELECT node, window_idx, bool_or(anomaly) AS truth, bool_or(flag) AS flag FROM g GROUP BY ALL) {q.confusion('c', 'truth', 'flag')}""")
def window_flags_on_grid(e):
    """Flags of count windows returned to their rows and judged on the time grid."""
    w = windows.by_count(e, SPARSE.window_events)
    scored = w.groupBy(*windows.CELL).agg((F.countDistinct("event_template") >= 9).alias("flag"))
    cells = evaluate.to_cells(evaluate.eval_grid(windows.back_to_rows(w, scored, "flag"), SPARSE), truth="anomaly", flag="flag")
    return rounded(evaluate.confusion(cells).select(*CONFUSION))


@query(f"WITH {q.BASE}, {q.BURST} SELECT i.row_id, l.node IS NOT NULL AS in_span FROM bui i LEFT JOIN bul l ON l.node = i.node AND i.us BETWEEN l.start_us AND l.end_us")
def span_rows(e):
    moved, labels, _ = ex.injected(e, "burst")
    return inject.in_span(moved, labels).select("row_id", "in_span")


@query(f"""WITH {q.EV}, w AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY us, row_id) AS a, row_number() OVER (PARTITION BY node ORDER BY row_id) AS b FROM ev),
m AS (SELECT x.row_id = y.row_id AS r, x.node = y.node AS n, x.event_template = y.event_template AS t FROM w x JOIN w y ON x.node = y.node AND x.a = y.b)
SELECT bool_and(n) AS same_nodes, bool_and(r) AS same_rows, bool_and(t) AS same_templates, count(*) AS n_rows FROM m""")
def order_equivalence(e):
    """Whether order by time and by row id give the same sequences."""
    by_time = sequence.add_position(e, "place").select("node", (F.col("place") + 1).alias("place"), "row_id", "event_template")
    other = ev.position_order(e).select(F.col("node").alias("n2"), (F.col("position") + 1).alias("p2"), F.col("row_id").alias("r2"), F.col("event_template").alias("t2"))
    met = by_time.join(other, (F.col("node") == F.col("n2")) & (F.col("place") == F.col("p2")))
    return met.agg(
        F.bool_and(F.col("node") == F.col("n2")).alias("same_nodes"), F.bool_and(F.col("row_id") == F.col("r2")).alias("same_rows"),
        F.bool_and(F.col("event_template") == F.col("t2")).alias("same_templates"), F.count("*").alias("n_rows"),
    )


@query(f"""WITH {q.EV}, w AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY us, row_id) - 1) // 10 AS window_idx FROM ev), f AS (SELECT node, window_idx, count(*) AS score FROM w GROUP BY ALL)
SELECT node, CAST(window_idx AS BIGINT) AS window_idx, min(score) AS score, count(DISTINCT score) = 1 AS all_equal FROM w JOIN f USING (node, window_idx) GROUP BY ALL""")
def score_of_windows(e):
    """A window's score taken from its rows, which all bear it."""
    w = windows.by_count(e, SPARSE.window_events)
    rows = w.join(w.groupBy(*windows.CELL).agg(F.count("*").alias("score")), windows.CELL)
    return rows.groupBy(*windows.CELL).agg(F.min("score").alias("score"), (F.countDistinct("score") == 1).alias("all_equal"))


@query(f"""WITH {q.BASE}, {q.STALL}, {q.BURST}, k AS (SELECT 'stall' AS kind, injection_id, node, delta_us / 1e6 AS severity_s FROM stl UNION ALL SELECT 'burst', injection_id, node, (old_us - end_us) / 1e6 FROM bul)
SELECT kind, injection_id, node, severity_s, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY severity_s DESC, injection_id) AS rank FROM k) WHERE rank <= 3""")
def top_severity(e):
    """The three most severe injections of each fault."""
    clean, out = ex.Clean.of(e), None
    for kind, column in (("stall", "delta_seconds"), ("burst", "total_time_saved_s")):
        labels = ex.injected(e, kind, clean=clean)[1]
        worst = labels.orderBy(F.desc(column), "injection_id").limit(3).select(F.lit(kind).alias("kind"), "injection_id", "node", F.col(column).alias("severity_s"))
        worst = worst.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("severity_s"), "injection_id")))
        out = worst if out is None else out.unionByName(worst)
    return out


@query(f"""WITH {q.BASE}, {q.STALL} SELECT node FROM (SELECT DISTINCT node FROM sti WHERE injected_row) ORDER BY md5('7|' || node), node LIMIT 10""")
def picked_nodes(e):
    return ev.pick_nodes(ex.injected(e, "stall")[0], 10, 7)


@query(f"WITH {q.EV} SELECT row_id, us, node, label, anomaly, event_template, raw_message FROM ev")
def event_sink_round_trip(e):
    """Events written as an event table, with context columns on them, and read again: every row and column."""
    from ..sources import sinks

    path = sinks.scratch(e.sparkSession, "events")
    sinks.write_events(context(e), path, files_by_node=4)
    back = ev.read_events(e.sparkSession, path)
    return back.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


@query(_SQL["seq_context"])
def bucketed_context(e):
    """The context of an event table that is bucketed by node: no shuffle but that of the table's writing."""
    from ..sources import sinks

    name = f"events_{uuid.uuid4().hex}"
    table = sinks.bucketed_events(e, name, sinks.scratch(e.sparkSession, "bucketed-events"))
    return seq_context(table)


# --- natively fitted detectors on several grids ------------------------------------------

STABILITY = ["detector", "grid_size_s", *CONFUSION, "certified"]


@query()
def native_grid_stability(e):
    """The count detectors and the timing forest, fitted once, on grids of half, one and two days; the certified one is marked."""
    return rounded(ex.native_stability(e, _SIZES).select(*STABILITY))


@query()
def native_f1_ranking(e):
    """Their order by F1 on each grid, and whether it is the same on all."""
    return evaluate.f1_stability(rounded(ex.native_stability(e, _SIZES))).select("grid_size_s", F.array_join("ranking", ">").alias("ranking"), "stable")


# --- thresholds and score tables -------------------------------------------------------


@query(f"WITH {q.BASE}, {q.SPLIT} SELECT round(quantile_cont(abs(z_score), 0.95), 6) AS threshold FROM z, cut WHERE us > cut.cutoff_us AND NOT anomaly")
def oracle_threshold(e):
    """The threshold that the normal part of the test period itself would give."""
    rows = sequence.chronological_split(ex.scored_timing(context(e)))
    return rounded(detect.threshold(detect.FixedZ().score(rows.where("not is_train and not anomaly"))))


@query(f"""WITH {q.BASE}, s AS (SELECT anomaly, abs(z_score) AS s FROM z), b AS (SELECT min(s) AS lo, max(s) AS hi FROM s)
SELECT anomaly, CAST(CASE WHEN hi > lo THEN least(floor((s - lo) / (hi - lo) * 20), 19) ELSE 0 END AS INT) AS bin, count(*) AS n FROM s, b GROUP BY ALL""")
def score_histogram(e):
    return detect.score_histogram(stage(detect.FixedZ().score(ex.scored_timing(context(e))).select("anomaly", "score"), "scores"), "anomaly")


@query(f"""WITH {q.BASE}, {q.STALL} SELECT node, position, 'before' AS state, us / 1e6 AS at_s, gap_prev_s AS gap_s FROM ctx WHERE node IN (SELECT node FROM stl WHERE injection_id = 0)
UNION ALL SELECT node, old_position, 'after', us / 1e6, (us - lag(us) OVER (PARTITION BY node ORDER BY us, row_id)) / 1e6 FROM sti WHERE node IN (SELECT node FROM stl WHERE injection_id = 0)""")
def gap_lines(e):
    """Plot data: one injected node's gaps before and after."""
    moved, labels, _ = ex.injected(e, "stall")
    node = F.broadcast(labels.where("injection_id = 0").select("node"))
    one = lambda d, name: sequence.add_position(context(d.join(node, "node", "left_semi"))).select(
        "node", "position", F.lit(name).alias("state"), (F.unix_micros("timestamp") / 1e6).alias("at_s"), F.col("gap_prev_s").alias("gap_s")
    )
    return one(e, "before").unionByName(one(moved, "after"))


# --- tables of results ------------------------------------------------------------------


def _both_sql(what) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH {q.BASE}, {_PARTS[k]}, {q.scored_injected(k)} {what(k)})" for k in FAULTS)


_FIGURES = ["recall", "precision", "base_rate", "lift"]


@query(f"""WITH co AS ({_both_sql(lambda k: f", lo AS ({_LONG.format(k)}) " + q.confusion('lo', 'truth', 'flag', f"'{k}' AS fault_type, detector,", 'detector'))}),
ar AS ({_both_sql(lambda k: " UNION ALL ".join(q.auc(f"(SELECT {c} AS score, truth FROM {k}_c)", f"'{k}' AS fault_type, '{n}' AS detector,") for c, n in (("z", "z_score_threshold"), ("r", "log_ratio_threshold"))))})
SELECT fault_type, detector, CASE detector WHEN 'z_score_threshold' THEN 'Gap z-score' ELSE 'Gap log ratio' END AS detector_label, CASE detector WHEN 'z_score_threshold' THEN 1 ELSE 2 END AS detector_order,
  recall, precision, flagged_frac AS base_rate, lift, auc_roc, auc_pr FROM co JOIN ar USING (fault_type, detector)""")
def consolidated(e):
    """Result rows of both faults (given twice: the first of each key stays) with their areas, display names and order."""
    clean, rows, areas = ex.Clean.of(e), None, None
    for kind in FAULTS:
        cells, _ = long_cells(clean, kind)
        one = evaluate.confusion(cells, by=["detector"]).withColumn("fault_type", F.lit(kind))
        area = evaluate.auc(cells, ["detector"]).select("detector", "auc_roc", "auc_pr").withColumn("fault_type", F.lit(kind))
        rows, areas = (one, area) if rows is None else (rows.unionByName(one), areas.unionByName(area))
    rows = stage(rows, "results")
    found = evaluate.display_table(evaluate.consolidate([rows, rows.where("fault_type = 'stall'")], areas, ["fault_type", "detector"]), LABELS)
    return rounded(found.select("fault_type", "detector", "detector_label", "detector_order", *_FIGURES, "auc_roc", "auc_pr"))


@query(f"""WITH {_GRID_RESULTS}, t AS (SELECT detector, f1, grid_size_s FROM gr UNION ALL SELECT detector, f1 + CASE detector WHEN 'fz' THEN 1 ELSE 0 END, grid_size_s FROM gr WHERE grid_size_s = 86400)
SELECT detector, grid_size_s, count(*) AS n, count(DISTINCT f1) AS n_distinct FROM t GROUP BY ALL HAVING count(DISTINCT f1) > 1""")
def conflicting_results(e):
    """Keys whose repeated rows disagree."""
    rows = stage(grid_results(e).select("detector", "f1", "grid_size_s"), "results")
    again = rows.where("grid_size_s = 86400").withColumn("f1", F.col("f1") + F.when(F.col("detector") == "fz", 1).otherwise(0))
    return evaluate.conflicting_duplicates(rows.unionByName(again), ["detector", "grid_size_s"])


@query(f"""WITH {_GRID_RESULTS}, o AS (SELECT * FROM gr WHERE grid_size_s = 86400), n AS (SELECT * FROM gr WHERE grid_size_s = 43200)
SELECT detector, o.precision AS old_precision, n.precision AS new_precision, o.recall AS old_recall, n.recall AS new_recall, o.f1 AS old_f1, n.f1 AS new_f1,
  o.precision = n.precision AND o.recall = n.recall AND o.f1 = n.f1 AS same FROM o JOIN n USING (detector)""")
def old_and_new(e):
    """Figures in two units side by side."""
    rows = stage(grid_results(e), "results")
    at = lambda size: rows.where(F.col("grid_size_s") == size)
    return evaluate.side_by_side(at(86_400), at(43_200), ["detector"], ["precision", "recall", "f1"])


@query(f"""WITH {_GRID_RESULTS}, r AS (SELECT detector, grid_size_s, recall, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS again FROM gr WHERE NOT (detector = 'fr' AND grid_size_s = 43200))
SELECT count(*) AS n_both, (SELECT count(*) FROM gr) - count(*) AS n_one_side, 0::BIGINT AS n_repeated, round(max(abs(recall - round(again, 6))), 6) AS max_abs_diff FROM r""")
def figures_cross_check(e):
    """Figures worked out again against those in the table, one of which is missing."""
    rows = stage(grid_results(e), "results")
    again = rows.where("not (detector = 'fr' and grid_size_s = 43200)").withColumn("recall", r6(F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))))
    return rounded(evaluate.cross_check(rows, again, ["detector", "grid_size_s"], "recall"))


# --- seeds, intervals, sweeps ------------------------------------------------------------

SEEDS = (42, 43, 44, 45, 46)


def _seeded(kind: str, seed: int) -> str:
    own = q.plan(kind)
    parts = _PARTS[kind].replace(own, q.plan(kind, seed))
    cells = [q.auc(f"(SELECT {c} AS score, truth FROM {kind}_c)", f"'{kind}' AS fault_type, {seed} AS seed, '{n}' AS detector,") for c, n in (("z", "z_score_threshold"), ("r", "log_ratio_threshold"))]
    return f"SELECT * FROM (WITH {q.BASE}, {parts}, {q.scored_injected(kind)} {' UNION ALL '.join(cells)})"


_SEED_RUNS = " UNION ALL ".join(_seeded(k, s) for k in FAULTS for s in SEEDS)


@query(_SEED_RUNS)
def multi_seed_auc(e):
    """Both faults under five plans each."""
    return rounded(ex.multi_seed(e, FAULTS, SEEDS).select("fault_type", "seed", "detector", *AUC))


@query()
def multi_seed_all(e):
    """Both faults under five plans each, all four detectors."""
    return rounded(ex.multi_seed(e, FAULTS, SEEDS, all_detectors=True).select("fault_type", "seed", "detector", *AUC))


@query()
def second_multi_seed_all(e):
    """The same under the rules of a log with a coarse clock."""
    return rounded(ex.multi_seed(hour_clock(e), FAULTS, SEEDS, SPARSE_SECOND, all_detectors=True).select("fault_type", "seed", "detector", *AUC))


@query(q.second(_SEED_RUNS))
def second_multi_seed_auc(e):
    """The timing detectors under five plans each of both faults, coarse clock."""
    return rounded(ex.multi_seed(hour_clock(e), FAULTS, SEEDS, SPARSE_SECOND).select("fault_type", "seed", "detector", *AUC))


@query(f"""SELECT fault_type, detector, round(avg(auc_roc), 6) AS mean, round(coalesce(stddev_samp(auc_roc), 0.0), 6) AS std, count(auc_roc) AS n_seeds, min(auc_roc) AS min, max(auc_roc) AS max,
  min(auc_roc) < 0.5 AND max(auc_roc) > 0.5 AS crosses_chance FROM ({_SEED_RUNS}) GROUP BY ALL""")
def multiseed_summary(e):
    runs = stage(rounded(ex.multi_seed(e, FAULTS, SEEDS)), "seeds")
    return rounded(evaluate.seed_summary(runs, ["fault_type", "detector"]))


def _bootstrap(kind: str, column: str, name: str) -> str:
    return f"""SELECT * FROM (WITH {q.BASE}, {_PARTS[kind]}, {q.scored_injected(kind)}, c AS (SELECT node, window_idx, {column} AS score, truth FROM {kind}_c),
st AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below, sum(neg) OVER () AS n_neg FROM (SELECT score, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM c GROUP BY score)),
ow AS (SELECT node, window_idx, max(injection_id) AS injection_id FROM {_GRID[kind]} GROUP BY ALL),
ea AS (SELECT injection_id, count(*) AS k, sum((below + 0.5 * neg) / n_neg) AS ranks FROM c JOIN st USING (score) JOIN ow USING (node, window_idx) WHERE truth GROUP BY injection_id),
dr AS (SELECT rep, CAST(('0x' || substr(md5('0|' || rep || '|' || i), 1, 8)) AS BIGINT) % 100 AS injection_id FROM range(0, 1000) a(rep), range(0, 100) b(i)),
rp AS (SELECT rep, sum(ranks) / sum(k) AS auc FROM dr JOIN ea USING (injection_id) GROUP BY rep)
SELECT '{kind}' AS fault_type, '{name}' AS detector, round((SELECT sum(ranks) / sum(k) FROM ea), 6) AS auc_roc, round(quantile_cont(auc, 0.025), 6) AS ci_low, round(quantile_cont(auc, 0.975), 6) AS ci_high,
  count(*) AS n_replicates, quantile_cont(auc, 0.025) <= 0.5 AND quantile_cont(auc, 0.975) >= 0.5 AS crosses_chance FROM rp)"""


@query(" UNION ALL ".join(_bootstrap(k, c, n) for k in FAULTS for c, n in (("z", "z_score_threshold"), ("r", "log_ratio_threshold"))))
def bootstrap_ci(e):
    """Intervals of the timing detectors' areas over resampled injections."""
    clean, out = ex.Clean.of(e), None
    for kind in FAULTS:
        cells, labelled = long_cells(clean, kind)
        for name in ("z_score_threshold", "log_ratio_threshold"):
            one = evaluate.bootstrap_ci(cells.where(F.col("detector") == name), labelled, SPARSE.n_injections)
            one = one.select(F.lit(kind).alias("fault_type"), F.lit(name).alias("detector"), "*")
            out = one if out is None else out.unionByName(one)
    return rounded(out)


@query()
def bootstrap_table(e):
    """The same for all sixteen cells of the result table."""
    out = None
    for events, profile, dataset in ((e, SPARSE, "system"), (hour_clock(e), SPARSE_SECOND, "second")):
        cells, _ = four_detectors(events, profile, dataset)
        for kind in FAULTS:
            for name in LABELS:
                own = cells.where((F.col("fault_type") == kind) & (F.col("detector") == name))
                one = evaluate.bootstrap_ci(own.drop("injection_id"), own.where("injection_id is not null").select(*windows.CELL, "injection_id"), SPARSE.n_injections)
                one = one.select(F.lit(dataset).alias("dataset"), F.lit(kind).alias("fault_type"), F.lit(name).alias("detector"), "*")
                out = one if out is None else out.unionByName(one)
    return rounded(out)


def _sweep_sql() -> str:
    out = []
    for kind in FAULTS:
        spans = "stl" if kind == "stall" else "bul"
        rows = f"""sr AS (SELECT i.row_id, i.node, i.us, abs(z_score) AS z, abs(z_score) > 3.0 AS fz, abs(log_ratio) AS r, abs(log_ratio) > threshold AS fr, l.node IS NOT NULL AS truth
  FROM {kind}_iz i CROSS JOIN {kind}_th LEFT JOIN {spans} l ON l.node = i.node AND i.us BETWEEN l.start_us AND l.end_us)"""
        names, cells = [], []
        for scheme, size in ex.SCHEMES:
            name = f"w_{scheme}_{size}"
            window = q.cells(name, "sr", size) if scheme == "fixed_time" else f"{name} AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY us, row_id) - 1) // {size} AS window_idx FROM sr)"
            cells.append(window)
            for d, f, label in (("z", "fz", "z_score_threshold"), ("r", "fr", "log_ratio_threshold")):
                cells.append(f"{name}_{d} AS (SELECT node, window_idx, bool_or(truth) AS truth, bool_or({f}) AS flag, max({d}) AS score FROM {name} GROUP BY ALL)")
                key = f"'{kind}' AS fault_type, '{scheme}' AS scheme, {size} AS size, '{label}' AS detector,"
                figures, area = q.confusion(f"{name}_{d}", "truth", "flag", key), q.auc(f"{name}_{d}")
                names.append(f"SELECT * FROM ({figures}) CROSS JOIN ({area})")
        out.append(f"SELECT * FROM (WITH {q.BASE}, {_PARTS[kind]}, {q.scored_injected(kind)}, {rows}, {', '.join(cells)} {' UNION ALL '.join(names)})")
    return " UNION ALL ".join(out)


SWEEP = ["fault_type", "scheme", "size", "detector", *CONFUSION, *AUC]


@query(_sweep_sql())
def window_sweep(e):
    """Six window schemes, both faults, the timing detectors."""
    return rounded(ex.window_sweep(ex.Clean.of(e)).select(*SWEEP))


@query(q.second(_sweep_sql()))
def second_window_sweep(e):
    """The sweep of the coarse-clock log."""
    return rounded(ex.window_sweep(ex.Clean.of(hour_clock(e), SPARSE_SECOND)).select(*SWEEP))


@query()
def window_sweep_all(e):
    """Six window schemes, both faults, all four detectors."""
    return rounded(ex.window_sweep(ex.Clean.of(e), all_detectors=True).select(*SWEEP))


# --- invariance and next events ------------------------------------------------------------


@query(f"""WITH {q.BASE}, {q.STALL}, fr AS (SELECT event_template, -ln(count(*) / (SELECT count(*) FROM ev)) AS weight FROM ev GROUP BY event_template),
a AS (SELECT node, (row_number() OVER (PARTITION BY node ORDER BY row_id) - 1) // 10 AS w, weight FROM ev JOIN fr USING (event_template)),
b AS (SELECT node, (row_number() OVER (PARTITION BY node ORDER BY row_id) - 1) // 10 AS w, weight FROM sti JOIN fr USING (event_template)),
x AS (SELECT node, w, round(sum(weight), 6) AS s FROM a GROUP BY ALL), y AS (SELECT node, w, round(sum(weight), 6) AS s FROM b GROUP BY ALL)
SELECT count(*) AS n_common_windows, max(abs(x.s - y.s)) AS max_abs_score_diff, count(*) FILTER (abs(x.s - y.s) > 1e-9) AS n_differing_windows FROM x JOIN y USING (node, w)""")
def invariance_fixed_count(e):
    """Rarity scores of position windows, which no change of clock can move."""
    total = e.count()
    weights = e.groupBy("event_template").agg((-F.log(F.count("*") / F.lit(total))).alias("weight"))
    score = lambda d: windows.by_position(d.join(weights, "event_template"), 10).groupBy(*windows.CELL).agg(r6(F.sum("weight")).alias("score"))
    return evaluate.invariance(score(e), score(ex.injected(e, "stall")[0]))


@query()
def invariance_count_pca(e):
    """Count-PCA scores of position windows of clean and stalled data."""
    clean = ex.Clean.of(e)
    vocab = stage(windows.vocabulary(clean.training(), SPARSE.vocabulary), "vocabulary")
    vectors = lambda d: stage(windows.count_vectors(windows.by_position(d, SPARSE.window_events), vocab, SPARSE.vocabulary), "vectors")
    fit = lambda: detect.CountPCA(SPARSE.pca_components).fit(vectors(clean.training()).where("not label"))
    moved = lambda: vectors(ex.injected(clean.rows(), "stall", clean=clean)[0])
    fitted, before, after = together(fit, lambda: vectors(clean.rows()), moved)
    score = lambda d: fitted.score(d).select(*windows.CELL, r6(F.col("score")).alias("score"))
    return evaluate.invariance(score(before), score(after))


_DL = f"""{q.SPLIT}, {_SORTED}, tr_en AS (SELECT sp.*, coalesce(template_id, 0) AS template_id FROM sp LEFT JOIN sv USING (event_template) WHERE is_train AND NOT anomaly)"""
_EN = "en AS (SELECT x.*, coalesce(template_id, 0) AS template_id FROM {} x LEFT JOIN sv USING (event_template))"


@query(f"WITH {q.EV}, {_DL}, {_EN.format('ev')}, {q.next_event('en')} SELECT row_id, node, round(score, 6) AS score, flag FROM dl")
def deeplog_scores(e):
    return ex.next_event_rows(e, e).select("row_id", "node", r6("score"), "flag")


@query(f"""WITH {q.EV}, {_DL}, {_EN.format('ev')}, {q.next_event('en')}, t AS (SELECT sp.*, round(score, 9) AS score, flag FROM sp JOIN dl USING (row_id) WHERE NOT is_train), {q.cells('g', 't')},
c AS (SELECT node, window_idx, bool_or(anomaly) AS truth, bool_or(flag) AS flag, max(score) AS score FROM g GROUP BY ALL)
SELECT * FROM ({q.confusion('c', 'truth', 'flag')}) CROSS JOIN ({q.auc('c')})""")
def deeplog_native(e):
    """The next-event detector against the events' own labels, on the test period's grid."""
    rows = ex.next_event_rows(e, e, test_only=True).withColumn("score", F.round("score", 9))
    cells = stage(evaluate.to_cells(evaluate.eval_grid(rows, SPARSE), truth="anomaly", flag="flag", score="score"), "cells")
    return rounded(evaluate.confusion(cells).crossJoin(evaluate.auc(cells)).select(*CONFUSION, *AUC))


@query(f"""WITH {q.BASE}, {q.STALL}, {_DL}, {_EN.format('sti')}, {q.next_event('en')}, t AS (SELECT sti.row_id, sti.us, sti.node, round(score, 9) AS score, flag FROM sti JOIN dl USING (row_id)), {q.cells('g', 't')},
c AS (SELECT g.node, g.window_idx, bool_or(l.node IS NOT NULL) AS truth, bool_or(flag) AS flag, max(score) AS score FROM g LEFT JOIN (SELECT DISTINCT node, window_idx FROM stg) l ON l.node = g.node AND l.window_idx = g.window_idx GROUP BY ALL)
SELECT * FROM ({q.confusion('c', 'truth', 'flag')}) CROSS JOIN ({q.auc('c')})""")
def deeplog_injected(e):
    """The next-event detector against stalls, which don't change the order it sees."""
    moved, _, labelled = ex.injected(e, "stall")
    rows = ex.next_event_rows(e, moved).withColumn("score", F.round("score", 9))
    cells = evaluate.to_cells(evaluate.eval_grid(rows, SPARSE), flag="flag", score="score")
    cells = stage(evaluate.with_cell_truth(cells, labelled), "cells")
    return rounded(evaluate.confusion(cells).crossJoin(evaluate.auc(cells)).select(*CONFUSION, *AUC))


@query()
def recurrent_native(e):
    """The gated network against the events' own labels, on the test period's grid."""
    rows = ex.recurrent_rows(e, e, test_only=True)
    cells = stage(evaluate.to_cells(evaluate.eval_grid(rows, SPARSE), truth="anomaly", flag="flag", score="score"), "cells")
    return rounded(evaluate.confusion(cells).crossJoin(evaluate.auc(cells)).select(*CONFUSION, *AUC))


@query()
def next_event_likelihoods(e):
    """-log p of the test period's events, on average, under the gated network and the back-off model."""
    mean = lambda d, name: d.where("score > 0").agg(F.avg("score").alias("nll"), F.count("*").alias("n_events")).select(F.lit(name).alias("model"), "*")
    return mean(ex.recurrent_rows(e, e, test_only=True), "recurrent").unionByName(mean(ex.next_event_rows(e, e, test_only=True), "back_off"))


@query(f"""WITH {q.BASE}, {q.STALL}, {_DL}, {_EN.format('ev')}, {_EN.format('sti').replace('en AS', 'en2 AS')}, {q.contexts('h1', 'en')}, {q.contexts('h2', 'en2')}
SELECT count(*) AS n_common_windows, count(*) FILTER (h1.h <> h2.h) AS n_input_mismatches, count(*) FILTER (h1.template_id <> h2.template_id) AS n_target_mismatches FROM h1 JOIN h2 USING (row_id) WHERE len(h1.h) = 10 AND len(h2.h) = 10""")
def deeplog_invariance(e):
    """Inputs and targets of the next-event detector before and after stalls."""
    normal = sequence.chronological_split(e).where("is_train and not anomaly")
    vocab = stage(windows.sorted_vocabulary(normal), "vocabulary")
    seen = lambda d, n: sequence.sliding_sequences(windows.encode(d, vocab), 10).select("row_id", F.col("context").alias(f"c{n}"), F.col("target").alias(f"t{n}"))
    met = seen(e, 1).join(seen(ex.injected(e, "stall")[0], 2), "row_id")
    return met.agg(F.count("*").alias("n_common_windows"), F.count_if(F.col("c1") != F.col("c2")).alias("n_input_mismatches"), F.count_if(F.col("t1") != F.col("t2")).alias("n_target_mismatches"))


@query(f"""WITH {q.BASE}, {q.STALL}, {q.BURST} SELECT 'stall' AS type, 42 AS seed, 100 AS n_injections, 30000.0::DOUBLE AS max_mad_eff_s, (SELECT count(*) FROM stall_elig)::INT AS n_eligible, 'fixed_time' AS grid_scheme, 86400 AS grid_s
UNION ALL SELECT 'burst', 43, 100, 30000.0, (SELECT count(*) FROM burst_elig)::INT, 'fixed_time', 86400""")
def run_configs(e):
    """The configurations of both injection runs, as their JSON sink takes them."""
    nodes = ex.normal_gaps(context(e))[0]
    one = lambda k, least: inject.run_config(e.sparkSession, k, SPARSE, inject.eligible_nodes(e, nodes, least, SPARSE).count())
    return one("stall", SPARSE.stall_min_events).unionByName(one("burst", SPARSE.burst_min_events)).drop("intensities")
