"""The registered queries of the event-log operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates
from ..operators import audit, baseline, detect, evaluate, features, inject, sequence, windows
from ..schema import SPARSE
from ..sources import events as ev
from ..sources import logs
from ..sources.sinks import scratch, stage
from . import experiments as ex
from . import sql as q

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Detector figures that both engines report.
CONFUSION = ["tp", "fp", "fn", "tn", "n_cells", "precision", "recall", "flagged_frac", "f1", "lift"]
AUC = ["auc_roc", "auc_pr", "no_skill_baseline", "n_eval_cells", "n_positive_cells"]


def query(sql: str | None = None):
    """Register a query on the event table under its own name, with its SQL if there is one."""

    def register(f: Callable[[DataFrame], DataFrame]):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(events(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.from_event_stream(ev.read_events(spark, f"{sf_dir}/events.parquet"))


def us() -> Column:
    """The time stamp in microseconds (a function: columns can't be made before a session)."""
    return F.unix_micros("timestamp").alias("us")


def day_clock(e: DataFrame) -> DataFrame:
    """The events under a one-day clock: most gaps are zero."""
    return e.withColumn("timestamp", F.date_trunc("DAY", "timestamp"))


def r6(c: str | Column, digits: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return out.alias(name) if name else out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that sums in another order compare equal."""
    return df.select(*[r6(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes])


def context(e: DataFrame) -> DataFrame:
    return sequence.add_sequence_context(e)


# --- sequences -----------------------------------------------------------------


@query(f"WITH {q.EV}, {q.context('ctx', 'ev')} SELECT row_id, node, prev_template, next_template, prev_anomaly, gap_prev_s, gap_next_s FROM ctx")
def seq_context(e):
    return context(e).select("row_id", "node", *sequence.CONTEXT)


@query(f"""WITH {q.EV} SELECT count(*) AS n_rows, round(avg(anomaly::INT), 6) AS anomalous_fraction, count(DISTINCT node) AS n_nodes,
  count(DISTINCT event_template) AS n_templates, min(us) AS first_us, max(us) AS last_us FROM ev""")
def log_summary(e):
    s = logs.log_summary(e)
    return s.select("n_rows", r6("anomalous_fraction"), "n_nodes", "n_templates", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query(f"""WITH {q.EV}, {q.DAY}, {q.context('ctx', 'day')}, n AS (SELECT node, sum((gap_prev_s = 0)::INT) AS z, count(*) AS n FROM ctx WHERE gap_prev_s IS NOT NULL GROUP BY node)
SELECT round(sum(z) / sum(n), 6) AS zero_gap_fraction, round(avg(z / n), 6) AS mean_node_fraction, round(median(z / n), 6) AS median_node_fraction,
  round(100 * avg((z / n > 0.5)::INT), 6) AS pct_majority_zero_nodes FROM n""")
def zero_gap_diag(e):
    return rounded(sequence.zero_gap_summary(context(day_clock(e))))


@query(f"WITH {q.BASE} SELECT node, n, median, mad, status FROM nb")
def node_baselines(e):
    return ex.normal_gaps(context(e))[0]


@query(f"WITH {q.BASE} SELECT pooled_median, pooled_mad FROM pb")
def pooled_baseline(e):
    return ex.normal_gaps(context(e))[1]


@query(f"WITH {q.EV}, {q.DAY}, {q.context('ctx', 'day')}, {q.baselines('ctx', nonzero=True)} SELECT pooled_median, pooled_mad FROM pb")
def pooled_baseline_nonzero(e):
    from dataclasses import replace

    return ex.normal_gaps(context(day_clock(e)), replace(SPARSE, exclude_zero_from_pooled=True))[1]


@query(f"""WITH {q.EV}, {q.DAY}, {q.context('ctx', 'day')}, {q.baselines('ctx')}, a AS (SELECT DISTINCT node FROM ev WHERE anomaly)
SELECT count(*) AS n_nodes, count(*) FILTER (status = 'valid') AS n_valid, count(*) FILTER (status = 'low_count') AS n_low_count,
  count(*) FILTER (status = 'zero_mad') AS n_zero_mad, count(*) FILTER (status IS NULL) AS n_no_gaps FROM a LEFT JOIN nb USING (node)""")
def baseline_fallback_counts(e):
    return baseline.fallback_counts(e, ex.normal_gaps(context(day_clock(e)))[0])


@query(f"WITH {q.BASE} SELECT row_id, node, gap_prev_s, round(z_score, 6) AS z_score, abs(z_score) > 3.0 AS flag FROM z")
def timing_zscore(e):
    return detect.FixedZ().flag(ex.scored_timing(context(e))).select("row_id", "node", "gap_prev_s", r6("z_score"), "flag")


@query(f"WITH {q.BASE} SELECT row_id, node, round(log_ratio, 6) AS log_ratio FROM z")
def timing_log_ratio(e):
    return ex.scored_timing(context(e)).select("row_id", "node", r6("log_ratio"))


@query(f"WITH {q.BASE} SELECT node, count(*) FILTER (abs(z_score) > 3.0) AS n_flagged, count(*) AS n FROM z GROUP BY node")
def zscore_flags(e):
    return detect.FixedZ().flag(ex.scored_timing(context(e))).groupBy("node").agg(F.count_if("flag").alias("n_flagged"), F.count("*").alias("n"))


_NORMAL = "NOT anomaly AND NOT coalesce(prev_anomaly, true) AND gap_prev_s IS NOT NULL"


@query(f"""WITH {q.BASE}, {q.SPLIT}, t AS (SELECT quantile_cont(abs(log_ratio), 0.95) AS threshold FROM z, cut WHERE us <= cut.cutoff_us AND {_NORMAL})
SELECT node, count(*) FILTER (abs(log_ratio) > threshold) AS n_flagged, round(any_value(threshold), 6) AS threshold FROM z, t GROUP BY node""")
def logratio_flags(e):
    rows = sequence.chronological_split(ex.scored_timing(context(e)), SPARSE.train_fraction)
    d = detect.LogRatio()
    limit = detect.threshold(d.score(rows.where("is_train").where(sequence.normal_transition())))
    return detect.flag_above(d.score(rows), limit).groupBy("node").agg(F.count_if("flag").alias("n_flagged"), F.first("threshold").alias("threshold")).select("node", "n_flagged", r6("threshold"))


_ROLL = """roll AS (SELECT *, CASE WHEN count(gap_prev_s) OVER b >= 3 THEN avg(gap_prev_s) OVER b END AS rolling_mean,
  CASE WHEN count(gap_prev_s) OVER b >= 3 THEN stddev_samp(gap_prev_s) OVER b END AS rolling_std
  FROM {0} WINDOW b AS (PARTITION BY node ORDER BY us, row_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
ewm AS (SELECT a.row_id, count(b.gap_prev_s) AS k, sum(b.gap_prev_s * pow(1 - 2 / 21, a.position - b.position)) / sum(CASE WHEN b.gap_prev_s IS NOT NULL THEN pow(1 - 2 / 21, a.position - b.position) END) AS ewma
  FROM {0} a JOIN {0} b ON a.node = b.node AND b.position < a.position AND b.position >= a.position - 400 GROUP BY a.row_id),
feat AS (SELECT roll.*, CASE WHEN k >= 3 THEN gap_prev_s - ewma END AS ewma_residual FROM roll LEFT JOIN ewm USING (row_id))"""


@query(f"WITH {q.EV}, {q.context('ctx', 'ev')}, {_ROLL.format('ctx')} SELECT row_id, round(rolling_mean, 4) AS rolling_mean, round(rolling_std, 4) AS rolling_std FROM feat")
def rolling_features(e):
    return features.add_rolling_features(context(e)).select("row_id", r6("rolling_mean", 4), r6("rolling_std", 4))


@query(f"WITH {q.EV}, {q.context('ctx', 'ev')}, {_ROLL.format('ctx')} SELECT row_id, round(ewma_residual, 4) AS ewma_residual FROM feat")
def ewma_residual(e):
    return features.add_rolling_features(context(e)).select("row_id", r6("ewma_residual", 4))


@query(f"""WITH {q.BASE}, {_ROLL.format('z')} SELECT row_id, round((coalesce(rolling_mean, median) - median) / scale, 6) AS rolling_mean_z, round(coalesce(rolling_std, scale) / scale, 6) AS rolling_std_ratio,
  round(coalesce(ewma_residual, 0.0) / scale, 6) AS ewma_residual_z, round(z_score, 6) AS z_score, round(log_ratio, 6) AS log_ratio FROM feat""")
def timing_features(e):
    c = context(e)
    return rounded(features.build_features(c, *ex.normal_gaps(c), SPARSE).select("row_id", *features.FEATURES, "log_ratio"))


@query(f"WITH {q.EV}, {q.SPLIT} SELECT is_train, count(*) AS n, min(us) AS first_us, max(us) AS last_us, max(CAST(floor(cutoff_us) AS BIGINT)) AS cutoff_us FROM sp GROUP BY is_train")
def chrono_split(e):
    s = sequence.chronological_split(e).withColumn("us", F.unix_micros("timestamp"))
    return s.groupBy("is_train").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max(F.floor("cutoff_us")).alias("cutoff_us"))


@query(f"WITH {q.EV}, {q.SPLIT} SELECT max(us) AS last_train_us FROM sp WHERE is_train")
def recovered_cutoff(e):
    return sequence.recovered_cutoff(sequence.chronological_split(e)).select(F.unix_micros("last_train_ts").alias("last_train_us"))


@query(f"WITH {q.BASE}, {q.SPLIT} SELECT round(quantile_cont(abs(z_score), 0.95), 6) AS threshold FROM z, cut WHERE us <= cut.cutoff_us AND {_NORMAL}")
def train_normal_p95(e):
    rows = sequence.chronological_split(ex.scored_timing(context(e)))
    return rounded(detect.threshold(detect.FixedZ().score(rows.where("is_train").where(sequence.normal_transition()))))


@query(f"WITH {q.EV}, {q.context('ctx', 'ev')} SELECT row_id FROM ctx WHERE {_NORMAL}")
def normal_transitions(e):
    return context(e).where(sequence.normal_transition()).select("row_id")


@query(f"WITH {q.EV} SELECT row_id, us FROM ev ORDER BY us, row_id LIMIT 1000")
def chronological_prefix(e):
    return ev.chronological_prefix(e, 1000).select("row_id", us())


@query(f"""WITH {q.EV}, m AS (SELECT DISTINCT node FROM ev WHERE label = 'error' AND anomaly), r AS (SELECT row_id, node, row_number() OVER (ORDER BY (node NOT IN (SELECT node FROM m))::INT, node, us, row_id) AS k FROM ev)
SELECT row_id, node FROM r WHERE k <= 500""")
def node_subsample(e):
    return ev.node_subsample(e, 500, e.where("label = 'error' and anomaly")).select("row_id", "node")


# --- windows -------------------------------------------------------------------

_ROLLUP = "SELECT node, CAST(window_idx AS BIGINT) AS window_idx, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events, bool_or(anomaly) AS label FROM w GROUP BY node, window_idx"


def rolled(w: DataFrame) -> DataFrame:
    return windows.roll_up(w).select("node", "window_idx", F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "n_events", "label")


@query(f"WITH {q.EV}, w AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY us, row_id) - 1) // 10 AS window_idx FROM ev) {_ROLLUP}")
def windows_fixed_count(e):
    return rolled(windows.by_count(e, SPARSE.window_events))


@query(f"WITH {q.EV}, {q.cells('w', 'ev')} {_ROLLUP}")
def windows_fixed_time(e):
    return rolled(windows.by_time(e, SPARSE.grid_s))


@query(f"WITH {q.EV}, w AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY row_id) - 1) // 10 AS window_idx FROM ev) SELECT node, CAST(window_idx AS BIGINT) AS window_idx, count(*) AS n_events, bool_or(anomaly) AS label FROM w GROUP BY node, window_idx")
def windows_position(e):
    return windows.roll_up_positions(windows.by_position(e, SPARSE.window_events))


@query(f"WITH {q.EV}, {q.cells('w', 'ev')} SELECT row_id, node, window_idx FROM w")
def eval_grid(e):
    return evaluate.eval_grid(e, SPARSE).select("row_id", "node", "window_idx")


_VOCAB = "vocab AS (SELECT event_template, n, row_number() OVER (ORDER BY n DESC, f) - 1 AS term_id FROM (SELECT event_template, count(*) AS n, min(row_id) AS f FROM sp WHERE is_train GROUP BY event_template) ORDER BY term_id LIMIT {})"
_WIN = "win AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY us, row_id) - 1) // 10 AS window_idx FROM sp WHERE NOT is_train)"


def train_test(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = sequence.chronological_split(e)
    return s.where("is_train"), windows.by_count(s.where("not is_train"), SPARSE.window_events)


@query(f"WITH {q.EV}, {q.SPLIT}, {_VOCAB.format(20)} SELECT * FROM vocab")
def vocabulary_topk(e):
    return windows.vocabulary(train_test(e)[0], 20)


@query(f"WITH {q.EV}, {q.SPLIT}, {_VOCAB.format(20)}, {_WIN} SELECT node, CAST(window_idx AS BIGINT) AS window_idx, term_id, count(*) AS cnt FROM win JOIN vocab USING (event_template) GROUP BY ALL")
def count_long(e):
    train, test = train_test(e)
    return windows.term_counts(test, windows.vocabulary(train, 20))


@query(f"""WITH {q.EV}, {q.SPLIT}, {_VOCAB.format(5)}, {_WIN}, k AS (SELECT win.*, term_id IS NOT NULL AS known FROM win LEFT JOIN vocab USING (event_template)),
z AS (SELECT node, window_idx, NOT bool_or(known) AS empty, bool_or(anomaly) AS label FROM k GROUP BY node, window_idx)
SELECT (SELECT count(*) FROM vocab) AS vocabulary_size, (SELECT count(DISTINCT event_template) FROM sp WHERE is_train) AS n_train_templates, (SELECT count(DISTINCT event_template) FROM win) AS n_test_templates,
  (SELECT count(*) FROM (SELECT event_template FROM win EXCEPT SELECT event_template FROM sp WHERE is_train)) AS n_unseen, (SELECT round(100 * avg(known::INT), 6) FROM k) AS pct_events_covered,
  (SELECT round(100 * avg(empty::INT), 6) FROM z) AS pct_zero_windows, (SELECT round(100 * avg(empty::INT), 6) FROM z WHERE label) AS pct_zero_anomalous, (SELECT round(100 * avg(empty::INT), 6) FROM z WHERE NOT label) AS pct_zero_normal""")
def count_coverage_diag(e):
    train, test = train_test(e)
    return rounded(windows.coverage(train, test, windows.vocabulary(train, 5)))


@query(f"""WITH {q.EV}, {q.SPLIT}, {_VOCAB.format(5)}, {_WIN} SELECT node, CAST(window_idx AS BIGINT) AS window_idx, count(*) AS n_events, count(term_id) AS n_known
FROM win LEFT JOIN vocab USING (event_template) GROUP BY node, window_idx HAVING count(term_id) = 0""")
def oov_windows(e):
    train, test = train_test(e)
    met = test.join(windows.vocabulary(train, 5).select("event_template", "term_id"), "event_template", "left")
    return met.groupBy(*windows.CELL).agg(F.count("*").alias("n_events"), F.count("term_id").alias("n_known")).where("n_known = 0")


_SORTED = "sv AS (SELECT event_template, row_number() OVER (ORDER BY event_template) AS template_id FROM (SELECT DISTINCT event_template FROM sp WHERE is_train AND NOT anomaly))"


def encoded(e: DataFrame) -> DataFrame:
    s = sequence.chronological_split(e)
    return windows.encode(e, windows.sorted_vocabulary(s.where("is_train and not anomaly")))


@query(f"WITH {q.EV}, {q.SPLIT}, {_SORTED} SELECT row_id, node, coalesce(template_id, 0) AS template_id FROM ev LEFT JOIN sv USING (event_template)")
def encoded_templates(e):
    return encoded(e).select("row_id", "node", "template_id")


@query(f"""WITH {q.EV}, {q.SPLIT}, {_SORTED}, en AS (SELECT ev.*, coalesce(template_id, 0) AS template_id FROM ev LEFT JOIN sv USING (event_template))
SELECT row_id, node, array_to_string(context, ',') AS context, target FROM (SELECT row_id, node, template_id AS target, list(template_id) OVER (PARTITION BY node ORDER BY us, row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS context FROM en) WHERE len(context) = 10""")
def sliding_windows(e):
    return sequence.sliding_sequences(encoded(e), 10).select("row_id", "node", F.array_join(F.col("context").cast("array<string>"), ",").alias("context"), "target")


# --- audit ---------------------------------------------------------------------

_RARE = """fr AS (SELECT event_template, count(*) / (SELECT count(*) FROM ev WHERE NOT anomaly) AS f FROM ev WHERE NOT anomaly GROUP BY event_template),
ra AS (SELECT c.*, coalesce(f, 0.0) AS normal_freq, coalesce(f, 0.0) = 0 AS is_new, coalesce(f, 0.0) > 0 AND coalesce(f, 0.0) < 0.02 AS is_rare FROM z c LEFT JOIN fr USING (event_template))"""
_ORDER = """kn AS (SELECT DISTINCT node, event_template FROM ctx WHERE NOT anomaly),
bi AS (SELECT DISTINCT node, prev_template, event_template FROM ctx WHERE NOT anomaly AND NOT coalesce(prev_anomaly, true)),
oq AS (SELECT r.*, r.is_new OR r.is_rare AS new_or_rare, k1.node IS NOT NULL AND (r.prev_template IS NULL OR k2.node IS NOT NULL) AND (r.next_template IS NULL OR k3.node IS NOT NULL) AS all_known,
  (r.prev_template IS NOT NULL AND b1.node IS NULL) OR (r.next_template IS NOT NULL AND b2.node IS NULL) AS unseen
  FROM ra r LEFT JOIN kn k1 ON k1.node = r.node AND k1.event_template = r.event_template LEFT JOIN kn k2 ON k2.node = r.node AND k2.event_template = r.prev_template
  LEFT JOIN kn k3 ON k3.node = r.node AND k3.event_template = r.next_template LEFT JOIN bi b1 ON b1.node = r.node AND b1.prev_template = r.prev_template AND b1.event_template = r.event_template
  LEFT JOIN bi b2 ON b2.node = r.node AND b2.prev_template = r.event_template AND b2.event_template = r.next_template),
au AS (SELECT *, CASE WHEN NOT all_known THEN 'unknown_template' WHEN prev_template IS NULL AND next_template IS NULL THEN 'no_context' ELSE 'judged' END AS order_status,
  CASE WHEN all_known AND (prev_template IS NOT NULL OR next_template IS NOT NULL) THEN unseen END AS pure_order,
  CASE WHEN gap_prev_s IS NOT NULL OR gap_next_s IS NOT NULL THEN coalesce(abs((gap_prev_s - median) / scale) > 3.0, false) OR coalesce(abs((gap_next_s - median) / scale) > 3.0, false) END AS timing_gap FROM oq)"""
_AUDIT = f"{q.BASE}, {_RARE}, {_ORDER}"


@query(f"WITH {q.BASE}, {_RARE} SELECT row_id, round(normal_freq, 6) AS normal_freq, is_new, is_rare, is_new OR is_rare AS new_or_rare FROM ra")
def template_rarity(e):
    return audit.template_rarity(e, SPARSE).select("row_id", r6("normal_freq"), "is_new", "is_rare", "new_or_rare")


@query(f"WITH {_AUDIT} SELECT row_id, order_status, pure_order FROM au")
def pure_order(e):
    return audit.pure_order(context(e), in_order=True).select("row_id", "order_status", "pure_order")


@query(f"WITH {_AUDIT} SELECT row_id, timing_gap FROM au")
def timing_gap_signature(e):
    return ex.audited(context(e)).select("row_id", "timing_gap")


@query(f"""WITH {_AUDIT}, an AS (SELECT * FROM au WHERE anomaly), s AS (
  SELECT 'new_or_rare_template' AS signature, count(*) FILTER (new_or_rare) AS c, 0 AS i, 0 AS x, count(*) AS n FROM an
  UNION ALL SELECT 'pure_order_anomaly', count(*) FILTER (pure_order), count(*) FILTER (order_status = 'no_context'), count(*) FILTER (order_status = 'unknown_template'), count(*) FROM an
  UNION ALL SELECT 'timing_gap_anomaly', count(*) FILTER (timing_gap), count(*) FILTER (timing_gap IS NULL), 0, count(*) FROM an
  UNION ALL SELECT 'timing_only', count(*) FILTER (NOT new_or_rare AND pure_order = false AND timing_gap), 0, 0, count(*) FROM an)
SELECT signature, c AS count_flagged, round_even(100 * c / n, 2) AS pct_of_anomalies, CAST(i AS BIGINT) AS count_insufficient_context, CAST(x AS BIGINT) AS count_excluded_unknown_template FROM s""")
def audit_summary(e):
    return audit.audit_summary(ex.audited(context(e)))


@query(f"WITH {_AUDIT} SELECT new_or_rare, count(*) AS n, count(*) FILTER (timing_gap) AS n_timing, round(100 * count(*) FILTER (timing_gap) / count(*), 6) AS pct_timing FROM au WHERE anomaly GROUP BY new_or_rare")
def timing_by_content(e):
    return rounded(audit.timing_by_content(ex.audited(context(e))))


# --- injection -----------------------------------------------------------------


def eligible(e: DataFrame, kind: str) -> DataFrame:
    return inject.eligible_nodes(e, ex.normal_gaps(context(e))[0], SPARSE.stall_min_events if kind == "stall" else SPARSE.burst_min_events, SPARSE)


@query(f"WITH {q.BASE}, {q.plan('stall')}, {q.plan('burst')} SELECT 'stall' AS kind, node, node_n FROM stall_elig UNION ALL SELECT 'burst', node, node_n FROM burst_elig")
def eligible_nodes(e):
    one = lambda k: eligible(e, k).select(F.lit(k).alias("kind"), "node", "node_n")
    return one("stall").unionByName(one("burst"))


def hash_plan(e: DataFrame, kind: str) -> DataFrame:
    c = context(e)
    return inject.plan_by_hash(c, *ex.normal_gaps(c), kind, SPARSE).select("injection_id", "node", "start_pos", "burst_length", "intensity")


@query(f"WITH {q.BASE}, {q.plan('stall')} SELECT injection_id, node, start_pos, burst_length, intensity FROM stall_plan")
def inject_plan_stall(e):
    return hash_plan(e, "stall")


@query(f"WITH {q.BASE}, {q.plan('burst')} SELECT injection_id, node, start_pos, burst_length, intensity FROM burst_plan")
def inject_plan_burst(e):
    return hash_plan(e, "burst")


@query(f"WITH {q.BASE}, {q.STALL} SELECT row_id, node, us, injected_row FROM sti")
def inject_stall(e):
    return ex.injected(e, "stall")[0].select("row_id", "node", us(), "injected_row")


@query(f"WITH {q.BASE}, {q.BURST} SELECT row_id, node, us, injected_row FROM bui")
def inject_burst(e):
    return ex.injected(e, "burst")[0].select("row_id", "node", us(), "injected_row")


@query(f"""WITH {q.BASE}, {q.STALL} SELECT injection_id, node, start_us, end_us, intensity, round(node_mad_eff_s, 6) AS node_mad_eff_s, used_pooled AS used_pooled_fallback, delta_us / 1e6 AS delta_seconds,
  (next_us - start_us) / 1e6 AS original_gap_s, node_n - start_pos - 1 AS n_events_shifted, start_pos, node_n AS node_n_events FROM stl""")
def stall_labels(e):
    labels = ex.injected(e, "stall")[1]
    return labels.select(
        "injection_id", "node", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "intensity", r6("node_mad_eff_s"),
        "used_pooled_fallback", "delta_seconds", "original_gap_s", "n_events_shifted", "start_pos", "node_n_events",
    )


@query(f"""WITH {q.BASE}, {q.BURST} SELECT injection_id, node, start_us, end_us, intensity, burst_length, (old_us - end_us) / 1e6 AS total_time_saved_s, (end_us - start_us) / 1e6 AS compressed_span_s,
  start_pos, node_n AS node_n_events FROM bul""")
def burst_labels(e):
    labels = ex.injected(e, "burst")[1]
    return labels.select(
        "injection_id", "node", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "intensity", "burst_length",
        "total_time_saved_s", "compressed_span_s", "start_pos", "node_n_events",
    )


@query(f"WITH {q.BASE}, {q.STALL}, {q.BURST} SELECT 'stall' AS kind, injection_id, node, window_idx FROM stg UNION ALL SELECT 'burst', injection_id, node, window_idx FROM bgl")
def grid_labels(e):
    one = lambda k: ex.injected(e, k)[2].select(F.lit(k).alias("kind"), "injection_id", "node", "window_idx")
    return one("stall").unionByName(one("burst"))


_BACK = "count(*) FILTER (us < p) AS n_violations, count(DISTINCT CASE WHEN us < p THEN node END) AS n_nodes FROM (SELECT *, lag(us) OVER (PARTITION BY node ORDER BY old_position) AS p FROM {})"


@query(f"WITH {q.BASE}, {q.STALL}, {q.BURST} SELECT 'stall' AS kind, {_BACK.format('sti')} UNION ALL SELECT 'burst' AS kind, {_BACK.format('bui')}")
def ordering_check(e):
    old = inject.with_position(e).select("row_id", "position")
    one = lambda k: sequence.ordering_violations(ex.injected(e, k)[0].join(old, "row_id"), "position").select(F.lit(k).alias("kind"), "*")
    return one("stall").unionByName(one("burst"))


@query(f"""WITH {q.BASE}, {q.STALL}, {q.context('ictx', '(SELECT row_id, us, node, anomaly, event_template, injected_row FROM sti)')}, {q.scored('iz', 'ictx')},
{_RARE.replace("FROM z c", "FROM iz c").replace("FROM ev WHERE", "FROM ictx WHERE")}, {_ORDER.replace("FROM ctx WHERE", "FROM ictx WHERE")}
SELECT count(*) AS n_injected, round(avg(coalesce(new_or_rare, false)::INT), 6) AS template_rate, round(avg(coalesce(pure_order, false)::INT), 6) AS order_rate, round(avg(coalesce(timing_gap, false)::INT), 6) AS timing_rate
FROM au WHERE injected_row""")
def instrument_validation(e):
    nodes, pooled = ex.normal_gaps(context(e))
    moved = stage(context(ex.injected(e, "stall")[0]), "moved-context")
    rows = audit.timing_gap(baseline.with_baseline(audit.pure_order(audit.template_rarity(moved, SPARSE)), nodes, pooled), SPARSE)
    return rounded(audit.instrument_rates(rows))


@query(f"""WITH {q.BASE}, {q.STALL}, {q.cells('g', 'sti')}, l AS (SELECT DISTINCT node, window_idx FROM stg), p AS (SELECT DISTINCT node, window_idx FROM g)
SELECT count(*) AS n_labelled, count(*) FILTER (p.node IS NULL) AS n_undetectable, count(p.node) AS n_detectable, round(100 * count(*) FILTER (p.node IS NULL) / count(*), 6) AS pct_undetectable
FROM l LEFT JOIN p ON l.node = p.node AND l.window_idx = p.window_idx""")
def labeling_diagnostic(e):
    moved, _, labelled = ex.injected(e, "stall")
    return rounded(evaluate.labelling_diagnostic(labelled, evaluate.eval_grid(moved, SPARSE)))


# --- evaluation ----------------------------------------------------------------


def cells_of(e: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    clean = ex.Clean.of(e)
    moved, _, labelled = ex.injected(e, kind, clean=clean)
    return stage(ex.timing_cells(clean, moved, labelled), "cells"), labelled


_LONG = "SELECT 'z_score_threshold' AS detector, node, window_idx, z AS score, fz AS flag, truth FROM {0}_c UNION ALL SELECT 'log_ratio_threshold', node, window_idx, r, fr, truth FROM {0}_c"


def _confusion_query(kind: str):
    def run(e):
        return rounded(evaluate.confusion(ex.by_detector(cells_of(e, kind)[0]), by=["detector"]).select("detector", *CONFUSION))

    run.__name__ = f"core_result_{kind}"
    parts = q.STALL if kind == "stall" else q.BURST
    query(f"WITH {q.BASE}, {parts}, {q.scored_injected(kind)}, lo AS ({_LONG.format(kind)}) " + q.confusion("lo", "truth", "flag", "detector,", "detector"))(run)


def _auc_query(kind: str):
    def run(e):
        return rounded(evaluate.auc(ex.by_detector(cells_of(e, kind)[0]), ["detector"]).select("detector", *AUC))

    run.__name__ = f"auc_table_{kind}"
    parts = q.STALL if kind == "stall" else q.BURST
    z, r = (q.auc(f"(SELECT {c} AS score, truth FROM {kind}_c)", f"'{n}' AS detector,") for c, n in (("z", "z_score_threshold"), ("r", "log_ratio_threshold")))
    query(f"WITH {q.BASE}, {parts}, {q.scored_injected(kind)} {z} UNION ALL {r}")(run)


for _kind in ("stall", "burst"):
    _confusion_query(_kind)
    _auc_query(_kind)

_DET = "det AS (SELECT injection_id, count(*) AS n_cells, count(c.node) AS n_populated, coalesce(bool_or(fz), false) AS detected FROM stg l LEFT JOIN stall_c c ON c.node = l.node AND c.window_idx = l.window_idx GROUP BY injection_id)"
_STALL_C = f"{q.BASE}, {q.STALL}, {q.scored_injected('stall')}"


@query(f"WITH {_STALL_C}, {_DET} SELECT count(*) FILTER (detected) AS n_detected, count(*) AS n_injections, round(avg(detected::INT), 6) AS detection_rate FROM det")
def detection_rate(e):
    cells, labelled = cells_of(e, "stall")
    return rounded(evaluate.detection_rate(evaluate.detection(labelled, cells, "fz")))


@query(f"WITH {_STALL_C}, {_DET}, ff AS (SELECT avg(fz::INT) AS p FROM stall_c) SELECT round(avg(CASE WHEN n_populated > 0 THEN 1 - pow(1 - p, n_populated) ELSE 0.0 END), 6) AS expected_by_chance FROM det, ff")
def chance_detection(e):
    cells, labelled = cells_of(e, "stall")
    return rounded(evaluate.chance_rate(evaluate.detection(labelled, cells, "fz"), evaluate.confusion(cells, flag="fz")))


@query(f"""WITH {_STALL_C}, s AS (SELECT count(*) FILTER (fz AND fr) / count(*) FILTER (fz OR fr) AS jaccard, count(*) FILTER (fz AND truth) / count(*) FILTER (truth) AS ra, count(*) FILTER (fr AND truth) / count(*) FILTER (truth) AS rb,
  count(*) FILTER ((fz OR fr) AND truth) / count(*) FILTER (truth) AS re, count(*) FILTER (fz AND truth) / count(*) FILTER (fz) AS pa, count(*) FILTER (fr AND truth) / count(*) FILTER (fr) AS pb_,
  count(*) FILTER ((fz OR fr) AND truth) / count(*) FILTER (fz OR fr) AS pe FROM stall_c)
SELECT round(jaccard, 6) AS jaccard, round(ra, 6) AS recall_a, round(rb, 6) AS recall_b, round(re, 6) AS recall_either, round(pa, 6) AS precision_a, round(pb_, 6) AS precision_b, round(pe, 6) AS precision_either,
  round(re - ra, 6) AS recall_gain_over_a, round(re - rb, 6) AS recall_gain_over_b, round(pa - pe, 6) AS precision_cost_vs_a, round(pb_ - pe, 6) AS precision_cost_vs_b FROM s""")
def fusion_jaccard(e):
    cells, _ = cells_of(e, "stall")
    one = lambda f: cells.select(*windows.CELL, "truth", F.col(f).alias("flag"))
    return rounded(evaluate.fusion(one("fz"), one("fr")))


@query(f"WITH {q.EV}, {q.cells('g', 'ev')}, c AS (SELECT node, window_idx, bool_or(anomaly) AS truth, bool_or(label = 'error') AS flag FROM g GROUP BY node, window_idx) " + q.confusion("c", "truth", "flag"))
def grid_confusion(e):
    flagged = evaluate.eval_grid(e.withColumn("hit", F.col("label") == "error"), SPARSE)
    return rounded(evaluate.confusion(evaluate.to_cells(flagged, truth="anomaly", flag="hit")).select(*CONFUSION))


_SIZES = (43_200, 86_400, 172_800)


def grid_results(e: DataFrame) -> DataFrame:
    rows = stage(ex.scored_timing(context(e)), "scored")
    train = ex.training_period(rows).where(sequence.normal_transition())
    rows = rows.crossJoin(F.broadcast(detect.threshold(detect.LogRatio().score(train))))
    out = None
    for size in _SIZES:
        g = windows.by_time(rows.withColumns({"fz": F.abs("z_score") > 3.0, "fr": F.abs("log_ratio") > F.col("threshold")}), size)
        for d in ("fz", "fr"):
            one = evaluate.confusion(evaluate.to_cells(g, truth="anomaly", flag=d)).select(F.lit(size).alias("grid_size_s"), F.lit(d).alias("detector"), *CONFUSION)
            out = one if out is None else out.unionByName(one)
    return rounded(out)


_GRIDS = ",\n".join(f"{q.cells(f'g{s}', 'z', s)}, c{s} AS (SELECT node, window_idx, bool_or(anomaly) AS truth, bool_or(abs(z_score) > 3.0) AS fz, bool_or(abs(log_ratio) > threshold) AS fr FROM g{s}, lim GROUP BY node, window_idx)" for s in _SIZES)
_LIMIT = f"cut AS (SELECT quantile_cont(us, 0.7) AS cutoff_us FROM ev), lim AS (SELECT quantile_cont(abs(log_ratio), 0.95) AS threshold FROM z, cut WHERE us <= cut.cutoff_us AND {_NORMAL})"
_GRID_RESULTS = f"{q.BASE}, {_LIMIT}, {_GRIDS}, gr AS (" + " UNION ALL ".join(q.confusion(f"c{s}", "truth", d, f"{s} AS grid_size_s, '{d}' AS detector,") for s in _SIZES for d in ("fz", "fr")) + ")"


@query(f"WITH {_GRID_RESULTS} SELECT * FROM gr")
def grid_size_stability(e):
    return grid_results(e)


@query(f"WITH {_GRID_RESULTS}, k AS (SELECT grid_size_s, array_to_string(list(detector ORDER BY f1 DESC, detector DESC), '>') AS ranking FROM gr GROUP BY grid_size_s) SELECT grid_size_s, ranking, (SELECT count(DISTINCT ranking) = 1 FROM k) AS stable FROM k")
def f1_ranking(e):
    return evaluate.f1_stability(grid_results(e)).select("grid_size_s", F.array_join("ranking", ">").alias("ranking"), "stable")


@query(f"WITH {_GRID_RESULTS} SELECT detector, min(f1) AS f1_min, max(f1) AS f1_max, round(max(f1) - min(f1), 6) AS f1_range FROM gr GROUP BY detector")
def f1_swing(e):
    return rounded(evaluate.f1_swing(grid_results(e)))


@query(f"""WITH {q.BASE}, {q.STALL}, {q.cells('ga', 'ev')}, {q.cells('gb', 'sti')}, a AS (SELECT node, window_idx, count(*) AS s FROM ga GROUP BY ALL), b AS (SELECT node, window_idx, count(*) AS s FROM gb GROUP BY ALL)
SELECT count(*) AS n_common_windows, CAST(max(abs(a.s - b.s)) AS DOUBLE) AS max_abs_score_diff, count(*) FILTER (abs(a.s - b.s) > 1e-9) AS n_differing_windows FROM a JOIN b USING (node, window_idx)""")
def invariance_fixed_time(e):
    score = lambda d: windows.by_time(d, SPARSE.grid_s).groupBy(*windows.CELL).agg(F.count("*").cast("double").alias("score"))
    return evaluate.invariance(score(e), score(ex.injected(e, "stall")[0]))


@query(f"WITH {q.BASE}, {q.STALL}, {q.cells('ga', 'ev')}, {q.cells('gb', 'sti')} SELECT count(*) AS n_common_rows, count(*) FILTER (ga.window_idx <> gb.window_idx) AS n_reassigned FROM ga JOIN gb USING (row_id)")
def grid_reassignments(e):
    return evaluate.reassignments(windows.by_time(e, SPARSE.grid_s), windows.by_time(ex.injected(e, "stall")[0], SPARSE.grid_s))


@query(f"""WITH {q.BASE}, r AS (SELECT b.node, coalesce(b.status <> 'valid', true) AS up, CASE WHEN b.status = 'valid' THEN b.median ELSE pooled_median END / greatest(CASE WHEN b.status = 'valid' THEN b.mad ELSE pooled_mad END * 1.4826, 0.001) AS r FROM nb b, pb)
SELECT count(*) AS n_nodes, count(*) FILTER (up) AS n_pooled_fallback, round(min(r), 6) AS r_min, round(median(r), 6) AS r_median, round(avg(r), 6) AS r_mean, round(max(r), 6) AS r_max, round(avg((r > 3.0)::INT), 6) AS frac_r_above_limit FROM r""")
def r_ratio(e):
    nodes, pooled = ex.normal_gaps(context(e))
    return rounded(baseline.outlier_ratio_summary(baseline.outlier_ratio(nodes, pooled, SPARSE), SPARSE))


@query(f"""WITH {q.BASE}, {q.BURST}, {q.context('ictx', '(SELECT row_id, us, node, anomaly, event_template, injected_row FROM bui)')}, {q.scored('iz', 'ictx')}
SELECT l.injection_id, round(max(abs(z_score)), 6) AS max_abs_z, max(abs(z_score)) > 3.0 AS breach FROM bul l JOIN iz i ON i.node = l.node AND i.us BETWEEN l.start_us AND l.end_us GROUP BY l.injection_id""")
def span_breach(e):
    nodes, pooled = ex.normal_gaps(context(e))
    moved, labels, _ = ex.injected(e, "burst")
    rows = baseline.with_baseline(context(moved), nodes, pooled).withColumn("z", F.abs(F.coalesce(baseline.z_of("gap_prev_s", SPARSE), F.lit(0.0))))
    spans = labels.select("injection_id", "node", "start", "end")
    met = rows.join(F.broadcast(spans), "node").where("timestamp between start and end")
    return met.groupBy("injection_id").agg(r6(F.max("z")).alias("max_abs_z"), (F.max("z") > 3.0).alias("breach"))


# --- raw logs ------------------------------------------------------------------


def synthetic_lines(e: DataFrame, grammar: str) -> DataFrame:
    """Log lines in a grammar made from the events, so that parsing has something to read."""
    t, label, day = F.col("timestamp"), F.when(F.col("anomaly"), F.upper("label")).otherwise(F.lit("-")), F.date_format("timestamp", "yyyy.MM.dd")
    epoch = F.unix_seconds("timestamp").cast("string")
    node = F.concat(F.lit("R"), F.col("node"))
    if grammar == "bgl":
        parts = [label, epoch, day, node, F.date_format(t, "yyyy-MM-dd-HH.mm.ss.SSSSSS"), node, F.lit("RAS"), F.lit("KERNEL"), F.lit("INFO"), F.col("raw_message")]
    elif grammar == "thunderbird":
        parts = [label, epoch, day, node, F.date_format(t, "MMM"), F.date_format(t, "d"), F.date_format(t, "HH:mm:ss"), F.concat(F.lit("u@"), node), F.col("raw_message")]
    else:
        block = F.concat(F.lit("blk_-"), F.col("node"))
        body = F.concat(F.lit("Receiving block "), block, F.when(F.col("row_id") % 3 == 0, F.concat(F.lit(" dest: /10.0."), F.col("row_id") % 7, F.lit(".1"))).otherwise(F.lit("")))
        parts = [F.date_format(t, "yyMMdd"), F.date_format(t, "HHmmss"), F.lit("143"), F.lit("INFO"), body]
    return e.select("row_id", F.when(F.col("row_id") % 50 == 0, F.lit("broken line")).otherwise(F.concat_ws(" ", *parts)).alias("line"))


@query(f"WITH {q.EV} SELECT row_id, us, 'R' || node AS node, CASE WHEN anomaly THEN upper(label) ELSE '-' END AS label, anomaly, raw_message FROM ev WHERE row_id % 50 <> 0")
def parse_bgl(e):
    return logs.well_formed(logs.parse_bgl(synthetic_lines(e, "bgl"))).select("row_id", us(), "node", "label", "anomaly", "raw_message")


@query(f"WITH {q.EV} SELECT row_id, us - us % 1000000 AS us, 'R' || node AS node, CASE WHEN anomaly THEN upper(label) ELSE '-' END AS label, anomaly, raw_message FROM ev WHERE row_id % 50 <> 0")
def parse_thunderbird(e):
    return logs.well_formed(logs.parse_thunderbird(synthetic_lines(e, "thunderbird"))).select("row_id", us(), "node", "label", "anomaly", "raw_message")


@query(f"""WITH {q.EV} SELECT row_id, us - us % 1000000 AS us, CASE WHEN row_id % 3 = 0 THEN '10.0.' || (row_id % 7) || '.1' END AS node, 'blk_-' || node AS block_id,
  CASE WHEN CAST(node AS BIGINT) % 5 = 0 THEN 'Anomaly' WHEN CAST(node AS BIGINT) % 5 < 4 THEN 'Normal' END AS label, CAST(node AS BIGINT) % 5 = 0 AS anomaly FROM ev WHERE row_id % 50 <> 0""")
def parse_hdfs_labels(e):
    nodes = e.select("node").distinct()
    kind = F.when(F.col("node").cast("long") % 5 == 0, "Anomaly").when(F.col("node").cast("long") % 5 < 4, "Normal")
    labels = nodes.select(F.concat(F.lit("blk_-"), F.col("node")).alias("BlockId"), kind.alias("Label")).where("Label is not null")
    rows = logs.join_block_labels(logs.well_formed(logs.parse_hdfs(synthetic_lines(e, "hdfs"))), labels)
    return rows.select("row_id", us(), "node", "block_id", "label", "anomaly")


@query(f"""WITH {q.EV}, f AS (SELECT *, CASE WHEN row_id % 10 < 6 THEN 2 WHEN row_id % 10 < 8 THEN 0 WHEN row_id % 10 = 8 THEN 1 ELSE 3 END AS file FROM ev)
SELECT row_number() OVER (ORDER BY file, row_id) - 1 AS row_id, row_id || ' ' || node AS line FROM f""")
def numbered_lines(e):
    """Lines of files of very different size, numbered as one reader would from file to file."""
    tenth = F.col("row_id") % 10
    file = F.when(tenth < 6, 2).when(tenth < 8, 0).when(tenth == 8, 1).otherwise(3)
    lines = e.select(file.alias("file"), "row_id", F.concat_ws(" ", "row_id", "node").alias("value"))
    path = scratch(e.sparkSession, "log-files")
    lines.repartitionByRange(8, "file", "row_id").sortWithinPartitions("file", "row_id").drop("row_id").write.partitionBy("file").text(path)
    return logs.read_lines(e.sparkSession, f"{path}/*/*.txt")


@query(f"""WITH {q.EV}, l AS (SELECT 'blk_-' || node AS block_id, arg_max(CASE WHEN row_id % 4 < 2 THEN 'Anomaly' ELSE 'Normal' END, row_id) AS label FROM ev WHERE row_id % 3 = 0 GROUP BY node)
SELECT row_id, block_id, label, coalesce(label = 'Anomaly', false) AS anomaly FROM (SELECT row_id, 'blk_-' || node AS block_id FROM ev WHERE row_id % 50 <> 0) LEFT JOIN l USING (block_id)""")
def block_labels_last(e):
    """Of several labels of one block the last line stands."""
    kind = F.when(F.col("row_id") % 4 < 2, "Anomaly").otherwise("Normal")
    labels = e.where("row_id % 3 = 0").select("row_id", F.concat(F.lit("blk_-"), F.col("node")).alias("BlockId"), kind.alias("Label"))
    rows = logs.well_formed(logs.parse_hdfs(synthetic_lines(e, "hdfs")))
    return logs.join_block_labels(rows, labels, order="row_id").select("row_id", "block_id", "label", "anomaly")


@query(f"WITH {q.EV} SELECT g AS grammar, count(*) FILTER (row_id % 50 = 0) AS n_malformed, count(*) AS n_lines FROM ev, (VALUES ('bgl'), ('thunderbird'), ('hdfs')) t(g) GROUP BY g")
def malformed_lines(e):
    parsers = {"bgl": logs.parse_bgl, "thunderbird": logs.parse_thunderbird, "hdfs": logs.parse_hdfs}
    out = None
    for g, parse in parsers.items():
        one = parse(synthetic_lines(e, g)).agg(F.count_if("malformed").alias("n_malformed"), F.count("*").alias("n_lines")).select(F.lit(g).alias("grammar"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {q.EV}, h AS (SELECT row_id, us - us % 1000000 AS us, 'blk_-' || node AS node, event_template, anomaly, raw_message FROM ev WHERE row_id % 50 <> 0), {q.context('ctx', 'h')}
SELECT node, count(*) AS n, round(avg(gap_prev_s), 6) AS mean_gap_s FROM ctx GROUP BY node""")
def session_gaps(e):
    rows = ev.by_session(logs.well_formed(logs.parse_hdfs(synthetic_lines(e, "hdfs"))))
    rows = context(rows.select("row_id", "timestamp", "node", F.lit(False).alias("anomaly"), F.lit("").alias("event_template")))
    return rounded(rows.groupBy("node").agg(F.count("*").alias("n"), F.avg("gap_prev_s").alias("mean_gap_s")))


# --- models, and what else SQL can't express --------------------------------------


@query()
def pca_scores(e):
    return rounded(ex.count_detector_windows(e, detect.CountPCA(SPARSE.pca_components)).select("node", "window_idx", "score", "flag"))


@query()
def iforest_scores(e):
    return ex.count_detector_windows(e, detect.IsolationForest("counts", SPARSE.trees)).select("node", "window_idx", "score", "flag")


@query()
def timing_iforest_scores(e):
    return ex.timing_forest(e).select("row_id", "node", "score", "flag")


@query()
def iforest_diag(e):
    scored = ex.count_detector_windows(e, detect.IsolationForest("counts", SPARSE.trees)).withColumn("n_known", F.aggregate(_values("counts"), F.lit(0.0), lambda a, x: a + x))
    limit = scored.agg(F.first("threshold").alias("threshold"))
    return detect.group_statistics(scored.drop("threshold"), "label", limit)


def _values(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


@query()
def inject_plan_generator(e):
    c = context(e)
    return inject.plan_by_generator(c, *ex.normal_gaps(c), "stall", SPARSE)


def _messages(e):
    return e.select("row_id", "node", F.concat_ws(" ", "label", "raw_message").alias("raw_message"))


@query()
def drain_templates(e):
    """One miner over the whole stream: each row's template as known at its line."""
    return templates.mine_stream(_messages(e)).select("row_id", "event_template")


@query()
def drain_templates_final(e):
    """The same groups by their templates at the end of the stream."""
    return templates.mine_stream(_messages(e)).select("row_id", "template_id", F.col("final_template").alias("event_template"))


@query()
def drain_templates_by_node(e):
    """Each node's stream is mined by itself, in order."""
    return templates.mine_online(_messages(e), group="node").select("row_id", "event_template")


@query()
def drain_templates_parallel(e):
    """Templates learned from the whole stream, then matched to each message without its place in the stream."""
    rows = _messages(e)
    return templates.assign_templates(rows, templates.train_templates(rows)).select("row_id", "event_template")


def queries() -> dict[str, Query]:
    """Every query of the event-log operators."""
    from . import audits, results  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their DuckDB SQL, where SQL can express them."""
    from . import audits, results  # noqa: F401

    return dict(_SQL)
