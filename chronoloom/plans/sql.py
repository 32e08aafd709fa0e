"""Shared parts of the DuckDB statements: one common table expression for each step."""

from __future__ import annotations

EV = """ev AS (
  SELECT event_id AS row_id, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS node, event_type AS label, value > 150.0 AS anomaly,
    event_type || ':' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS VARCHAR) AS event_template, props AS raw_message
  FROM events)"""
#: The same with a one-day clock, so that most gaps are zero.
DAY = """day AS (SELECT row_id, us - us % 86400000000 AS us, node, label, anomaly, event_template, raw_message FROM ev)"""


def context(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT *, lag(event_template) OVER w AS prev_template, lead(event_template) OVER w AS next_template, lag(anomaly) OVER w AS prev_anomaly,
    (us - lag(us) OVER w) / 1e6 AS gap_prev_s, (lead(us) OVER w - us) / 1e6 AS gap_next_s, row_number() OVER w - 1 AS position
  FROM {source} WINDOW w AS (PARTITION BY node ORDER BY us, row_id))"""


def baselines(source: str, where: str = "true", p: str = "", nonzero: bool = False) -> str:
    """Node baselines {p}nb and pooled baseline {p}pb of normal transitions."""
    pool = f"(SELECT * FROM {p}nt WHERE gap_prev_s > 0)" if nonzero else f"{p}nt"
    return f"""{p}nt AS (SELECT node, gap_prev_s FROM {source} WHERE NOT anomaly AND NOT coalesce(prev_anomaly, true) AND gap_prev_s IS NOT NULL AND {where}),
{p}nm AS (SELECT node, count(*) AS n, median(gap_prev_s) AS median FROM {p}nt GROUP BY node),
{p}nd AS (SELECT t.node, median(abs(t.gap_prev_s - m.median)) AS mad FROM {p}nt t JOIN {p}nm m USING (node) GROUP BY t.node),
{p}nb AS (SELECT node, n, median, mad, CASE WHEN n < 10 THEN 'low_count' WHEN mad > 0 THEN 'valid' ELSE 'zero_mad' END AS status FROM {p}nm JOIN {p}nd USING (node)),
{p}pm AS (SELECT median(gap_prev_s) AS pooled_median FROM {pool} x),
{p}pb AS (SELECT any_value(pooled_median) AS pooled_median, median(abs(gap_prev_s - pooled_median)) AS pooled_mad FROM {pool} x, {p}pm)"""


def scored(name: str, source: str, p: str = "") -> str:
    """Rows with the baseline that applies, its scale, z and log ratio."""
    return f"""{name} AS (
  SELECT *, (gap_prev_s - median) / scale AS z_raw, coalesce((gap_prev_s - median) / scale, 0.0) AS z_score,
    CASE WHEN gap_prev_s IS NULL THEN 0.0 ELSE round(ln(greatest(gap_prev_s, 0.001) / greatest(median, 0.001)), 12) END AS log_ratio
  FROM (
    SELECT c.*, CASE WHEN b.status = 'valid' THEN b.median ELSE pooled_median END AS median,
      greatest(CASE WHEN b.status = 'valid' THEN b.mad ELSE pooled_mad END * 1.4826, 0.001) AS scale, coalesce(b.status <> 'valid', true) AS used_pooled
    FROM {source} c LEFT JOIN {p}nb b USING (node) CROSS JOIN {p}pb))"""


def cells(name: str, source: str, seconds: int = 86400) -> str:
    """Rows with their time cell."""
    return f"""{name} AS (SELECT *, CAST(floor((us - min(us) OVER (PARTITION BY node)) / 1e6 / {seconds}.0) AS BIGINT) AS window_idx FROM {source})"""


SPLIT = """cut AS (SELECT quantile_cont(us, 0.7) AS cutoff_us FROM ev), sp AS (SELECT ev.*, us <= cutoff_us AS is_train, cutoff_us FROM ev, cut)"""
BASE = ",\n".join([EV, context("ctx", "ev"), baselines("ctx"), scored("z", "ctx")])

_HEX = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"


def plan(kind: str, seed: int | None = None) -> str:
    """{kind}_plan: the hashed plan of stalls or bursts."""
    stall = kind == "stall"
    seed = (42 if stall else 43) if seed is None else seed
    least, lo, hi, tail = (30, 0.2, 0.8, 0) if stall else (55, 0.2, 0.7, 1)
    length = "1" if stall else f"[10, 15, 20, 25][1 + {_HEX.format(f"'{seed}|length|' || node")} % 4]"
    leads = "lead(farsum, 1) OVER w" if stall else "CASE burst_length " + " ".join(f"WHEN {n} THEN lead(farsum, {n}) OVER w" for n in (10, 15, 20, 25)) + " END"
    k = kind
    return f"""{k}_elig AS (SELECT node, count(*) AS node_n FROM ev WHERE node IN (SELECT node FROM nb WHERE greatest(mad * 1.4826, 0.001) <= 30000.0) GROUP BY node HAVING count(*) >= {least}),
{k}_chosen AS (SELECT row_number() OVER (ORDER BY md5('{seed}|' || node), node) - 1 AS injection_id, node, node_n, {length} AS burst_length,
  [10.0, 15.0, 20.0, 25.0, 30.0][1 + {_HEX.format(f"'{seed}|intensity|' || node")} % 5]::DOUBLE AS intensity FROM {k}_elig ORDER BY 1 LIMIT 100),
{k}_far AS (SELECT z.*, injection_id, node_n, burst_length, intensity, coalesce(sum(CASE WHEN abs(z_raw) > 3.0 THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY position), 0) AS farsum
  FROM z JOIN {k}_chosen USING (node)),
{k}_try AS (SELECT *, CASE WHEN {leads} - farsum > 0 THEN 1 ELSE 0 END AS bad FROM {k}_far WINDOW w AS (PARTITION BY node ORDER BY position)),
{k}_plan AS (SELECT injection_id, node, node_n, burst_length, intensity, position AS start_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY bad, md5('{seed}|start|' || node || '|' || position)) AS pick FROM {k}_try
  WHERE position >= floor(node_n * {lo}) AND position < least(greatest(floor(node_n * {hi}), floor(node_n * {lo}) + 1), node_n - burst_length - {tail})) WHERE pick = 1)"""


STALL = plan("stall") + """,
sps AS (SELECT p.*, coalesce(b.status <> 'valid', true) AS used_pooled, greatest(CASE WHEN b.status = 'valid' THEN b.mad ELSE pooled_mad END * 1.4826, 0.001) AS node_mad_eff_s
  FROM stall_plan p LEFT JOIN nb b USING (node) CROSS JOIN pb),
spd AS (SELECT *, CAST(round_even(intensity * node_mad_eff_s * 1e6, 0) AS BIGINT) AS delta_us FROM sps),
sti AS (SELECT c.row_id, c.us + CASE WHEN c.position > p.start_pos THEN p.delta_us ELSE 0 END AS us, c.node, c.label, c.anomaly, c.event_template, c.raw_message,
  coalesce(c.position = p.start_pos + 1, false) AS injected_row, c.position AS old_position, c.us AS old_us FROM ctx c LEFT JOIN spd p USING (node)),
stl AS (SELECT p.injection_id, p.node, p.intensity, p.node_mad_eff_s, p.used_pooled, p.delta_us, p.start_pos, p.node_n, a.old_us AS start_us, b.us AS end_us, b.old_us AS next_us
  FROM spd p JOIN sti a ON a.node = p.node AND a.old_position = p.start_pos JOIN sti b ON b.node = p.node AND b.old_position = p.start_pos + 1),
stg AS (SELECT injection_id, node, unnest(range(CAST(floor((start_us - t0) / 1e6 / 86400.0) AS BIGINT), CAST(floor((end_us - t0) / 1e6 / 86400.0) AS BIGINT) + 1)) AS window_idx
  FROM stl JOIN (SELECT node, min(us) AS t0 FROM sti GROUP BY node) USING (node))"""

BURST = plan("burst") + """,
bug AS (SELECT c.*, p.start_pos, p.intensity, coalesce(c.position > p.start_pos AND c.position <= p.start_pos + p.burst_length, false) AS injected_row,
  c.us - lag(c.us) OVER (PARTITION BY c.node ORDER BY c.us, c.row_id) AS gap_us FROM ctx c LEFT JOIN burst_plan p USING (node)),
bus AS (SELECT *, sum(CASE WHEN injected_row THEN gap_us - CAST(round_even(gap_us / intensity, 0) AS BIGINT) ELSE 0 END) OVER (PARTITION BY node ORDER BY us, row_id) AS saved FROM bug),
bui AS (SELECT row_id, CAST(us - saved AS BIGINT) AS us, node, label, anomaly, event_template, raw_message, injected_row, position AS old_position, us AS old_us FROM bus),
bul AS (SELECT p.injection_id, p.node, p.intensity, p.burst_length, p.start_pos, p.node_n, a.us AS start_us, b.us AS end_us, b.old_us
  FROM burst_plan p JOIN bui a ON a.node = p.node AND a.old_position = p.start_pos JOIN bui b ON b.node = p.node AND b.old_position = p.start_pos + p.burst_length),
bgl AS (SELECT injection_id, node, unnest(range(CAST(floor((start_us - t0) / 1e6 / 86400.0) AS BIGINT), CAST(floor((end_us - t0) / 1e6 / 86400.0) AS BIGINT) + 1)) AS window_idx
  FROM bul JOIN (SELECT node, min(us) AS t0 FROM bui GROUP BY node) USING (node))"""


def scored_injected(kind: str) -> str:
    """{kind}_c: cells of the injected data with truth and both timing detectors' scores and flags.

    Baselines and the log-ratio limit come from the clean training period.
    """
    src, grid = ("sti", "stg") if kind == "stall" else ("bui", "bgl")
    k = kind
    return ",\n".join(
        [
            "cut AS (SELECT quantile_cont(us, 0.7) AS cutoff_us FROM ev)",
            baselines("ctx", "us <= (SELECT cutoff_us FROM cut)", "t_"),
            scored(f"{k}_tr", "(SELECT * FROM ctx WHERE us <= (SELECT cutoff_us FROM cut) AND NOT anomaly AND NOT coalesce(prev_anomaly, true) AND gap_prev_s IS NOT NULL)", "t_"),
            f"{k}_th AS (SELECT quantile_cont(abs(log_ratio), 0.95) AS threshold FROM {k}_tr)",
            context(f"{k}_ic", f"(SELECT row_id, us, node, anomaly, event_template, injected_row FROM {src})"),
            scored(f"{k}_iz", f"{k}_ic", "t_"),
            cells(f"{k}_g", f"{k}_iz"),
            f"""{k}_c AS (SELECT g.node, g.window_idx, max(abs(z_score)) AS z, bool_or(abs(z_score) > 3.0) AS fz, max(abs(log_ratio)) AS r, bool_or(abs(log_ratio) > threshold) AS fr,
  bool_or(l.node IS NOT NULL) AS truth FROM {k}_g g CROSS JOIN {k}_th LEFT JOIN (SELECT DISTINCT node, window_idx FROM {grid}) l ON l.node = g.node AND l.window_idx = g.window_idx GROUP BY g.node, g.window_idx)""",
        ]
    )


def confusion(source: str, truth: str, flag: str, lead: str = "", group: str = "") -> str:
    """The confusion figures of cells."""
    g = f"GROUP BY {group}" if group else ""
    return f"""SELECT {lead} tp, fp, fn, tn, n_cells, round(precision, 6) AS precision, round(recall, 6) AS recall, round(flagged_frac, 6) AS flagged_frac,
  round(CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1, round(CASE WHEN flagged_frac <> 0 THEN recall / flagged_frac END, 6) AS lift
FROM (SELECT *, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN n_cells <> 0 THEN (tp + fp) / n_cells ELSE 0.0 END AS flagged_frac
FROM (SELECT {group + "," if group else ""} count(*) FILTER ({truth} AND {flag}) AS tp, count(*) FILTER (NOT {truth} AND {flag}) AS fp, count(*) FILTER ({truth} AND NOT {flag}) AS fn,
  count(*) FILTER (NOT {truth} AND NOT {flag}) AS tn, count(*) AS n_cells FROM {source} {g}))"""


def auc(source: str, lead: str = "") -> str:
    """ROC-AUC and step average precision of (score, truth)."""
    return f"""SELECT {lead} round(sum(pos * (neg_below + 0.5 * neg)) / (max(n_pos)::DOUBLE * max(n_neg)), 6) AS auc_roc, round(sum((pos / n_pos) * (tp / (tp + fp))), 6) AS auc_pr,
  round(max(n_pos) / (max(n_pos) + max(n_neg)), 6) AS no_skill_baseline, CAST(max(n_pos) + max(n_neg) AS BIGINT) AS n_eval_cells, CAST(max(n_pos) AS BIGINT) AS n_positive_cells
FROM (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS neg_below, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
  FROM (SELECT score, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM {source} GROUP BY score))"""


def second(sql: str) -> str:
    """A statement under a one-hour clock and the rules of a log with a coarse clock.

    Zero gaps stay out of the pooled baseline, only nodes with a valid baseline are
    injected, and moved times are cut to milliseconds.
    """
    cut = lambda us: f"({us}) - ({us}) % 1000"
    for old, new in (
        ("epoch_us(ts) AS us", "epoch_us(ts) - epoch_us(ts) % 3600000000 AS us"),
        ("FROM nt x", "FROM (SELECT * FROM nt WHERE gap_prev_s > 0) x"),
        ("FROM t_nt x", "FROM (SELECT * FROM t_nt WHERE gap_prev_s > 0) x"),
        ("SELECT node FROM nb WHERE greatest(", "SELECT node FROM nb WHERE status = 'valid' AND greatest("),
        ("c.us + CASE WHEN c.position > p.start_pos THEN p.delta_us ELSE 0 END AS us", f"CASE WHEN c.position > p.start_pos THEN {cut('c.us + p.delta_us')} ELSE c.us END AS us"),
        ("CAST(us - saved AS BIGINT) AS us", f"CASE WHEN saved <> 0 THEN {cut('CAST(us - saved AS BIGINT)')} ELSE us END AS us"),
    ):
        sql = sql.replace(old, new)
    return sql


def contexts(name: str, source: str, order: int = 10) -> str:
    """Rows (row_id, node, template_id, before, h): the ids of up to ``order`` events before each."""
    return f"""{name} AS (SELECT row_id, node, template_id, row_number() OVER w - 1 AS before,
  coalesce(list(template_id) OVER (PARTITION BY node ORDER BY us, row_id ROWS BETWEEN {order} PRECEDING AND 1 PRECEDING), []) AS h FROM {source} WINDOW w AS (PARTITION BY node ORDER BY us, row_id))"""


def next_event(source: str, order: int = 10, history: int = 10, top_k: int = 9) -> str:
    """dl: (row_id, node, score, flag) of the next-event detector over ``source`` (encoded as en), learned from tr_en."""
    asked = f"SELECT *, h[len(h) - n + 1:] AS ctx FROM {{0}}, range(0, {order + 1}) t(n) WHERE n <= len(h)"
    return f"""{contexts('tr_h', 'tr_en', order)}, {contexts('en_h', source, order)},
tc AS (SELECT ctx, template_id AS target, count(*) AS cnt FROM ({asked.format('tr_h')}) GROUP BY ALL),
tk AS (SELECT *, sum(cnt) OVER (PARTITION BY ctx) AS total, count(*) OVER (PARTITION BY ctx) AS kinds, row_number() OVER (PARTITION BY ctx ORDER BY cnt DESC, target) AS rank FROM tc),
tt AS (SELECT ctx, any_value(total) AS total, any_value(kinds) AS kinds FROM tk GROUP BY ctx),
seen AS (SELECT a.*, total, kinds, row_number() OVER (PARTITION BY row_id ORDER BY n DESC) AS pick FROM ({asked.format('en_h')}) a JOIN tt USING (ctx)),
dl AS (SELECT s.row_id, s.node, CASE WHEN before >= {history} THEN -ln((coalesce(cnt, 0) + 1.0) / (s.total + 1.0 * ((SELECT count(*) FROM sv) + 1))) ELSE 0.0 END AS score,
  before >= {history} AND coalesce(rank, s.kinds + 1) > least({top_k}, (SELECT count(*) FROM sv) + 1) AS flag
  FROM (SELECT * FROM seen WHERE pick = 1) s LEFT JOIN tk ON tk.ctx = s.ctx AND tk.target = s.template_id)"""
