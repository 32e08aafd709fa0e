"""Audits and validations of the coarse-clock and the session-keyed log, beside those of the first log."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, baseline, inject, sequence
from ..schema import SPARSE, SPARSE_SECOND, Profile
from ..sources import events as ev
from ..sources.sinks import stage, together
from . import experiments as ex
from . import sql as q
from .queries import _AUDIT, _BACK, _ORDER, _RARE, _SQL, context, query, rounded
from .results import FAULTS, hour_clock

#: Sessions that the events are dealt to, for the session-keyed log.
SESSIONS = 7


def sessions(e: DataFrame) -> DataFrame:
    """Events keyed by a session that several users share, in place of a node."""
    return ev.by_session(e.withColumn("block_id", F.concat(F.lit("blk_"), F.pmod(F.col("node").cast("long"), F.lit(SESSIONS)).cast("string"))))


def _session(sql: str) -> str:
    return sql.replace("CAST(user_id AS VARCHAR) AS node", f"'blk_' || CAST(user_id % {SESSIONS} AS VARCHAR) AS node")


#: Name of a log, its events, its profile, and what a statement on the first log is on it.
LOGS: dict[str, tuple[Callable[[DataFrame], DataFrame], Profile, Callable[[str], str]]] = {
    "second": (hour_clock, SPARSE_SECOND, q.second),
    "session": (sessions, SPARSE, _session),
}
_ZERO_GAPS = f"""WITH {q.EV}, {q.context('ctx', 'ev')}, n AS (SELECT node, sum((gap_prev_s = 0)::INT) AS z, count(*) AS n FROM ctx WHERE gap_prev_s IS NOT NULL GROUP BY node)
SELECT round(sum(z) / sum(n), 6) AS zero_gap_fraction, round(avg(z / n), 6) AS mean_node_fraction, round(median(z / n), 6) AS median_node_fraction,
  round(100 * avg((z / n > 0.5)::INT), 6) AS pct_majority_zero_nodes FROM n"""
_FALLBACK = f"""WITH {q.BASE}, a AS (SELECT DISTINCT node FROM ev WHERE anomaly)
SELECT count(*) AS n_nodes, count(*) FILTER (status = 'valid') AS n_valid, count(*) FILTER (status = 'low_count') AS n_low_count,
  count(*) FILTER (status = 'zero_mad') AS n_zero_mad, count(*) FILTER (status IS NULL) AS n_no_gaps FROM a LEFT JOIN nb USING (node)"""


def _audits(name: str) -> None:
    """The four tables of one log's premise audit."""
    keyed, profile, sql = LOGS[name]

    def summary(e):
        return audit.audit_summary(ex.audited(context(keyed(e)), profile))

    def by_content(e):
        return rounded(audit.timing_by_content(ex.audited(context(keyed(e)), profile)))

    def zero_gaps(e):
        return rounded(sequence.zero_gap_summary(context(keyed(e))))

    def fallback(e):
        c = stage(context(keyed(e)), "context")
        return baseline.fallback_counts(c, ex.normal_gaps(c, profile)[0])

    for f, table, text in (
        (summary, "audit_summary", _SQL["audit_summary"]), (by_content, "timing_by_content", _SQL["timing_by_content"]), (zero_gaps, "zero_gap_diag", _ZERO_GAPS), (fallback, "baseline_fallback_counts", _FALLBACK),
    ):
        f.__name__ = f"{name}_{table}"
        query(sql(text))(f)


for _name in LOGS:
    _audits(_name)

_SHARE = "SELECT signature, pct_of_anomalies AS {0}_pct FROM ({1})"


@query(
    "SELECT * FROM (" + _SHARE.format("first", _SQL["audit_summary"]) + ")"
    + "".join(f" JOIN ({_SHARE.format(n, _SQL[f'{n}_audit_summary'])}) USING (signature)" for n in LOGS)
)
def audit_comparison(e):
    """The share of anomalies that bear each signature, log by log."""
    share = lambda d, name: d.select("signature", F.col("pct_of_anomalies").alias(f"{name}_pct"))
    logs = {"first": (lambda d: d, SPARSE), **{name: log[:2] for name, log in LOGS.items()}}
    of = lambda name, keyed, profile: stage(share(audit.audit_summary(ex.audited(context(keyed(e)), profile)), name), "shares")
    return reduce(lambda a, b: a.join(b, "signature"), together(*[partial(of, name, *log) for name, log in logs.items()]))


# --- what the instruments say of injected rows ----------------------------------------

_MOVED = {"stall": (q.STALL, "sti"), "burst": (q.BURST, "bui")}


def _instruments(kind: str) -> str:
    """The rates of the three signatures over injected rows of one fault."""
    parts, moved = _MOVED[kind]
    return f"""WITH {q.BASE}, {parts}, {q.context('ictx', f'(SELECT row_id, us, node, anomaly, event_template, injected_row FROM {moved})')}, {q.scored('iz', 'ictx')},
{_RARE.replace("FROM z c", "FROM iz c").replace("FROM ev WHERE", "FROM ictx WHERE")}, {_ORDER.replace("FROM ctx WHERE", "FROM ictx WHERE")}
SELECT count(*) AS n_injected, round(avg(coalesce(new_or_rare, false)::INT), 6) AS template_rate, round(avg(coalesce(pure_order, false)::INT), 6) AS order_rate, round(avg(coalesce(timing_gap, false)::INT), 6) AS timing_rate
FROM au WHERE injected_row"""


def instrument_rates(e: DataFrame, kind: str, profile: Profile) -> DataFrame:
    """One row: how many injected rows of a fault bear each signature, against the clean log's baselines."""
    clean = stage(context(e), "context")
    nodes, pooled = ex.normal_gaps(clean, profile)
    moved = stage(context(ex.injected(e, kind, profile)[0]), "moved-context")
    rows = audit.pure_order(audit.template_rarity(moved, profile))
    return rounded(audit.instrument_rates(audit.timing_gap(baseline.with_baseline(rows, nodes, pooled), profile)))


def _validations(kind: str) -> None:
    def first(e):
        return instrument_rates(e, kind, SPARSE)

    def second(e):
        return instrument_rates(hour_clock(e), kind, SPARSE_SECOND)

    first.__name__, second.__name__ = f"instrument_validation_{kind}", f"second_instrument_validation_{kind}"
    query(_instruments(kind))(first)
    query(q.second(_instruments(kind)))(second)


for _kind in FAULTS:
    _validations(_kind)


@query(q.second(f"WITH {q.BASE}, {q.STALL}, {q.BURST} SELECT 'stall' AS kind, {_BACK.format('sti')} UNION ALL SELECT 'burst' AS kind, {_BACK.format('bui')}"))
def second_ordering_check(e):
    """Events of the coarse-clock log that an injection has put before the one that they followed."""
    e = hour_clock(e)
    old = inject.with_position(e).select("row_id", "position")
    one = lambda k: sequence.ordering_violations(ex.injected(e, k, SPARSE_SECOND)[0].join(old, "row_id"), "position").select(F.lit(k).alias("kind"), "*")
    return one("stall").unionByName(one("burst"))
