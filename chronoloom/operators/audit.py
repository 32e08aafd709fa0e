"""Audit signatures of labelled anomalies: content, order and timing.

Flags are three-valued: null says that a row can't be judged, which differs from
not flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..schema import SYSTEM_LOG, Profile
from .baseline import z_of
from .sequence import add_position


def template_rarity(events: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """``is_new`` (never normal), ``is_rare`` (rarer than the limit among normal events), ``new_or_rare``."""
    normal = events.where("not anomaly")
    counts = normal.groupBy("event_template").agg(F.count("*").alias("_n"))
    total = normal.agg(F.count("*").alias("_total"))
    frequency = F.coalesce(F.col("_n") / F.col("_total"), F.lit(0.0))
    flagged = events.join(counts, "event_template", "left").crossJoin(F.broadcast(total)).withColumn("normal_freq", frequency)
    new, rare = F.col("normal_freq") == 0, (F.col("normal_freq") > 0) & (F.col("normal_freq") < profile.rare_frequency)
    return flagged.withColumns({"is_new": new, "is_rare": rare, "new_or_rare": new | rare}).drop("_n", "_total")


def pure_order(context: DataFrame, *, in_order: bool = False) -> DataFrame:
    """``pure_order``: known templates in a succession never seen between normal events of the node.

    ``order_status`` says why a row can't be judged: ``unknown_template`` or ``no_context``.
    ``in_order``: the rows are all those of ``add_sequence_context``, just as it returns them.
    They lie dealt by node then, so unless a node is very long nothing more is shuffled.
    """
    short = (ordered.most_rows(context) or ordered.BLOCK_ROWS + 1) <= ordered.BLOCK_ROWS
    rows = _looked_up_in_order(context) if in_order and short else _looked_up(context)
    true = lambda c: F.coalesce(c, F.lit(False))
    prev, following = F.col("prev_template").isNotNull(), F.col("next_template").isNotNull()
    all_known = true("_this") & (true("_prev") | ~prev) & (true("_next") | ~following)
    unseen = (prev & ~true("_in")) | (following & ~true("_out"))
    return rows.withColumns(
        {
            "order_status": F.when(~all_known, "unknown_template").when(~(prev | following), "no_context").otherwise("judged"),
            "pure_order": F.when(all_known & (prev | following), unseen),
        }
    ).select(*context.columns, "order_status", "pure_order")


def _looked_up(context: DataFrame) -> DataFrame:
    """``_this``, ``_prev``, ``_next``: the node has the template in a normal event; ``_in``, ``_out``: it has the succession between normal ones."""
    normal = context.where("not anomaly")
    known = normal.select("node", "event_template").distinct()
    seen = (
        normal.where("not coalesce(prev_anomaly, true)").select("node", F.col("prev_template").alias("_from"), F.col("event_template").alias("_to")).distinct()
    )

    def has(df: DataFrame, column: str, name: str) -> DataFrame:
        right = known.select(F.col("node").alias("_node"), F.col("event_template").alias("_template"), F.lit(True).alias(name))
        return df.join(right, (df["node"] == F.col("_node")) & (df[column] == F.col("_template")), "left").drop("_node", "_template")

    def follows(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        right = seen.select(F.col("node").alias("_node"), "_from", "_to", F.lit(True).alias(name))
        return df.join(right, (df["node"] == F.col("_node")) & (df[a] == F.col("_from")) & (df[b] == F.col("_to")), "left").drop("_node", "_from", "_to")

    rows = has(has(has(context, "event_template", "_this"), "prev_template", "_prev"), "next_template", "_next")
    return follows(follows(rows, "prev_template", "event_template", "_in"), "event_template", "next_template", "_out")


def _looked_up_in_order(context: DataFrame) -> DataFrame:
    """The same of rows that lie in order: what a row's neighbours are told of themselves holds for its ``_prev``, ``_next`` and ``_out``.

    Places are taken before rows are sorted otherwise, so that rows of one time and id keep their neighbours.
    """
    normal = F.coalesce(~F.col("anomaly"), F.lit(False))
    after_normal = normal & ~F.coalesce("prev_anomaly", F.lit(True))
    key = F.col("node").isNotNull() & F.col("event_template").isNotNull()  # nulls equal nothing
    own = Window.partitionBy("node", "event_template").orderBy("prev_template")
    everywhere = own.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same_before = own.rangeBetween(Window.currentRow, Window.currentRow)
    by_place = Window.partitionBy("node").orderBy("_place")
    rows = add_position(context, "_place").withColumns({"_this": key & F.bool_or(normal).over(everywhere), "_in": key & F.bool_or(after_normal).over(same_before)})
    return rows.withColumns({"_prev": F.lag("_this").over(by_place), "_next": F.lead("_this").over(by_place), "_out": F.lead("_in").over(by_place)})


def timing_gap(rows: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """``timing_gap``: either gap beyond the z limit; null if both are missing.  Rows carry their baseline."""
    far = lambda gap: F.coalesce(F.abs(z_of(gap, profile)) > profile.z_limit, F.lit(False))
    some = F.col("gap_prev_s").isNotNull() | F.col("gap_next_s").isNotNull()
    return rows.withColumn("timing_gap", F.when(some, far("gap_prev_s") | far("gap_next_s")))


def audit_summary(audited: DataFrame) -> DataFrame:
    """(signature, count_flagged, pct_of_anomalies, count_insufficient_context, count_excluded) over anomalies.

    Timing-only rows are flagged by timing, not by template, and judged not to be out of order.
    """
    rows = audited.where("anomaly")
    only = F.coalesce(~F.col("new_or_rare") & (F.col("pure_order") == F.lit(False)) & F.col("timing_gap"), F.lit(False))
    zero = F.lit(0).cast("long")

    def line(name: str, flag: Column, lacking: Column, excluded: Column) -> Column:
        n = F.count_if(flag)
        return F.struct(
            F.lit(name).alias("signature"), n.alias("count_flagged"), F.bround(100 * n / F.count("*"), 2).alias("pct_of_anomalies"),
            lacking.alias("count_insufficient_context"), excluded.alias("count_excluded_unknown_template"),
        )

    status = lambda s: F.count_if(F.col("order_status") == s)
    lines = F.array(
        line("new_or_rare_template", F.col("new_or_rare"), zero, zero),
        line("pure_order_anomaly", F.coalesce("pure_order", F.lit(False)), status("no_context"), status("unknown_template")),
        line("timing_gap_anomaly", F.coalesce("timing_gap", F.lit(False)), F.count_if(F.col("timing_gap").isNull()), zero),
        line("timing_only", only, zero, zero),
    )
    return rows.agg(lines.alias("lines")).select(F.explode("lines").alias("l")).select("l.*")


def timing_by_content(audited: DataFrame) -> DataFrame:
    """Timing rate of anomalies with and without a new or rare template."""
    return (
        audited.where("anomaly").groupBy("new_or_rare")
        .agg(F.count("*").alias("n"), F.count_if(F.coalesce("timing_gap", F.lit(False))).alias("n_timing"))
        .withColumn("pct_timing", 100 * F.col("n_timing") / F.col("n"))
    )


def instrument_rates(audited: DataFrame) -> DataFrame:
    """One row: rate of each signature over injected rows."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return audited.where("injected_row").agg(
        F.count("*").alias("n_injected"), rate("new_or_rare").alias("template_rate"), rate("pure_order").alias("order_rate"), rate("timing_gap").alias("timing_rate")
    )
