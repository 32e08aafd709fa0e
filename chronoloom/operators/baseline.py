"""Robust per-node gap baselines, and scores against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import most_rows
from ..functions.quantile import FEW, exact_quantile, grouped_medians
from ..functions.timing import log_ratio, robust_z, scale
from ..schema import SYSTEM_LOG, Profile
from ..sources.sinks import stage


def node_baselines(gaps: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """(node, n, median, mad, status) of ``gaps`` (node, gap_prev_s).

    Two passes of exact medians by node, in bounded memory for nodes of any size; one
    if all nodes are known to be small.  Status is ``valid``, ``low_count`` or ``zero_mad``.
    """
    gaps = gaps.select("node", "gap_prev_s")
    status = F.when(F.col("n") < profile.min_baseline, "low_count").when(F.col("mad") > 0, "valid").otherwise("zero_mad")
    most = most_rows(gaps)
    if most is not None and most <= FEW:
        return _small_nodes(gaps).select("node", "n", "median", "mad", status.alias("status"))
    middle = stage(grouped_medians(gaps, "node", "gap_prev_s"), "medians")
    apart = gaps.join(middle.select("node", "median"), "node").select("node", F.abs(F.col("gap_prev_s") - F.col("median")).alias("spread"))
    spread = grouped_medians(apart, "node", "spread", rows=gaps).select("node", F.col("median").alias("mad"))
    return middle.join(spread, "node").select("node", "n", "median", "mad", status.alias("status"))


def _small_nodes(gaps: DataFrame) -> DataFrame:
    """(node, n, median, mad) in one pass: the gaps of a node are one list, put in order twice."""

    def middle(values: Column) -> Column:
        n = F.size(values)
        return 0.5 * F.get(values, F.floor((n - 1) / 2).cast("int")) + 0.5 * F.get(values, F.floor(n / 2).cast("int"))

    known = gaps.where(F.col("gap_prev_s").isNotNull() & ~F.isnan("gap_prev_s"))
    lists = known.groupBy("node").agg(F.sort_array(F.collect_list(F.col("gap_prev_s").cast("double"))).alias("gaps"))
    lists = lists.withColumn("median", middle(F.col("gaps")))
    apart = lists.withColumn("gaps", F.sort_array(F.transform("gaps", lambda x: F.abs(x - F.col("median")))))
    return apart.select("node", F.size("gaps").cast("long").alias("n"), "median", middle(F.col("gaps")).alias("mad"))


def pooled_baseline(gaps: DataFrame, profile: Profile = SYSTEM_LOG, *, written: bool = False) -> DataFrame:
    """One row (pooled_median, pooled_mad) over all gaps, or those above zero; ``written``: they are read from files."""
    pool = gaps.where("gap_prev_s > 0") if profile.exclude_zero_from_pooled else gaps
    middle = exact_quantile(pool, "gap_prev_s", 0.5, written=written)
    spread = None if middle is None else exact_quantile(pool.select(F.abs(F.col("gap_prev_s") - middle).alias("spread")), "spread", 0.5, written=written)
    return gaps.sparkSession.createDataFrame([(middle, spread)], "pooled_median double, pooled_mad double")


def with_baseline(rows: DataFrame, nodes: DataFrame, pooled: DataFrame) -> DataFrame:
    """Rows with the ``median`` and ``mad`` that apply: the node's if valid, else the pooled.

    Rows and baselines are both laid out by node, so the join adds no shuffle of
    the rows; the pooled baseline is one row.
    """
    own = nodes.select("node", F.col("median").alias("_median"), F.col("mad").alias("_mad"), (F.col("status") == "valid").alias("_valid"))
    valid = F.coalesce("_valid", F.lit(False))
    return (
        rows.join(own, "node", "left").crossJoin(F.broadcast(pooled))
        .withColumns({
            "median": F.when(valid, F.col("_median")).otherwise(F.col("pooled_median")),
            "mad": F.when(valid, F.col("_mad")).otherwise(F.col("pooled_mad")),
            "used_pooled": ~valid,
        })
        .drop("_median", "_mad", "_valid", "pooled_median", "pooled_mad")
    )


def z_of(gap: str | Column, profile: Profile = SYSTEM_LOG) -> Column:
    """Robust z of a gap against the row's baseline."""
    gap = F.col(gap) if isinstance(gap, str) else gap
    return robust_z(gap, F.col("median"), F.col("mad"), profile.mad_to_sigma, profile.mad_floor_s)


def log_ratio_of(gap: str, profile: Profile = SYSTEM_LOG) -> Column:
    """ln(gap / median) against the row's baseline, 0 for a missing gap; to twelve digits, so that equal gaps tie."""
    return F.round(log_ratio(F.col(gap), F.col("median"), profile.mad_floor_s), 12)


def scale_of(profile: Profile = SYSTEM_LOG) -> Column:
    """The row's robust scale."""
    return scale(F.col("mad"), profile.mad_to_sigma, profile.mad_floor_s)


def fallback_counts(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: how many anomalous nodes have each kind of baseline."""
    anomalous = events.where("anomaly").select("node").distinct()
    met = anomalous.join(nodes.select("node", "status"), "node", "left")
    return met.agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("status") == "valid").alias("n_valid"), F.count_if(F.col("status") == "low_count").alias("n_low_count"),
        F.count_if(F.col("status") == "zero_mad").alias("n_zero_mad"), F.count_if(F.col("status").isNull()).alias("n_no_gaps"),
    )


def outlier_ratio(nodes: DataFrame, pooled: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """(node, r): median over scale of each node's applicable baseline; above the z limit a zero gap already is an outlier."""
    return with_baseline(nodes.select("node", "n"), nodes, pooled).select("node", "n", "used_pooled", (F.col("median") / scale_of(profile)).alias("r"))


def outlier_ratio_summary(ratios: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """One row of figures over nodes."""
    return ratios.agg(
        F.count("*").alias("n_nodes"), F.count_if("used_pooled").alias("n_pooled_fallback"), F.min("r").alias("r_min"), F.median("r").alias("r_median"),
        F.avg("r").alias("r_mean"), F.max("r").alias("r_max"), F.avg((F.col("r") > profile.z_limit).cast("double")).alias("frac_r_above_limit"),
    )
