"""Per-node sequences: context, gaps, transitions and the chronological split.

A node's events are ordered by time, ties by row id; no operator relies on the
physical order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.ordered import by_node
from ..functions.quantile import exact_quantile
from ..functions.timing import seconds_between

CONTEXT = ["prev_template", "next_template", "prev_anomaly", "gap_prev_s", "gap_next_s"]


def add_sequence_context(events: DataFrame) -> DataFrame:
    """Neighbouring templates, the label before, and the gaps on both sides.

    One shuffle by node, shared by all five columns and by later node windows; a
    very long node is dealt in blocks.
    """

    def neighbours(rows: DataFrame, w: WindowSpec, _) -> DataFrame:
        return rows.withColumns({
            "prev_template": F.lag("event_template").over(w),
            "next_template": F.lead("event_template").over(w),
            "prev_anomaly": F.lag("anomaly").over(w),
            "gap_prev_s": seconds_between(F.lag("timestamp").over(w), F.col("timestamp")),
            "gap_next_s": seconds_between(F.col("timestamp"), F.lead("timestamp").over(w)),
        })

    return by_node(events, neighbours, before=1, after=1)


def add_position(events: DataFrame, name: str = "position", order: tuple[str, ...] = ("timestamp", "row_id")) -> DataFrame:
    """Each event's place within its node, from 0."""
    place = lambda rows, w, earlier: rows.withColumn(name, earlier("rows"))
    return by_node(events, place, sums={"rows": F.lit(1)}, order=order)


def normal_transition() -> Column:
    """A normal event after a normal one; a node's first event follows nothing normal."""
    return ~F.col("anomaly") & ~F.coalesce("prev_anomaly", F.lit(True)) & F.col("gap_prev_s").isNotNull()


def split_cutoff(events: DataFrame, fraction: float, *, written: bool = False) -> DataFrame:
    """One row: the instant (microseconds) at the linear quantile of time; ``written``: ``events`` are read from files."""
    at = exact_quantile(events.select(F.unix_micros("timestamp").alias("us")), "us", fraction, written=written)
    return events.sparkSession.createDataFrame([(at,)], "cutoff_us double")


def chronological_split(events: DataFrame, fraction: float = 0.7) -> DataFrame:
    """``is_train``: events at or before the cutoff (one broadcast row)."""
    cut = split_cutoff(events, fraction)
    return events.crossJoin(F.broadcast(cut)).withColumn("is_train", F.unix_micros("timestamp") <= F.col("cutoff_us"))


def recovered_cutoff(split: DataFrame) -> DataFrame:
    """One row: the last training time stamp, which later steps cut at."""
    return split.where("is_train").agg(F.max("timestamp").alias("last_train_ts"))


def zero_gap_summary(context: DataFrame) -> DataFrame:
    """One row: share of zero gaps overall, over nodes on average and in the middle, and nodes that are mostly zero."""
    gaps = context.where("gap_prev_s is not null").select("node", (F.col("gap_prev_s") == 0).cast("double").alias("zero"))
    nodes = gaps.groupBy("node").agg(F.sum("zero").alias("zeros"), F.count("*").alias("n"))
    share = F.col("zeros") / F.col("n")
    return nodes.agg(
        (F.sum("zeros") / F.sum("n")).alias("zero_gap_fraction"), F.avg(share).alias("mean_node_fraction"),
        F.median(share).alias("median_node_fraction"), (100 * F.avg((share > 0.5).cast("double"))).alias("pct_majority_zero_nodes"),
    )


def sliding_sequences(encoded: DataFrame, length: int) -> DataFrame:
    """(row_id, node, context, target): the ``length`` ids before each event that has so many."""
    def contexts(rows: DataFrame, w: WindowSpec, _) -> DataFrame:
        return rows.withColumn("context", F.collect_list("template_id").over(w.rowsBetween(-length, -1)))

    done = by_node(encoded.select("row_id", "timestamp", "node", "template_id"), contexts, before=length)
    return done.where(F.size("context") == length).select("row_id", "node", "context", F.col("template_id").alias("target"))


def ordering_violations(events: DataFrame, position: str = "row_id") -> DataFrame:
    """One row: events earlier than the one before them by original position, and the nodes they are on.

    Order is judged by position, not by time: sorted by time nothing could be out of order.
    """

    def backwards(rows: DataFrame, w: WindowSpec, _) -> DataFrame:
        return rows.withColumn("back", F.col("timestamp") < F.lag("timestamp").over(w))

    return by_node(events.select("node", "timestamp", position), backwards, before=1, order=(position,)).agg(
        F.count_if("back").alias("n_violations"), F.countDistinct(F.when(F.col("back"), F.col("node"))).alias("n_nodes")
    )
