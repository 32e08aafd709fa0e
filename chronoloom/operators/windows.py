"""Per-node windows, their roll-ups, and template counts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import cell_index, seconds_between
from .sequence import add_position

CELL = ["node", "window_idx"]


def by_count(events: DataFrame, size: int, name: str = "window_idx") -> DataFrame:
    """Windows of ``size`` consecutive events of a node."""
    return add_position(events, name).withColumn(name, F.floor(F.col(name) / size))


def by_position(events: DataFrame, size: int, name: str = "window_idx") -> DataFrame:
    """Windows of ``size`` events by row id alone: no change of clock can move an event."""
    return add_position(events, name, ("row_id",)).withColumn(name, F.floor(F.col(name) / size))


def by_time(events: DataFrame, seconds: float, name: str = "window_idx") -> DataFrame:
    """Cells of ``seconds`` from each node's own first event.

    The origin is a node aggregate joined back, combined before the shuffle, so a
    node with very many events doesn't have to be sorted in one task.
    """
    origin = events.groupBy("node").agg(F.min("timestamp").alias("_origin"))
    return events.join(origin, "node").withColumn(name, cell_index(seconds_between(F.col("_origin"), F.col("timestamp")), F.lit(float(seconds)))).drop("_origin")


def assign(events: DataFrame, scheme: str, size: float, name: str = "window_idx") -> DataFrame:
    """Windows by scheme: ``fixed_count``, ``fixed_time`` or ``position``."""
    schemes = {"fixed_count": by_count, "fixed_time": by_time, "position": by_position}
    if scheme not in schemes:
        raise ValueError(f"unknown window scheme {scheme!r}; there are {sorted(schemes)}")
    return schemes[scheme](events, size, name)


def roll_up(windowed: DataFrame) -> DataFrame:
    """(node, window_idx, window_start, window_end, n_events, label)."""
    return windowed.groupBy(*CELL).agg(
        F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"), F.count("*").alias("n_events"), F.bool_or("anomaly").alias("label")
    )


def roll_up_positions(windowed: DataFrame) -> DataFrame:
    """The roll-up without times."""
    return windowed.groupBy(*CELL).agg(F.count("*").alias("n_events"), F.bool_or("anomaly").alias("label"))


def vocabulary(train: DataFrame, k: int) -> DataFrame:
    """(event_template, n, term_id) of the ``k`` most frequent templates; ties go to the first seen."""
    counts = train.groupBy("event_template").agg(F.count("*").alias("n"), F.min("row_id").alias("first_seen"))
    top = counts.orderBy(F.desc("n"), "first_seen").limit(k)  # k rows at most from here on
    rank = Window.orderBy(F.desc("n"), "first_seen")
    return top.select("event_template", "n", (F.row_number().over(rank) - 1).alias("term_id"))


def sorted_vocabulary(train: DataFrame) -> DataFrame:
    """(event_template, template_id): distinct templates in order, from 1; 0 is left for the unknown."""
    return train.select("event_template").distinct().select("event_template", F.row_number().over(Window.orderBy("event_template")).alias("template_id"))


def encode(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """``template_id`` of every event, 0 if unknown."""
    return events.join(vocab.select("event_template", "template_id"), "event_template", "left").withColumn("template_id", F.coalesce("template_id", F.lit(0)))


def term_counts(windowed: DataFrame, vocab: DataFrame) -> DataFrame:
    """(node, window_idx, term_id, cnt): counts of known templates."""
    return windowed.join(vocab.select("event_template", "term_id"), "event_template").groupBy(*CELL, "term_id").agg(F.count("*").alias("cnt"))


def count_vectors(windowed: DataFrame, vocab: DataFrame, size: int) -> DataFrame:
    """(node, window_idx, n_events, label, counts): count vectors; a window of unknown templates is all zero."""
    terms = term_counts(windowed, vocab).groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("term_id", "cnt"))).alias("terms"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("terms", i), F.lit(0)).cast("double"))
    return roll_up_positions(windowed).join(terms, CELL, "left").select(*CELL, "n_events", "label", array_to_vector(counts).alias("counts"))


def back_to_rows(windowed: DataFrame, scored: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``windowed`` with what their window got; its own window column is dropped, so that others can be assigned."""
    return windowed.join(scored.select(*CELL, *columns), CELL).drop("window_idx")


def coverage(train: DataFrame, test_windowed: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: how well the vocabulary covers the test events and windows."""
    known = test_windowed.join(vocab.select("event_template", F.lit(True).alias("known")), "event_template", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    windows = known.groupBy(*CELL).agg(F.bool_or("known").alias("any_known"), F.bool_or("anomaly").alias("label"))
    empty = (~F.col("any_known")).cast("double")
    unseen = test_windowed.select("event_template").distinct().join(train.select("event_template").distinct(), "event_template", "left_anti")
    return (
        vocab.agg(F.count("*").alias("vocabulary_size"))
        .crossJoin(train.agg(F.countDistinct("event_template").alias("n_train_templates")))
        .crossJoin(test_windowed.agg(F.countDistinct("event_template").alias("n_test_templates")))
        .crossJoin(unseen.agg(F.count("*").alias("n_unseen")))
        .crossJoin(known.agg((100 * F.avg(F.col("known").cast("double"))).alias("pct_events_covered")))
        .crossJoin(windows.agg(
            (100 * F.avg(empty)).alias("pct_zero_windows"), (100 * F.avg(F.when(F.col("label"), empty))).alias("pct_zero_anomalous"),
            (100 * F.avg(F.when(~F.col("label"), empty))).alias("pct_zero_normal"),
        ))
    )
