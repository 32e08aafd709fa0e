"""Event tables from Parquet, and the orders in which they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import by_node


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event table; columns and filters reach the scan."""
    return spark.read.parquet(path)


def from_event_stream(df: DataFrame, *, label: str = "value") -> DataFrame:
    """The event model on a table (event_id, ts, user_id, event_type, value, props).

    ``label='value'`` marks large values anomalous and takes a fine template;
    ``label='type'`` marks error events and takes the type as template.
    """
    fine = label == "value"
    tens = F.floor(F.get_json_object("props", "$.k").cast("long") / 10).cast("string")
    return df.select(
        F.col("event_id").alias("row_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").cast("string").alias("node"),
        F.col("event_type").alias("label"),
        (F.col("value") > 150.0 if fine else F.col("event_type") == "error").alias("anomaly"),
        (F.concat_ws(":", "event_type", tens) if fine else F.col("event_type")).alias("event_template"),
        F.col("props").alias("raw_message"),
    )


def by_session(events: DataFrame) -> DataFrame:
    """Session-keyed events with the session as their node."""
    return events.withColumn("node", F.col("block_id"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A label or result table; the schema is stated, so the file is read once."""
    return spark.read.schema(schema).csv(path, header=True)


def chronological_prefix(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` events by time; ties by row id."""
    return events.orderBy("timestamp", "row_id").limit(n)


def position_order(events: DataFrame) -> DataFrame:
    """Each event's position within its node by row id alone, whatever its clock says."""
    return by_node(events, lambda rows, w, earlier: rows.withColumn("position", earlier("rows")), sums={"rows": F.lit(1)}, order=("row_id",))


def node_subsample(events: DataFrame, n: int, must_include: DataFrame | None = None) -> DataFrame:
    """``n`` events by (node, time, row id); all events of ``must_include`` nodes come first."""
    if must_include is None:
        return events.orderBy("node", "timestamp", "row_id").limit(n)
    nodes = must_include.select("node").distinct()
    first = events.join(nodes, "node", "left_semi")
    rest = events.join(nodes, "node", "left_anti")
    return first.withColumn("_rest", F.lit(0)).unionByName(rest.withColumn("_rest", F.lit(1))).orderBy("_rest", "node", "timestamp", "row_id").limit(n).drop("_rest")


def pick_nodes(injected: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` of the injected nodes, picked by a seeded hash."""
    nodes = injected.where("injected_row").select("node").distinct()
    return nodes.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "node")), "node").limit(n)
