"""Connected components by contraction, without hubs in one task or links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``edges`` (``a, b``: long).

    Every round maps each node to the one of itself and its neighbours that comes
    first in that round's random order (a hash of node and round) and contracts
    the graph along that map.  A fixed share of the nodes falls away in each round
    on average, whatever the order of ids (a chain of rising ids included);
    minima are combined before they are shuffled.  Each round is written to the
    shared folder, which cuts the lineage, in as many files as its rows ask for.
    """
    graph = durable(edges.where("a <> b").select("a", "b").distinct(), "edges")
    found, turn, nodes = None, 0, None
    while n := graph.count():
        nodes = nodes or 2 * n  # at most
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        placed = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        step = both.groupBy(F.col("a").alias("node")).agg(F.min(placed("b")).alias("m"))
        step = durable(step.select("node", F.least(placed("node"), "m")["node"].alias("label")), "step", rows=2 * n)
        if found is None:
            after = durable(step, "labels", rows=nodes)
        else:
            following = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            after = durable(found.join(following, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels", rows=nodes)
            forget(found)
        found, turn = after, turn + 1
        a, b = (step.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")) for c in "ab")
        smaller = durable(
            graph.join(a, "a").join(b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct(),
            "edges", rows=n,
        )
        forget(graph)
        forget(step)
        graph = smaller
    if found is None:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("label"))
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    return found.join(least, "label").select("node", F.col("least").alias("label"))
