"""Windows over each node's rows in order, without a task for each node.

Most nodes are sorted whole, each in one task.  A node of more than ``BLOCK_ROWS`` rows
is cut into blocks of about so many consecutive rows: cut points come from a sample of
its keys chosen by hash (they decide how even blocks are, never the result), a row's
block is found by bisection, and windows then run over (node, block).  What a window
needs from beyond a block is carried in: copies of the last rows before it and the
first after it, and the counts of all earlier blocks, summed from one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.sinks import stage

#: Rows of a node beyond which it is cut, and of a block on average.
BLOCK_ROWS = 1_000_000
#: Sampled keys of a block, and cut points that are broadcast at most, about: beyond them blocks get longer.
SAMPLES, MOST_CUTS = 64, 200_000
#: Rows of the largest node of plans whose nodes are small; a stale answer costs time, not results.
_SMALL: dict[int, int] = {}
#: Metadata of a node column: rows of the largest node.  It is written with a table and goes through filters and joins, so
#: that nodes are counted once, not before every window; a table that has come to hold more costs time, not results.
_MOST = "most_rows"


def most_rows(rows: DataFrame, key: str = "node") -> int | None:
    """Rows of the largest node, if an earlier step has counted them."""
    return rows.schema[key].metadata.get(_MOST) if key in rows.columns else None


def with_most(node: Column, most: int | None) -> Column:
    """The column under the name ``node``, marked with the rows of the largest."""
    return node.alias("node") if most is None else node.alias("node", metadata={_MOST: most})


Compute = Callable[[DataFrame, WindowSpec, Callable[[str], Column]], DataFrame]


def by_node(
    rows: DataFrame, compute: Compute, *, before: int = 0, after: int = 0, sums: dict[str, Column] | None = None,
    order: tuple[str, ...] = ("timestamp", "row_id"), block_rows: int | None = None,
) -> DataFrame:
    """``compute(rows, window, earlier)`` over every node in ``order``.

    ``window`` is ordered and may be given frames of up to ``before`` rows before and
    ``after`` rows after a row; ``earlier(name)`` is the sum of ``sums[name]``, whole
    numbers, over all rows of the node before a row.
    """
    block_rows, sums = block_rows or BLOCK_ROWS, sums or {}
    known = most_rows(rows)
    cuts, most = (None, known) if known is not None and known <= block_rows else _cut_points(rows, order, block_rows)
    whole = Window.partitionBy("node").orderBy(*order)
    if cuts is None:
        done = compute(rows, whole, lambda name: _sum(sums[name], whole))
        return done if known == most else done.withColumn("node", with_most(F.col("node"), most))
    small = compute(rows.join(cuts, F.col("node").eqNullSafe(cuts["_node"]), "left_anti"), whole, lambda name: _sum(sums[name], whole))
    return small.unionByName(_in_blocks(rows, cuts, compute, before, after, sums, order))


def _sum(value: Column, window: WindowSpec) -> Column:
    """The sum of whole numbers over the earlier rows of the window."""
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _cut_points(rows: DataFrame, order: tuple[str, ...], block_rows: int) -> tuple[DataFrame | None, int]:
    """((_node, _cuts), rows of the largest node): the keys at which each large node is cut, in order; None if no node is large."""
    nodes = rows.select("node")
    plan = nodes.semanticHash()
    if _SMALL.get(plan, block_rows + 1) <= block_rows:
        return None, _SMALL[plan]
    sizes = nodes.groupBy("node").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= block_rows:
        _SMALL[plan] = most
        return None, most
    large = sizes.where(F.col("n") > block_rows)
    large = stage(large.select(F.col("node").alias("_node"), "n"), "large-nodes")
    rows_of_large = large.agg(F.sum("n")).first()[0]
    every = max(1, max(block_rows, rows_of_large // MOST_CUTS) // SAMPLES)
    some = F.pmod(F.xxhash64(*order), F.lit(every)) == 0
    keys = rows.join(large, F.col("node").eqNullSafe(F.col("_node"))).where(some).select("_node", F.struct(*order).alias("key"))
    ranked = keys.withColumn("at", F.row_number().over(Window.partitionBy("_node").orderBy("key"))).where(F.col("at") % SAMPLES == 0)
    cuts = ranked.groupBy(F.col("_node").alias("_of")).agg(F.sort_array(F.collect_set("key")).alias("_cuts"))
    return stage(large.join(cuts, F.col("_node").eqNullSafe(F.col("_of")), "left").select("_node", "_cuts"), "cuts"), most


def _block(order: tuple[str, ...]) -> Column:
    """The number of cuts up to a row's key, by bisection."""
    key = F.struct(*order)
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    step = lambda at, by: at + F.when(F.get("_cuts", at + by - 1) <= key, by).otherwise(0)
    return F.aggregate(steps, F.lit(0), step)


def _in_blocks(rows: DataFrame, cuts: DataFrame, compute: Compute, before: int, after: int, sums: dict[str, Column], order: tuple[str, ...]) -> DataFrame:
    """The rows of the large nodes, block by block."""
    same = F.col("node").eqNullSafe(F.col("_node"))
    blocked = rows.join(F.broadcast(cuts), same).withColumn("_block", _block(order)).drop("_node", "_cuts")  # MOST_CUTS keys at most
    tallies = [F.coalesce(F.sum(c), F.lit(0)).alias(f"_{k}") for k, c in sums.items()]
    sizes = blocked.groupBy("node", "_block").agg(F.count("*").alias("_n"), *tallies)
    ahead = Window.partitionBy("node").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    prefix = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    starts = stage(sizes.select("node", "_block", "_n", prefix("_n").alias("_start"), *[prefix(f"_{k}").alias(f"_before_{k}") for k in sums]), "blocks")
    own = blocked.withColumn("_halo", F.lit(False))
    if before or after:
        own = own.unionByName(_halos(blocked, starts, before, after, order))
    named = starts.drop("_n", "_start").withColumnsRenamed({"node": "_node", "_block": "_of"})
    ready = own.join(named, same & (F.col("_block") == F.col("_of"))).drop("_node", "_of")
    window = Window.partitionBy("node", "_block").orderBy(*order)
    done = compute(ready, window, lambda name: F.col(f"_before_{name}") + _sum(F.when(~F.col("_halo"), sums[name]), window))
    return done.where("not _halo").drop("_block", "_halo", *[f"_before_{k}" for k in sums])


def _halos(blocked: DataFrame, starts: DataFrame, before: int, after: int, order: tuple[str, ...]) -> DataFrame:
    """Copies of the rows that later blocks need from before, and earlier ones from after them."""
    of = starts.withColumnsRenamed({"node": "_node", "_block": "_of"}).select("_node", "_of", "_n", "_start")
    w = Window.partitionBy("node", "_block").orderBy(*order)
    placed = blocked.withColumn("_at", F.row_number().over(w) - 1).join(of, F.col("node").eqNullSafe(F.col("_node")) & (F.col("_block") == F.col("_of")))
    edge = placed.where((F.col("_at") < after) | (F.col("_at") >= F.col("_n") - before))
    place = F.col("_start") + F.col("_at")
    edges = edge.withColumn("_place", place).drop("_node", "_of", "_n", "_start", "_at")
    last = F.col("_start") + F.col("_n")
    # a block shorter than what is asked for passes on rows of those beyond it
    needs = (F.col("_place") < F.col("_start")) & (F.col("_place") >= F.col("_start") - before) | (F.col("_place") >= last) & (F.col("_place") < last + after)
    met = edges.join(of, F.col("node").eqNullSafe(F.col("_node")) & needs)
    return met.withColumns({"_block": F.col("_of"), "_halo": F.lit(True)}).drop("_node", "_of", "_n", "_start", "_place")
