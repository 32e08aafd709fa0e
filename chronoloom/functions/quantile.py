"""Exact quantiles of any number of values, of a whole table or of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .ordered import most_rows

#: Values of a key whose median is worked out in one task.
FEW = 100_000


def exact_quantile(df: DataFrame, column: str, q: float, *, bins: int = 4096, small: int = 100_000, written: bool = False) -> float | None:
    """Linear-interpolated quantile of any number of values, within bounded memory.

    Few values go through ``percentile``, whose state holds every distinct value in
    one task.  Of more, counts per bin are combined before the shuffle, and the bin
    that holds the wanted rank is split again until few values are left.  ``written``:
    ``df`` is read from files, so passes over it are cheap.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    first = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not first["n"]:
        return None
    if first["n"] <= small:
        return values.agg(F.percentile("v", F.lit(q))).first()[0]
    values = values if written else stage(values, "quantile-values")  # every round counts them again
    rank = q * (first["n"] - 1)
    low, high = _ranked(values, int(rank), first, bins, small)
    return low + (high - low) * (rank % 1) if rank % 1 else low


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of a value between two bounds, which have a bin each, so that a range always shrinks (infinite bounds too)."""
    share = F.nanvl((v / 2 - lo / 2) / (hi / 2 - lo / 2), F.lit(0.0))  # halves don't overflow
    inner = 1 + F.least(F.floor(share * (bins - 2)), F.lit(bins - 3))
    return F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(inner).cast("int")


def _ranked(values: DataFrame, k: int, stats, bins: int, small: int) -> tuple[float, float]:
    """The k-th smallest value, from 0, and the one after it (the same at the end)."""
    n, lo, hi = stats["n"], stats["lo"], stats["hi"]
    below, beyond = 0, hi  # values under the range, and the least one over it
    while n > small and lo < hi:
        at = _bin(F.col("v"), F.lit(lo), F.lit(hi), bins)
        inside = values.where(F.col("v").between(lo, hi))
        seen = below
        counted = sorted(inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        for i, row in enumerate(counted):
            if seen + row["n"] > k:
                below, n, lo, hi = seen, row["n"], row["lo"], row["hi"]
                beyond = counted[i + 1]["lo"] if i + 1 < len(counted) else beyond
                break
            seen += row["n"]
    last = k + 1 == below + n  # of the range
    if lo == hi:
        return lo, beyond if last else lo
    upto = values.where(F.col("v").between(lo, hi)).orderBy("v").limit(k - below + 2)
    top = [row["v"] for row in upto.orderBy(F.desc("v")).limit(2).collect()]
    return (top[0], beyond) if last else (top[-1], top[0])


def grouped_medians(df: DataFrame, key: str, column: str, *, few: int = FEW, bins: int = 512, rows: DataFrame | None = None) -> DataFrame:
    """(key, n, median) of the values of every key; null and NaN values aren't counted.

    ``rows``: something cheaper with as many rows, to tell small tables by.

    Keys of up to ``few`` values are worked out in one grouped pass.  The middle ranks of
    all larger keys are looked for together, pass by pass: values are counted by key
    and bin before the shuffle, the bin that holds a rank becomes the range of the next
    pass, until a range has ``few`` values or one.  No task holds a key's values.
    """
    v = F.col(column).cast("double")
    values = df.select(F.col(key).alias("key"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    name = lambda d: d.select(F.col("key").alias(key), "n", "median")
    sizes = values.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    large = sizes.where(F.col("n") > few)
    most = most_rows(df, key)
    if (most is not None and most <= few) or (values if rows is None else rows).count() <= few or large.isEmpty():
        return name(values.groupBy("key").agg(F.count("*").alias("n"), F.median("v").alias("median")))
    large = stage(large, "large-keys")
    values = stage(values, "key-values")  # read by every pass
    small = values.join(large.select(F.col("key").alias("_key")), F.col("key").eqNullSafe(F.col("_key")), "left_anti")
    # one row for each key and middle rank: the rank within [lo, hi], which holds ``left`` values
    rank = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank")
    found, todo = None, large.select(F.col("key").alias("_key"), rank, F.col("n").alias("left"), "lo", "hi").withColumn("wanted", F.col("rank"))
    while True:
        todo = stage(todo, "ranks")
        ended = todo.where(F.col("lo") == F.col("hi")).select("_key", "wanted", F.col("lo").alias("v"))
        short = todo.where((F.col("lo") < F.col("hi")) & (F.col("left") <= few))
        met = lambda t: values.join(t, F.col("key").eqNullSafe(F.col("_key")) & F.col("v").between(F.col("lo"), F.col("hi")))
        place = F.row_number().over(Window.partitionBy("_key", "wanted").orderBy("v")) - 1
        picked = met(short).select("_key", "wanted", "v", "rank", place.alias("place")).where(F.col("place") == F.col("rank")).select("_key", "wanted", "v")
        now = ended.unionByName(picked)
        found = now if found is None else found.unionByName(now)
        todo = todo.where((F.col("lo") < F.col("hi")) & (F.col("left") > few))
        if todo.isEmpty():
            break
        at = _bin(F.col("v"), F.col("lo"), F.col("hi"), bins)
        counted = met(todo).groupBy("_key", "wanted", "rank", at.alias("bin")).agg(F.count("*").alias("left"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = Window.partitionBy("_key", "wanted").orderBy("bin")
        upto = counted.withColumn("_upto", F.sum("left").over(w))
        todo = upto.where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("left") <= F.col("rank"))).select("_key", (F.col("rank") - F.col("_upto") + F.col("left")).alias("rank"), "left", "lo", "hi", "wanted")
    middle = found.groupBy("_key").agg(F.avg("v").alias("median"))
    many = large.join(middle, F.col("key").eqNullSafe(F.col("_key"))).select("key", "n", "median")
    return name(small.groupBy("key").agg(F.count("*").alias("n"), F.median("v").alias("median")).unionByName(many))
