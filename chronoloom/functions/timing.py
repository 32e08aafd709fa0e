"""Column functions on times and gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds from one time stamp to another, exact to the microsecond."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def shifted(ts: Column, micros: Column) -> Column:
    """A time stamp moved by whole microseconds."""
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def scale(mad: Column, factor: float = 1.4826, floor: float = 1e-3) -> Column:
    """Robust standard deviation from a MAD, never below the floor."""
    return F.greatest(mad * F.lit(factor), F.lit(floor))


def robust_z(gap: Column, median: Column, mad: Column, factor: float = 1.4826, floor: float = 1e-3) -> Column:
    """Deviation from the median in robust standard deviations."""
    return (gap - median) / scale(mad, factor, floor)


def log_ratio(gap: Column, median: Column, floor: float = 1e-3) -> Column:
    """ln(gap / median), both floored; 0 for a missing gap."""
    return F.when(gap.isNull(), F.lit(0.0)).otherwise(F.log(F.greatest(gap, F.lit(floor)) / F.greatest(median, F.lit(floor))))


def cell_index(seconds: Column, size: Column | float) -> Column:
    """Index of the cell of ``size`` seconds."""
    return F.floor(seconds / size).cast("bigint")


def ratio_or_null(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))
