"""Causal timing features of every event."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.ordered import by_node
from ..schema import SYSTEM_LOG, Profile
from .baseline import log_ratio_of, scale_of, with_baseline, z_of

FEATURES = ["rolling_mean_z", "rolling_std_ratio", "ewma_residual_z", "z_score"]


def ewma_before(rows: DataFrame, value: str, count: str, span: float, name: str) -> DataFrame:
    """``name``: the exponentially weighted mean of all of a node's earlier values, nulls passed over.

    ``count`` has the number of them.  A scan by stretches of values so long that weights
    fall by about 10**-100 within one: sums of weighted values run within a stretch, each
    stretch's sum is carried to the few after it by powers of the decay until these are
    zero in double precision, and the sum of the weights has a closed form.  No
    node is in one task, and no row holds a list.
    """
    keep = max(1 - 2 / (span + 1), 1e-300)  # a span of 1 keeps the last value alone
    length = max(1, int(230 / -math.log(keep)))
    decay = keep**length
    powers = [decay**k for k in range(400) if not k or decay**k > 0]
    at = F.col(count) % length
    w = Window.partitionBy("node", "_stretch").orderBy("timestamp", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    parted = rows.withColumn("_stretch", F.floor(F.col(count) / length))
    sums = parted.where(F.col(value).isNotNull()).groupBy("node", "_stretch").agg(F.sum(F.col(value) * F.pow(F.lit(keep), length - 1 - at)).alias("_sum"))
    later = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("ahead"), F.lit(p).alias("power")) for k, p in enumerate(powers)]))
    sent = sums.select("node", "_stretch", "_sum", later.alias("to")).select("node", (F.col("_stretch") + F.col("to.ahead")).alias("_stretch"), (F.col("_sum") * F.col("to.power")).alias("_sum"))
    carried = sent.groupBy(F.col("node").alias("_node"), F.col("_stretch").alias("_of")).agg(F.sum("_sum").alias("_carried"))
    inside = F.sum(F.col(value) * F.pow(F.lit(keep), -at)).over(w) * F.pow(F.lit(keep), at - 1)
    weights = (1 - F.pow(F.lit(keep), F.col(count))) / (1 - keep)
    met = parted.withColumn("_inside", inside).join(carried, F.col("node").eqNullSafe(F.col("_node")) & (F.col("_stretch") == F.col("_of")), "left")
    total = F.coalesce("_inside", F.lit(0.0)) + F.coalesce("_carried", F.lit(0.0)) * F.pow(F.lit(keep), at)
    return met.withColumn(name, F.when(F.col(count) > 0, total / weights)).drop("_stretch", "_inside", "_carried", "_node", "_of")


def add_rolling_features(context: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """Mean and deviation of the ``rolling`` gaps before an event's own, and its residual from their EWMA.

    All are null with fewer than ``min_periods`` gaps.
    """
    gap = F.col("gap_prev_s")

    def rolled(rows: DataFrame, w: WindowSpec, earlier) -> DataFrame:
        before = w.rowsBetween(-profile.rolling, -1)
        enough = F.count(gap).over(before) >= profile.min_periods
        return rows.withColumns({
            "rolling_mean": F.when(enough, F.avg(gap).over(before)),
            "rolling_std": F.when(enough, F.stddev_samp(gap).over(before)),
            "_n": earlier("gaps"),
        })

    rows = by_node(context, rolled, before=profile.rolling, sums={"gaps": gap.isNotNull().cast("long")})
    predicted = ewma_before(rows, "gap_prev_s", "_n", profile.ewma_span, "_predicted")
    return predicted.withColumn("ewma_residual", F.when(F.col("_n") >= profile.min_periods, gap - F.col("_predicted"))).drop("_n", "_predicted")


def build_features(context: DataFrame, nodes: DataFrame, pooled: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """Features in units of the applicable baseline; missing history fills to the baseline itself."""
    rows = with_baseline(add_rolling_features(context, profile), nodes, pooled)
    scale = scale_of(profile)
    return rows.withColumns(
        {
            "rolling_mean_z": (F.coalesce("rolling_mean", "median") - F.col("median")) / scale,
            "rolling_std_ratio": F.coalesce(F.col("rolling_std"), scale) / scale,
            "ewma_residual_z": F.coalesce("ewma_residual", F.lit(0.0)) / scale,
            "z_score": F.coalesce(z_of("gap_prev_s", profile), F.lit(0.0)),
            "log_ratio": log_ratio_of("gap_prev_s", profile),
        }
    )
