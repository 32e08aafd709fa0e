"""Timing faults with exact ground truth: stalls and bursts that keep every node's order.

Plans are small tables (a row an injection); applying one is a join on the node
and arithmetic in whole microseconds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.ordered import by_node, most_rows, with_most
from ..functions.timing import cell_index, seconds_between, shifted
from ..schema import SYSTEM_LOG, Profile
from ..sources.sinks import stage
from .baseline import scale_of, with_baseline, z_of
from .sequence import add_position


def with_position(events: DataFrame) -> DataFrame:
    """``position`` of each event in its node, from 0, and the node's size ``node_n``."""
    return add_position(events).join(node_sizes(events), "node")


def node_sizes(events: DataFrame) -> DataFrame:
    """(node, node_n)."""
    return events.groupBy("node").agg(F.count("*").alias("node_n"))


def eligible_nodes(events: DataFrame, nodes: DataFrame, min_events: int, profile: Profile = SYSTEM_LOG, sizes: DataFrame | None = None) -> DataFrame:
    """(node, node_n): enough events and a scale, by the node's own MAD, that keeps faults under the cap.

    ``sizes``: those of :func:`node_sizes`, where they are known already.
    """
    sizes = (node_sizes(events) if sizes is None else sizes).where(F.col("node_n") >= min_events)
    scale = F.greatest(F.col("mad") * profile.mad_to_sigma, F.lit(profile.mad_floor_s))
    fit = nodes.where(scale <= profile.max_mad_eff_s)
    if profile.require_valid_baseline:
        fit = fit.where(F.col("status") == "valid")
    return sizes.join(fit.select("node"), "node", "left_semi")


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _pick(choices: tuple, *parts) -> Column:
    """One of the choices by a hash."""
    k = F.conv(F.substring(_hash(*parts), 1, 8), 16, 10).cast("bigint") % len(choices)
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (k + 1).cast("int"))


def plan_by_hash(context: DataFrame, nodes: DataFrame, pooled: DataFrame, kind: str, profile: Profile = SYSTEM_LOG, seed: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(injection_id, node, node_n, start_pos, burst_length, intensity): a plan made by hashes alone.

    Nodes with the smallest hashes are taken; of a node's admissible starts (all
    following gaps within the z limit, else any start in range) the one with the
    smallest hash.  Expressible in SQL, and no node's events leave their task.
    """
    seed = (profile.stall_seed if kind == "stall" else profile.burst_seed) if seed is None else seed
    return plans_by_hash(context, nodes, pooled, kind, profile, (seed,), sizes)


def plans_by_hash(context: DataFrame, nodes: DataFrame, pooled: DataFrame, kind: str, profile: Profile, seeds: tuple[int, ...], sizes: DataFrame | None = None) -> DataFrame:
    """The plans of several seeds at once; only the rows of the chosen nodes are put in order."""
    return starts(chosen_rows(context, nodes, pooled, kind, profile, seeds, sizes), kind, profile)


def chosen_rows(context: DataFrame, nodes: DataFrame, pooled: DataFrame, kind: str, profile: Profile, seeds: tuple[int, ...], sizes: DataFrame | None = None) -> DataFrame:
    """All rows of ``context`` of the nodes that each seed chooses, with the seed's choices and ``_far`` (gap beyond the z limit), written."""
    stall = kind == "stall"
    least = profile.stall_min_events if stall else profile.burst_min_events
    eligible = eligible_nodes(context, nodes, least, profile, sizes)

    def chosen(seed: int) -> DataFrame:
        return eligible.orderBy(_hash(seed, F.col("node")), "node").limit(profile.n_injections).select(
            (F.row_number().over(Window.orderBy(_hash(seed, F.col("node")), "node")) - 1).alias("injection_id"), "node", "node_n",
            (F.lit(1) if stall else _pick(profile.burst_lengths, seed, "length", F.col("node"))).alias("burst_length"),
            _pick(profile.intensities, seed, "intensity", F.col("node")).alias("intensity"), F.lit(seed).alias("seed"),
        )

    own = stage(reduce(DataFrame.unionByName, [chosen(s) for s in seeds]), "chosen")
    rows = with_baseline(context.join(F.broadcast(own), "node"), nodes, pooled)
    far = F.coalesce((F.abs(z_of("gap_prev_s", profile)) > profile.z_limit).cast("long"), F.lit(0))
    return stage(rows.withColumn("_far", far).drop("median", "mad", "used_pooled"), "chosen-rows")


def starts(chosen: DataFrame, kind: str, profile: Profile) -> DataFrame:
    """The plans on the rows of :func:`chosen_rows`."""
    stall = kind == "stall"
    lo, hi = profile.stall_range if stall else profile.burst_range
    columns = ["node", "timestamp", "row_id", "injection_id", "node_n", "burst_length", "intensity", "seed", "_far"]
    rows = add_position(of_run(chosen.select(*columns, F.col("node").alias("_plain"))))
    lengths = sorted({1} if stall else set(profile.burst_lengths))
    # gaps beyond the limit among the burst_length events that follow: a difference of running counts
    upto = lambda d, w, earlier: d.withColumn("_upto", earlier("far") + F.col("_far"))
    rows = by_node(rows, upto, sums={"far": F.col("_far")}, order=("position",))

    def beyond(d: DataFrame, w: WindowSpec, _) -> DataFrame:
        later = F.lit(None).cast("long")
        for length in lengths:
            later = F.when(F.col("burst_length") == length, F.lead("_upto", length).over(w)).otherwise(later)
        return d.withColumn("_later", later)

    rows = by_node(rows, beyond, after=lengths[-1], order=("position",))
    first = F.floor(F.col("node_n") * lo)
    last = F.least(F.greatest(F.floor(F.col("node_n") * hi), first + 1), F.col("node_n") - F.col("burst_length") - (0 if stall else 1))
    inside = rows.withColumn("_bad", (F.col("_later") - F.col("_upto") > 0).cast("int")).where((F.col("position") >= first) & (F.col("position") < last))
    best = F.min(F.struct("_bad", _hash(F.col("seed").cast("string"), "start", F.col("_plain"), F.col("position").cast("string")).alias("h"), "position"))
    found = inside.groupBy("injection_id", F.col("_plain").alias("node"), "node_n", "burst_length", "intensity", "seed").agg(best["position"].alias("start_pos"))
    return found.select("injection_id", "node", "node_n", "burst_length", "intensity", "start_pos", "seed")


def of_run(rows: DataFrame) -> DataFrame:
    """Rows with a ``seed`` under names of nodes that tell runs apart, so that one pass serves several plans of the same nodes."""
    return rows.withColumn("node", with_most(F.concat_ws("|", F.col("seed").cast("string"), "node"), most_rows(rows)))


def run_of(rows: DataFrame) -> DataFrame:
    """The node's own name again, and its ``seed``."""
    return rows.withColumns({"seed": F.substring_index("node", "|", 1).cast("int"), "node": F.expr("substring(node, locate('|', node) + 1)")})


def plan_by_generator(context: DataFrame, nodes: DataFrame, pooled: DataFrame, kind: str, profile: Profile = SYSTEM_LOG, seed: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """The same kind of plan with numpy's default generator: the draws of a published benchmark.

    Order of draws: nodes and seeds from the master generator; then, from each
    injection's own, the length of a burst, starts until one is admissible, and
    the intensity.  Only the ``n * tries`` gaps that the draws may look at reach the
    driver, never a node's events.
    """
    stall = kind == "stall"
    seed = (profile.stall_seed if stall else profile.burst_seed) if seed is None else seed
    least, (lo_f, hi_f) = (profile.stall_min_events, profile.stall_range) if stall else (profile.burst_min_events, profile.burst_range)
    spark = context.sparkSession
    ranked = eligible_nodes(context, nodes, least, profile, sizes).orderBy("node")
    n_eligible = ranked.count()
    n = min(profile.n_injections, n_eligible)
    master = np.random.default_rng(seed)
    picked = [int(i) for i in master.choice(n_eligible, size=n, replace=False)] if n else []
    seeds = [int(s) for s in master.integers(0, 2**31 - 1, size=n)]
    wanted = set(picked)
    found = {i: r for r, i in ranked.rdd.zipWithIndex().filter(lambda x: x[1] in wanted).collect()}

    def draws(s: int, size: int):
        rng = np.random.default_rng(s)
        length = 1 if stall else int(rng.choice(profile.burst_lengths))
        lo = int(size * lo_f)
        hi = min(max(int(size * hi_f), lo + 1), size - length - (0 if stall else 1))
        return rng, length, lo, hi

    tried = []
    for k, (i, s) in enumerate(zip(picked, seeds)):
        rng, length, lo, hi = draws(s, found[i]["node_n"])
        tried += [(k, found[i]["node"], length, t, int(rng.integers(lo, hi))) for t in range(profile.tries)]
    if not tried:
        return spark.createDataFrame([], "injection_id int, node string, node_n long, start_pos long, burst_length int, intensity double, seed long")
    tries = spark.createDataFrame(tried, "k int, node string, length int, t int, start long")
    asked = tries.select("k", "node", "t", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("length"))).alias("position"))
    scored = with_baseline(add_position(context), nodes, pooled)
    far = F.coalesce(F.abs(z_of("gap_prev_s", profile)) > profile.z_limit, F.lit(True))
    met = scored.select("node", "position", far.alias("far")).join(F.broadcast(asked), ["node", "position"])
    good = {r["k"]: r["t"] for r in met.groupBy("k", "t").agg(F.bool_or("far").alias("far")).where("not far").groupBy("k").agg(F.min("t").alias("t")).collect()}
    plan = []
    for k, (i, s) in enumerate(zip(picked, seeds)):
        rng, length, lo, hi = draws(s, found[i]["node_n"])
        for _ in range(good.get(k, profile.tries) + 1):
            start = int(rng.integers(lo, hi))
        plan.append((k, found[i]["node"], found[i]["node_n"], start, length, float(rng.choice(profile.intensities)), s))
    return spark.createDataFrame(plan, "injection_id int, node string, node_n long, start_pos long, burst_length int, intensity double, seed long")


def _planned(events: DataFrame, plan: DataFrame, *more: str) -> DataFrame:
    cols = [F.col("node").alias("_node"), "start_pos", *more]
    return add_position(events).join(F.broadcast(plan.select(*cols)), F.col("node") == F.col("_node"), "left").drop("_node")


def _clock(ts: Column, profile: Profile) -> Column:
    return F.date_trunc("MILLISECOND", ts) if profile.millisecond_clock else ts


def stall_plan_scaled(plan: DataFrame, nodes: DataFrame, pooled: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """The plan with each stall's shift: intensity times the node's scale, to whole microseconds."""
    scaled = with_baseline(plan, nodes, pooled).withColumn("node_mad_eff_s", scale_of(profile))
    return scaled.withColumn("delta_us", F.bround(F.col("intensity") * F.col("node_mad_eff_s") * 1e6).cast("long")).drop("median", "mad")


def apply_stalls(events: DataFrame, scaled_plan: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """Events after each stall's start moved back by its shift; ``injected_row`` marks the first of them."""
    rows = _planned(events, scaled_plan, "delta_us")
    after = F.coalesce(F.col("position") > F.col("start_pos"), F.lit(False))
    return rows.withColumns(
        {
            "timestamp": F.when(after, _clock(shifted(F.col("timestamp"), F.col("delta_us")), profile)).otherwise(F.col("timestamp")),
            "injected_row": F.coalesce(F.col("position") == F.col("start_pos") + 1, F.lit(False)),
        }
    ).drop("position", "start_pos", "delta_us")


def apply_bursts(events: DataFrame, plan: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """Gaps of each burst divided by its intensity, and all later events moved up by what that saves.

    One running sum gives both: it grows within the burst and stays after it.
    """
    rows = _planned(events, plan, "burst_length", "intensity")
    inside = F.coalesce((F.col("position") > F.col("start_pos")) & (F.col("position") <= F.col("start_pos") + F.col("burst_length")), F.lit(False))

    def saved(d: DataFrame, w: WindowSpec, _) -> DataFrame:
        gap = F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(w)
        return d.withColumn("_saved", F.when(inside, gap - F.bround(gap / F.col("intensity")).cast("long")).otherwise(F.lit(0)))

    total = lambda d, w, earlier: d.withColumn("_total", earlier("saved") + F.coalesce("_saved", F.lit(0)))
    return (
        by_node(by_node(rows, saved, before=1), total, sums={"saved": F.col("_saved")})
        .withColumn("injected_row", inside)
        .withColumn("timestamp", F.when(F.col("_total") != 0, _clock(shifted(F.col("timestamp"), -F.col("_total")), profile)).otherwise(F.col("timestamp")))
        .drop("position", "start_pos", "burst_length", "intensity", "_saved", "_total")
    )


def stall_labels(events: DataFrame, injected: DataFrame, scaled_plan: DataFrame) -> DataFrame:
    """A row of ground truth for each stall."""
    before = with_position(events).select("node", "position", F.col("timestamp").alias("t"), "row_id")
    moved = injected.where("injected_row").select("node", "row_id", F.col("timestamp").alias("end"))
    plan = scaled_plan.select("injection_id", "node", "node_n", "start_pos", "intensity", "seed", "node_mad_eff_s", "used_pooled", "delta_us")
    at = lambda k, name: before.select("node", (F.col("position") - k).alias("start_pos"), F.col("t").alias(name), *([F.col("row_id")] if k else []))
    return (
        plan.join(at(0, "start"), ["node", "start_pos"]).join(at(1, "_next"), ["node", "start_pos"]).join(moved, ["node", "row_id"])
        .select(
            "injection_id", "node", F.lit("stall").alias("type"), "start", "end", "intensity", "seed", "node_mad_eff_s",
            F.col("used_pooled").alias("used_pooled_fallback"), (F.col("delta_us") / 1e6).alias("delta_seconds"),
            seconds_between(F.col("start"), F.col("_next")).alias("original_gap_s"),
            (F.col("node_n") - F.col("start_pos") - 1).alias("n_events_shifted"), "start_pos", F.col("node_n").alias("node_n_events"),
        )
    )


def burst_labels(events: DataFrame, injected: DataFrame, plan: DataFrame) -> DataFrame:
    """A row of ground truth for each burst."""
    before = with_position(events).select("node", "position", F.col("timestamp").alias("t"), "row_id")
    moved = injected.select("node", "row_id", F.col("timestamp").alias("end"))
    rows = plan.select("injection_id", "node", "node_n", "start_pos", "burst_length", "intensity", "seed").withColumn("end_pos", F.col("start_pos") + F.col("burst_length"))
    start = before.select("node", F.col("position").alias("start_pos"), F.col("t").alias("start"))
    end = before.select("node", F.col("position").alias("end_pos"), F.col("t").alias("_old_end"), "row_id")
    span = seconds_between(F.col("start"), F.col("end"))
    return (
        rows.join(start, ["node", "start_pos"]).join(end, ["node", "end_pos"]).join(moved, ["node", "row_id"])
        .select(
            "injection_id", "node", F.lit("burst").alias("type"), "start", "end", "intensity", "seed", "burst_length",
            seconds_between(F.col("end"), F.col("_old_end")).alias("total_time_saved_s"), span.alias("compressed_span_s"),
            "start_pos", F.col("node_n").alias("node_n_events"),
        )
    )


def grid_labels(labels: DataFrame, injected: DataFrame, grid_s: float, scheme: str = "fixed_time") -> DataFrame:
    """(injection_id, node, window_idx): every cell of each span, by the node's first injected time."""
    if scheme != "fixed_time":
        raise NotImplementedError("spans are labelled on time grids only")
    origin = injected.groupBy("node").agg(F.min("timestamp").alias("t0"))
    cell = lambda c: cell_index(seconds_between(F.col("t0"), F.col(c)), F.lit(float(grid_s)))
    return labels.join(origin, "node").select("injection_id", "node", F.explode(F.sequence(cell("start"), cell("end"))).alias("window_idx"))


def in_span(rows: DataFrame, labels: DataFrame, name: str = "in_span") -> DataFrame:
    """``in_span``: within an injection of its node, both ends included."""
    spans = labels.select(F.col("node").alias("_node"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    met = rows.join(F.broadcast(spans), F.col("node") == F.col("_node"), "left")
    return met.withColumn(name, F.coalesce(F.col("timestamp").between(F.col("_start"), F.col("_end")), F.lit(False))).drop("_node", "_start", "_end")


def run_config(spark: SparkSession, kind: str, profile: Profile, n_eligible: int) -> DataFrame:
    """One row: the configuration of an injection run, for a JSON sink."""
    stall = kind == "stall"
    return spark.createDataFrame(
        [(kind, profile.stall_seed if stall else profile.burst_seed, profile.n_injections, list(profile.intensities), profile.max_mad_eff_s, n_eligible, "fixed_time", profile.grid_s)],
        "type string, seed int, n_injections int, intensities array<double>, max_mad_eff_s double, n_eligible int, grid_scheme string, grid_s int",
    )
