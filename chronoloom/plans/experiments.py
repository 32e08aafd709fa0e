"""Whole experiments, composed of the operators.

The clean, node-ordered context is the one wide base; baselines, plans and labels
are small next to it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from threading import RLock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import cell_index, seconds_between

from ..operators import audit, baseline, detect, evaluate, features, inject, recurrent, sequence, windows
from ..schema import SPARSE, Profile
from ..sources.sinks import scratch, stage, sweep, together


def normal_gaps(context: DataFrame, profile: Profile = SPARSE) -> tuple[DataFrame, DataFrame]:
    """(node baselines, pooled baseline) of a context's normal transitions."""
    gaps = context.where(sequence.normal_transition()).select("node", "gap_prev_s")
    gaps = stage(gaps.select("node", "gap_prev_s"), "gaps")  # several passes read them
    return baseline.node_baselines(gaps, profile), baseline.pooled_baseline(gaps, profile, written=True)


def training_period(context: DataFrame, profile: Profile = SPARSE) -> DataFrame:
    """The rows of a context up to the chronological cutoff; gaps still reach across the whole stream."""
    return sequence.chronological_split(context, profile.train_fraction).where("is_train").drop("cutoff_us", "is_train")


def scored_timing(context: DataFrame, profile: Profile = SPARSE) -> DataFrame:
    """Every row with its baseline, z score and log ratio."""
    nodes, pooled = normal_gaps(context, profile)
    rows = baseline.with_baseline(context, nodes, pooled)
    return rows.withColumns({"z_score": F.coalesce(baseline.z_of("gap_prev_s", profile), F.lit(0.0)), "log_ratio": baseline.log_ratio_of("gap_prev_s", profile)})


def audited(context: DataFrame, profile: Profile = SPARSE) -> DataFrame:
    """Every row with all three signatures."""
    context = stage(context.select("row_id", "timestamp", "node", "anomaly", "event_template", *sequence.CONTEXT), "context")  # six passes read it
    nodes, pooled = normal_gaps(context, profile)
    rows = audit.pure_order(audit.template_rarity(context, profile))
    return audit.timing_gap(baseline.with_baseline(rows, nodes, pooled), profile)


#: Columns of an event that no detector or fault looks at.
UNUSED = ("label", "raw_message")


@dataclass(frozen=True)
class Clean:
    """The clean table's parts that every run needs, each worked out once and written."""

    events: DataFrame
    profile: Profile
    context: DataFrame
    nodes: DataFrame
    pooled: DataFrame
    train_nodes: DataFrame
    train_pooled: DataFrame
    limit: DataFrame
    sizes: DataFrame
    #: The end of the training period, one row.
    cutoff: DataFrame
    #: What only some runs need, by name: worked out once, too.
    made: dict = field(default_factory=dict, repr=False, compare=False)
    _making: dict = field(default_factory=lambda: defaultdict(RLock), repr=False, compare=False)

    def once(self, name, make: Callable):
        """``make()``, kept under ``name``; of several threads one makes it."""
        with self._making[name]:
            if name not in self.made:
                self.made[name] = make()
        return self.made[name]

    def training(self) -> DataFrame:
        """The context's rows of the training period."""
        return self.context.crossJoin(F.broadcast(self.cutoff)).where(F.unix_micros("timestamp") <= F.col("cutoff_us")).drop("cutoff_us")

    def rows(self) -> DataFrame:
        """The events as they were given, read from the written context."""
        return self.context.select(*self.events.columns)

    @classmethod
    def of(cls, events: DataFrame, profile: Profile = SPARSE) -> Clean:
        """Context, baselines of all and of the training period's normal transitions, and the log ratio's limit."""
        events = events.drop(*UNUSED)
        context = stage(sequence.add_sequence_context(events).drop("prev_template", "next_template", "gap_next_s"), "context")
        gaps = context.where(sequence.normal_transition())
        gaps = stage(gaps.select("node", "gap_prev_s", F.unix_micros("timestamp").alias("us")), "gaps")  # several passes read them

        def baselines(rows: DataFrame) -> list[DataFrame]:
            return together(lambda: stage(baseline.node_baselines(rows, profile), "baselines"), lambda: baseline.pooled_baseline(rows, profile, written=True))

        def training() -> tuple[DataFrame, ...]:
            cutoff = sequence.split_cutoff(context, profile.train_fraction, written=True)
            train = gaps.crossJoin(F.broadcast(cutoff)).where(F.col("us") <= F.col("cutoff_us")).drop("cutoff_us")
            nodes, pooled = baselines(train)
            ratio = baseline.with_baseline(train, nodes, pooled).withColumn("log_ratio", baseline.log_ratio_of("gap_prev_s", profile))
            return nodes, pooled, detect.threshold(detect.LogRatio().score(ratio), profile.threshold_quantile), cutoff

        (nodes, pooled), (train_nodes, train_pooled, limit, cutoff), sizes = together(lambda: baselines(gaps), training, lambda: stage(inject.node_sizes(context), "sizes"))
        return cls(events, profile, context, nodes, pooled, train_nodes, train_pooled, limit, sizes, cutoff)


def injected(events: DataFrame, kind: str, profile: Profile = SPARSE, seed: int | None = None, planner=inject.plan_by_hash, clean: Clean | None = None, *, planned_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(injected events, labels, labelled cells) of one fault type; moved events and labels are written once.

    A fault moves events of the planned nodes alone, ``n_injections`` at most: with
    ``planned_only`` the injected events are theirs, and those of all other nodes are the clean ones.
    """
    if clean is None:
        context = stage(sequence.add_sequence_context(events), "context")
        events = context.select(*events.columns)
        nodes, pooled, sizes = *normal_gaps(context, profile), None
    else:
        context, nodes, pooled, sizes = clean.context, clean.nodes, clean.pooled, clean.sizes
    plan = stage(planner(context, nodes, pooled, kind, profile, seed, sizes), "plan")
    if planned_only:
        events = stage(context.join(F.broadcast(plan.select("node")), "node", "left_semi").select(*events.columns), "planned-rows")
    if kind == "stall":
        plan = stage(inject.stall_plan_scaled(plan, nodes, pooled, profile), "plan")
        moved = stage(inject.apply_stalls(events, plan, profile), "moved")
        labels = stage(inject.stall_labels(events, moved, plan), "labels")
    else:
        moved = stage(inject.apply_bursts(events, plan, profile), "moved")
        labels = stage(inject.burst_labels(events, moved, plan), "labels")
    return moved, labels, inject.grid_labels(labels, moved, profile.grid_s)


def timing_rows(clean: Clean, moved: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Rows of injected data with score and flag of the z (``z``, ``fz``) and log-ratio (``r``, ``fr``) detectors.

    Both are fitted on the normal transitions of the clean training period.  ``context``: that of ``moved``, where it is known.
    """
    context = sequence.add_sequence_context(moved) if context is None else context
    rows = baseline.with_baseline(context, clean.train_nodes, clean.train_pooled).crossJoin(F.broadcast(clean.limit))
    z, r = F.abs(F.coalesce(baseline.z_of("gap_prev_s", clean.profile), F.lit(0.0))), F.abs(baseline.log_ratio_of("gap_prev_s", clean.profile))
    return rows.select(*[c for c in moved.columns], z.alias("z"), (z > clean.profile.z_limit).alias("fz"), r.alias("r"), (r > F.col("threshold")).alias("fr"))


def timing_cells(clean: Clean, moved: DataFrame, labelled: DataFrame) -> DataFrame:
    """Cells of injected data with truth and both timing detectors' scores and flags."""
    return evaluate.with_cell_truth(_cells(clean, timing_rows(clean, moved), TIMING), labelled)


#: Detectors by the name under which they report, with the columns of their scores and flags in wide form.
TIMING = {"z_score_threshold": ("z", "fz"), "log_ratio_threshold": ("r", "fr")}
COUNT = {"count_vector_pca": ("p", "fp"), "isolation_forest_counts": ("c", "fc")}
ALL = TIMING | COUNT
#: Count detectors, by the name under which they report.
COUNT_DETECTORS = tuple(COUNT)


def count_detector(name: str, profile: Profile = SPARSE):
    """A new count detector."""
    return detect.CountPCA(profile.pca_components) if name == "count_vector_pca" else detect.IsolationForest("counts", profile.trees)


def count_fits(clean: Clean) -> tuple[DataFrame, dict]:
    """(vocabulary, {name: (fitted detector, its threshold)}) of the count detectors on the clean training period, fitted once for all runs."""

    def fit():
        profile = clean.profile
        train = windows.by_count(clean.training(), profile.window_events)
        vocab = stage(windows.vocabulary(train, profile.vocabulary), "vocabulary")
        fit_on = stage(windows.count_vectors(train, vocab, profile.vocabulary).where("not label"), "train-vectors")
        fits = together(*[partial(detect.fit_limit, count_detector(name, profile), fit_on, profile.threshold_quantile, written=True) for name in COUNT])
        return vocab, dict(zip(COUNT, fits))

    return clean.once("count-fits", fit)


def wide_rows(clean: Clean, moved: DataFrame, detectors: dict, context: DataFrame | None = None) -> DataFrame:
    """Rows of ``moved`` with score and flag of the timing detectors or of all, as columns.

    Windows of ``window_events`` events give the count detectors' scores, which go back to their rows.
    """
    rows = timing_rows(clean, moved, context)
    if detectors is TIMING:
        return rows
    windowed = windows.by_count(rows, clean.profile.window_events)
    vocab, fits = count_fits(clean)
    scored = stage(windows.count_vectors(windows.by_count(moved, clean.profile.window_events), vocab, clean.profile.vocabulary), "vectors")
    for name, (score, flag) in COUNT.items():
        fitted, limit = fits[name]
        scored = detect.flag_above(fitted.score(scored), limit).withColumnsRenamed({"score": score, "flag": flag}).drop("threshold")
    return windows.back_to_rows(windowed, scored, *[c for pair in COUNT.values() for c in pair])


def long_form(wide: DataFrame, detectors: dict, *keys: str) -> DataFrame:
    """(detector, ``keys``, score, flag): a row a detector."""
    each = [F.struct(F.lit(name).alias("detector"), F.col(score).alias("score"), F.col(flag).alias("flag")) for name, (score, flag) in detectors.items()]
    return wide.withColumn("_d", F.explode(F.array(*each))).select("_d.detector", *keys, "_d.score", "_d.flag")


def all_rows(clean: Clean, moved: DataFrame) -> DataFrame:
    """(detector, row_id, node, timestamp, score, flag) of all four detectors."""
    return long_form(wide_rows(clean, moved, ALL), ALL, "row_id", "node", "timestamp")


def _most(detectors: dict) -> list:
    """Largest score and any flag of each detector."""
    return [a for score, flag in detectors.values() for a in (F.max(score).alias(score), F.bool_or(flag).alias(flag))]


def _cells(clean: Clean, rows: DataFrame, detectors: dict) -> DataFrame:
    """Cells of wide rows on the profile's grid, wide, too."""
    return evaluate.eval_grid(rows, clean.profile).groupBy(*windows.CELL).agg(*_most(detectors))


def clean_cells(clean: Clean, detectors: dict) -> DataFrame:
    """(detector, node, window_idx, score, flag) of the clean table's cells, written once for all runs."""
    make = lambda: stage(long_form(_cells(clean, wide_rows(clean, clean.rows(), detectors, clean.context), detectors), detectors, *windows.CELL), "clean-cells")
    return clean.once(("cells", *detectors), make)


def changed_cells(clean: Clean, kind: str, seed: int | None, detectors: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, nodes, labelled cells) of one fault: those of the planned nodes alone, in long form and with truth, and which nodes these are.

    Every other node has its clean events, and so its clean cells, none of them labelled.
    """
    moved, _, labelled = injected(clean.events, kind, clean.profile, seed, clean=clean, planned_only=True)
    labelled = stage(labelled, "labelled")
    cells = long_form(_cells(clean, wide_rows(clean, moved, detectors), detectors), detectors, *windows.CELL)
    return evaluate.with_cell_truth(cells, labelled), moved.select("node").distinct(), labelled


def all_cells(clean: Clean, kind: str, seed: int | None = None, detectors: dict = ALL) -> tuple[DataFrame, DataFrame]:
    """(detector, node, window_idx, truth, score, flag) of the detectors on one fault, written; and the labelled cells."""
    come, nodes, labelled = changed_cells(clean, kind, seed, detectors)
    stay = clean_cells(clean, detectors).join(F.broadcast(nodes), "node", "left_anti").withColumn("truth", F.lit(False))
    return stage(stay.unionByName(come), "cells"), labelled


def as_changes(come: DataFrame, clean: DataFrame, nodes: DataFrame) -> DataFrame:
    """The cells that come (``weight`` 1) and the clean ones of their nodes, which go (-1)."""
    go = clean.join(F.broadcast(nodes), "node").withColumns({"truth": F.lit(False), "weight": F.lit(-1)})
    return come.withColumn("weight", F.lit(1)).unionByName(go)


def changed_runs(clean: Clean, kind: str, seeds: tuple[int, ...], detectors: dict) -> DataFrame:
    """(seed, detector, node, window_idx, truth, score, flag, weight): the cells in which a fault's runs under several plans differ from the clean table.

    All plans go through each step together, their nodes told apart by :func:`inject.of_run`.
    """
    profile, columns = clean.profile, clean.events.columns
    chosen = inject.chosen_rows(clean.context, clean.nodes, clean.pooled, kind, profile, seeds, clean.sizes)
    plan = inject.starts(chosen, kind, profile)
    plan = stage(inject.stall_plan_scaled(plan, clean.nodes, clean.pooled, profile) if kind == "stall" else plan, "plan")
    planned = plan.select("node", "seed")
    events, train_nodes = together(
        lambda: stage(inject.of_run(chosen.join(F.broadcast(planned), ["node", "seed"], "left_semi")).select(*columns), "planned-rows"),
        lambda: stage(inject.of_run(clean.train_nodes.join(F.broadcast(planned), "node")).drop("seed"), "baselines"),
    )
    own = replace(clean, train_nodes=train_nodes)
    apply, label = (inject.apply_stalls, inject.stall_labels) if kind == "stall" else (inject.apply_bursts, inject.burst_labels)
    named = inject.of_run(plan)
    moved = stage(apply(events, named, profile), "moved")
    labelled = inject.grid_labels(stage(label(events, moved, named), "labels"), moved, profile.grid_s)
    cells = evaluate.with_cell_truth(long_form(_cells(own, wide_rows(own, moved, detectors), detectors), detectors, *windows.CELL), labelled)
    return as_changes(inject.run_of(cells), clean_cells(clean, detectors), planned)


def result_rows(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """A row a detector: confusion figures, lift, detection rate with what chance would give, and both AUCs."""
    figures = evaluate.confusion(cells, by=["detector"])
    met = labelled.join(cells.select("detector", *windows.CELL, "flag"), windows.CELL, "left")
    detectors = figures.select("detector")
    # a labelled cell without events has no row of any detector: it counts as not flagged
    grid = labelled.crossJoin(F.broadcast(detectors)).join(met.select("detector", "injection_id", *windows.CELL, "flag"), ["detector", "injection_id", *windows.CELL], "left")
    found = grid.groupBy("detector", "injection_id").agg(F.coalesce(F.bool_or("flag"), F.lit(False)).alias("detected"), F.count("flag").alias("n_populated"))
    chance = F.when(F.col("n_populated") > 0, 1 - F.pow(1 - F.col("flagged_frac"), F.col("n_populated"))).otherwise(F.lit(0.0))
    rates = found.join(figures.select("detector", "flagged_frac"), "detector").groupBy("detector").agg(
        F.count_if("detected").alias("n_detected"), F.count("*").alias("n_injections"), F.avg(F.col("detected").cast("double")).alias("detection_rate"), F.avg(chance).alias("expected_by_chance")
    )
    return figures.join(rates, "detector").join(evaluate.auc(cells, ["detector"]), "detector")


def by_detector(cells: DataFrame) -> DataFrame:
    """The cells of both timing detectors in long form: detector, score, flag, truth."""
    return long_form(cells, TIMING, *windows.CELL, "truth")


def count_detector_windows(events: DataFrame, detector, scheme: str = "fixed_count", size: float | None = None, profile: Profile = SPARSE) -> DataFrame:
    """Windows of the test period with score and flag of a detector on template counts.

    The vocabulary and the detector come from the training period, whose windows
    with no anomaly are fitted on.
    """
    size = profile.window_events if size is None else size
    split = sequence.chronological_split(events, profile.train_fraction)
    train, test = (windows.assign(split.where(c).drop("is_train", "cutoff_us"), scheme, size) for c in ("is_train", "not is_train"))
    vocab = windows.vocabulary(train, profile.vocabulary)
    width = profile.vocabulary
    fit_on = windows.count_vectors(train, vocab, width).where("not label")
    return detect.fit_score(detector, fit_on, windows.count_vectors(test, vocab, width), profile.threshold_quantile)


def timing_forest(events: DataFrame, profile: Profile = SPARSE) -> DataFrame:
    """Test-period rows with score and flag of the isolation forest on timing features."""
    context = sequence.add_sequence_context(events)
    split = sequence.chronological_split(context, profile.train_fraction)
    train = split.where("is_train").where(sequence.normal_transition())
    gaps = stage(train.select("node", "gap_prev_s"), "gaps")
    nodes, pooled = baseline.node_baselines(gaps, profile), baseline.pooled_baseline(gaps, profile)
    rows = features.build_features(split, nodes, pooled, profile)
    forest = detect.IsolationForest(features.FEATURES, profile.trees)
    return detect.fit_score(forest, rows.where("is_train").where(sequence.normal_transition()), rows.where("not is_train"), profile.threshold_quantile)


def timing_forest_on(clean: Clean, moved: DataFrame) -> DataFrame:
    """Injected rows with timing features, score and flag of the isolation forest fitted on the clean training period."""
    build = lambda rows: features.build_features(rows, clean.train_nodes, clean.train_pooled, clean.profile)
    train = build(clean.context).join(F.broadcast(sequence.split_cutoff(clean.context, clean.profile.train_fraction)), how="cross")
    train = train.where(F.unix_micros("timestamp") <= F.col("cutoff_us")).where(sequence.normal_transition())
    forest = detect.IsolationForest(features.FEATURES, clean.profile.trees)
    return detect.fit_score(forest, train, build(sequence.add_sequence_context(moved)), clean.profile.threshold_quantile)


def native_flags(events: DataFrame, profile: Profile = SPARSE) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(test rows, (detector, row_id, flag), flags in each detector's own unit with its truth) of the count detectors and the timing forest.

    All are fitted once on the training period; what they say of a row doesn't depend on the grid it is judged on.
    """
    split = sequence.chronological_split(events, profile.train_fraction)
    test = stage(split.where("not is_train").drop("is_train", "cutoff_us"), "test")
    own, rows = {}, []
    for name in COUNT_DETECTORS:
        own[name] = stage(count_detector_windows(events, count_detector(name, profile), profile=profile).select(*windows.CELL, F.col("label").alias("truth"), "flag"), "flags")
        rows.append(windows.back_to_rows(windows.by_count(test, profile.window_events), own[name], "flag").select(F.lit(name).alias("detector"), "row_id", "flag"))
    forest = stage(timing_forest(events, profile).select("row_id", F.col("anomaly").alias("truth"), "flag"), "flags")
    own["timing_isolation_forest"] = forest
    rows.append(forest.select(F.lit("timing_isolation_forest").alias("detector"), "row_id", "flag"))
    return test, stage(reduce(DataFrame.unionByName, rows), "row-flags"), own


def on_grids(test: DataFrame, flags: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(detector, grid_size_s, confusion figures): flags of rows on grids of several cell sizes, each test row in one cell of each.

    A row without a flag isn't flagged.
    """
    gridded = _in_schemes(test.select("row_id", "node", "timestamp", "anomaly"), [("fixed_time", s) for s in sizes])
    names = flags.select("detector").distinct()
    met = gridded.crossJoin(F.broadcast(names)).join(flags, ["detector", "row_id"], "left")
    cells = met.groupBy("detector", F.col("size").alias("grid_size_s"), *windows.CELL).agg(F.bool_or("anomaly").alias("truth"), F.bool_or(F.coalesce("flag", F.lit(False))).alias("flag"))
    return evaluate.confusion(cells, by=["detector", "grid_size_s"])


def rescored(events: DataFrame, profile: Profile = SPARSE) -> DataFrame:
    """(detector, unit, confusion figures): three detectors' test-period flags in windows or rows of their own, and on the common grid."""
    test, flags, own = native_flags(events, profile)
    unit = lambda name: F.lit("row" if name == "timing_isolation_forest" else "window")
    native = [evaluate.confusion(d).withColumns({"detector": F.lit(name), "unit": unit(name)}) for name, d in own.items()]
    grid = on_grids(test, flags, (profile.grid_s,)).drop("grid_size_s").withColumn("unit", F.lit("grid"))
    return reduce(DataFrame.unionByName, [*native, grid])


def native_stability(events: DataFrame, sizes: tuple[int, ...], profile: Profile = SPARSE) -> DataFrame:
    """(detector, grid_size_s, confusion figures) of the natively fitted detectors; ``certified`` marks the profile's own grid."""
    test, flags, _ = native_flags(events, profile)
    return on_grids(test, flags, sizes).withColumn("certified", F.col("grid_size_s") == profile.grid_s)


def multi_seed(
    events: DataFrame, kinds: tuple[str, ...], seeds: tuple[int, ...], profile: Profile = SPARSE, *, all_detectors: bool = False, path: str | None = None
) -> DataFrame:
    """(fault_type, seed, detector, auc_roc, ...) over several plans; the clean table's parts are made once.

    A fault under all plans is a run, which publishes, when they are whole, the cells in which
    its plans differ from the clean table: with a ``path`` a sweep that was stopped goes on.
    """
    spark, detectors = events.sparkSession, ALL if all_detectors else TIMING
    clean = Clean.of(events, profile)
    told = ",".join(map(str, seeds))

    def run(fault_type: str, seeds: str) -> DataFrame:
        return changed_runs(clean, fault_type, tuple(int(s) for s in seeds.split(",")), detectors)

    runs = [{"fault_type": k, "seeds": told} for k in kinds]
    _, changes = together(lambda: clean_cells(clean, detectors), lambda: sweep(spark, path or scratch(spark, "seeds"), runs, run, at_once=len(runs)))
    named = spark.createDataFrame([(k, s) for k in kinds for s in seeds], "fault_type string, seed int")
    return evaluate.changed_auc(clean_cells(clean, detectors), changes, named, ["detector"])


#: Window schemes of the sweep.
SCHEMES = (("fixed_count", 5), ("fixed_count", 10), ("fixed_count", 20), ("fixed_time", 43_200), ("fixed_time", 86_400), ("fixed_time", 172_800))


def _in_schemes(rows: DataFrame, schemes) -> DataFrame:
    """A row of ``rows`` for each window scheme, with ``scheme``, ``size`` and its ``window_idx``.

    Place and origin of a row are found once; every scheme's window follows from them.
    """
    origin = rows.groupBy("node").agg(F.min("timestamp").alias("_origin"))
    placed = sequence.add_position(rows, "_place").join(origin, "node")
    elapsed = seconds_between(F.col("_origin"), F.col("timestamp"))
    window = {
        "fixed_count": lambda size: F.floor(F.col("_place") / size),
        "fixed_time": lambda size: cell_index(elapsed, F.lit(float(size))),
    }
    each = [F.struct(F.lit(s).alias("scheme"), F.lit(int(size)).alias("size"), window[s](size).alias("window_idx")) for s, size in schemes]
    return placed.withColumn("_w", F.explode(F.array(*each))).select(*rows.columns, "_w.*")


def window_sweep(clean: Clean, kinds: tuple[str, ...] = ("stall", "burst"), schemes=SCHEMES, *, all_detectors: bool = False, path: str | None = None) -> DataFrame:
    """Confusion figures, lift and AUC for each fault, window scheme and detector; a window is true if any of its rows lies in a span.

    Each fault is a run, published as in :func:`multi_seed`.
    """
    by, detectors = ["scheme", "size", "detector"], ALL if all_detectors else TIMING
    cell = ["scheme", "size", *windows.CELL]

    def in_windows(rows: DataFrame, *more) -> DataFrame:
        columns = [c for c in rows.columns if c == "truth" or any(c in pair for pair in detectors.values())]
        return _in_schemes(rows.select("row_id", "node", "timestamp", *columns), schemes).groupBy(*cell).agg(*_most(detectors), *more)

    def clean_windows() -> DataFrame:
        make = lambda: stage(long_form(in_windows(wide_rows(clean, clean.rows(), detectors, clean.context)), detectors, *cell), "clean-windows")
        return clean.once(("windows", *schemes, *detectors), make)

    def run(fault_type: str) -> DataFrame:
        moved, labels, _ = injected(clean.events, fault_type, clean.profile, clean=clean, planned_only=True)
        rows = inject.in_span(wide_rows(clean, moved, detectors), labels, "truth")
        come = long_form(in_windows(rows, F.bool_or("truth").alias("truth")), detectors, *cell, "truth")
        return as_changes(come, clean_windows(), moved.select("node").distinct())

    spark = clean.events.sparkSession
    runs = [{"fault_type": k} for k in kinds]
    of_clean, changes = together(clean_windows, lambda: sweep(spark, path or scratch(spark, "sweep"), runs, run, at_once=len(runs)))
    named = spark.createDataFrame(runs, "fault_type string")
    keys = ["fault_type", *by]
    return evaluate.changed_confusion(of_clean, changes, named, by).join(evaluate.changed_auc(of_clean, changes, named, by), keys)


def _learning(events: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cutoff, normal training events, their vocabulary), the cutoff found once."""
    cut = sequence.split_cutoff(events, profile.train_fraction)
    normal = events.crossJoin(F.broadcast(cut)).where(F.unix_micros("timestamp") <= F.col("cutoff_us")).where("not anomaly").drop("cutoff_us")
    return cut, normal, stage(windows.sorted_vocabulary(normal), "vocabulary")


def _asked(scored: DataFrame, cut: DataFrame, test_only: bool) -> tuple[DataFrame, Column]:
    """(``scored`` or its rows after the cutoff, a condition on its time stamp that holds for them)."""
    if not test_only:
        return scored, F.lit(True)
    later = F.unix_micros("timestamp") > F.lit(cut.first()["cutoff_us"])
    return scored.where(later), later


def next_event_rows(events: DataFrame, scored: DataFrame, order: int = 10, profile: Profile = SPARSE, *, test_only: bool = False) -> DataFrame:
    """``scored`` with score and flag of the next-event detector learned from normal training events of ``events``.

    ``test_only``: rows after the training period alone are judged; those before them still are their context.
    """
    cut, normal, vocab = _learning(events, profile)
    rows, wanted = _asked(scored, cut, test_only)
    counts = detect.next_event_counts(windows.encode(normal, vocab), order)
    scores = detect.next_event_scores(windows.encode(scored, vocab), counts, vocab.count(), order=order, wanted=wanted)
    return rows.join(scores.drop("node"), "row_id")


def recurrent_rows(events: DataFrame, scored: DataFrame, length: int = 10, profile: Profile = SPARSE, *, test_only: bool = False) -> DataFrame:
    """``scored`` with score and flag of the gated network learned from normal training events of ``events``; ``test_only`` as above."""
    cut, normal, vocab = _learning(events, profile)
    rows, wanted = _asked(scored, cut, test_only)
    n = vocab.count() + 1
    weights = recurrent.fit(windows.encode(normal, vocab), n, length=length)
    return rows.join(recurrent.scores(windows.encode(scored, vocab), weights, n, length=length, wanted=wanted).drop("node"), "row_id")
