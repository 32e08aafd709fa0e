"""Scoring on a shared per-node time grid.

Only populated cells count.  Every figure is a grouped aggregate; rankings group
by score first, so their running sums go over distinct scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timing import ratio_or_null, ratio_or_zero
from ..schema import SYSTEM_LOG, Profile
from ..sources.sinks import stage
from .windows import CELL, by_time


def eval_grid(rows: DataFrame, profile: Profile = SYSTEM_LOG) -> DataFrame:
    """Rows with the cell of the evaluation grid."""
    return by_time(rows, profile.grid_s)


def to_cells(gridded: DataFrame, *, truth: str | None = None, flag: str | None = None, score: str | None = None) -> DataFrame:
    """(node, window_idx, truth, flag, score): any truth, any flag, largest score of each cell."""
    aggs = []
    if truth:
        aggs.append(F.bool_or(F.coalesce(truth, F.lit(False))).alias("truth"))
    if flag:
        aggs.append(F.bool_or(F.coalesce(flag, F.lit(False))).alias("flag"))
    if score:
        aggs.append(F.max(F.coalesce(score, F.lit(0.0))).alias("score"))
    return gridded.groupBy(*CELL).agg(*aggs)


def with_cell_truth(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """``truth``: the cell is a labelled one."""
    marks = labelled.select(*CELL).distinct().withColumn("_hit", F.lit(True))
    return cells.join(marks, CELL, "left").withColumn("truth", F.coalesce("_hit", F.lit(False))).drop("_hit")


def confusion(cells: DataFrame, truth: str = "truth", flag: str = "flag", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, flagged_frac, lift and n_cells; zero where a ratio has no base.

    ``weight``: how many cells a row stands for, less than none if it takes some away.
    """
    t, p = F.col(truth), F.col(flag)
    n = (lambda c: F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0))) if weight else F.count_if
    counts = cells.groupBy(*(by or [])).agg(
        n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"), (F.sum(weight) if weight else F.count("*")).alias("n_cells")
    )
    c = F.col
    rows = counts.withColumns({"precision": ratio_or_zero(c("tp"), c("tp") + c("fp")), "recall": ratio_or_zero(c("tp"), c("tp") + c("fn")), "flagged_frac": ratio_or_zero(c("tp") + c("fp"), c("n_cells"))})
    return rows.withColumns({"f1": ratio_or_zero(2 * c("precision") * c("recall"), c("precision") + c("recall")), "lift": ratio_or_null(c("recall"), c("flagged_frac"))})


def detection(labelled: DataFrame, cells: DataFrame, flag: str = "flag") -> DataFrame:
    """(injection_id, n_cells, n_populated, detected): empty labelled cells count as not flagged."""
    met = labelled.join(cells.select(*CELL, F.col(flag).alias("_flag")), CELL, "left")
    return met.groupBy("injection_id").agg(F.count("*").alias("n_cells"), F.count("_flag").alias("n_populated"), F.coalesce(F.bool_or("_flag"), F.lit(False)).alias("detected"))


def detection_rate(detected: DataFrame) -> DataFrame:
    """One row."""
    return detected.agg(F.count_if("detected").alias("n_detected"), F.count("*").alias("n_injections"), F.avg(F.col("detected").cast("double")).alias("detection_rate"))


def chance_rate(detected: DataFrame, flagged_fraction: DataFrame) -> DataFrame:
    """One row: the detection rate that flags dealt at random would reach."""
    p = F.when(F.col("n_populated") > 0, 1 - F.pow(1 - F.col("flagged_frac"), F.col("n_populated"))).otherwise(F.lit(0.0))
    return detected.crossJoin(F.broadcast(flagged_fraction.select("flagged_frac"))).agg(F.avg(p).alias("expected_by_chance"))


def score_table(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(score, pos, neg) by distinct score, with the counts below it and the totals.

    Scores are dealt by range, and a task's part of a group is summed first, so no
    task has to sort all distinct scores.
    """
    by = by or []
    return _ranked(cells.groupBy(*by, "score").agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg")), by)


def _ranked(table: DataFrame, by: list[str]) -> DataFrame:
    """The score table of (score, pos, neg), a row a score."""
    table = stage(table.repartitionByRange(*by, "score").sortWithinPartitions(*by, "score").withColumn("_part", F.spark_partition_id()), "scores")
    parts = table.groupBy(*by, "_part").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    before, whole = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    offsets = parts.select(
        *by, "_part", F.coalesce(F.sum("_pos").over(before), F.lit(0)).alias("_pos_before"), F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_neg_before"),
        F.sum("_pos").over(whole).alias("n_pos"), F.sum("_neg").over(whole).alias("n_neg"),
    )
    up = Window.partitionBy(*by, "_part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    rows = table.withColumns({"_pos_up": F.sum("pos").over(up), "_neg_up": F.sum("neg").over(up)}).join(F.broadcast(offsets), [*by, "_part"])
    return rows.select(
        *by, "score", "pos", "neg", (c("_neg_up") - c("neg") + c("_neg_before")).alias("neg_below"),
        (c("n_pos") - c("_pos_up") - c("_pos_before") + c("pos")).alias("tp"), (c("n_neg") - c("_neg_up") - c("_neg_before") + c("neg")).alias("fp"), "n_pos", "n_neg",
    )


def auc(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """auc_roc (ties count half), auc_pr (step sum), prevalence and their ratio; null for a single class."""
    return _areas(score_table(cells, by), by or [])


def _areas(table: DataFrame, by: list[str]) -> DataFrame:
    """The figures of :func:`auc` from a score table; scores without a positive add nothing to either area."""
    c = F.col
    base = F.try_divide(F.max("n_pos"), F.max("n_pos") + F.max("n_neg"))
    both = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
    rows = table.groupBy(*by).agg(
        F.when(both, F.try_divide(F.sum(c("pos") * (c("neg_below") + 0.5 * c("neg"))), F.max("n_pos").cast("double") * F.max("n_neg"))).alias("auc_roc"),
        F.when(both, F.sum(F.try_divide(c("pos"), c("n_pos")) * F.try_divide(c("tp"), c("tp") + c("fp")))).alias("auc_pr"),
        base.alias("no_skill_baseline"), (F.max("n_pos") + F.max("n_neg")).alias("n_eval_cells"), F.max("n_pos").alias("n_positive_cells"),
    )
    return rows.withColumn("auc_pr_ratio", ratio_or_null(c("auc_pr"), c("no_skill_baseline")))


# --- tables that differ from one common table in few cells ---------------------------------


def changed_confusion(clean: DataFrame, changes: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """:func:`confusion` by run and ``by`` of the tables that ``changes`` make of ``clean`` (``by``, score, flag), all of whose cells are negative.

    ``changes`` has a run's key, ``by``, truth, flag, score and the weight of each cell that
    comes (1) or goes (-1); ``runs`` has the keys of all runs, a few rows.
    """
    kept = clean.groupBy(*by, "flag").agg(F.count("*").alias("weight")).withColumn("truth", F.lit(False)).crossJoin(F.broadcast(runs))
    keys = [*runs.columns, *by]
    return confusion(kept.unionByName(changes.select(*keys, "flag", "truth", "weight")), by=keys, weight="weight")


def changed_auc(clean: DataFrame, changes: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """:func:`auc` by run and ``by`` of the same tables.

    Both areas are sums over the scores of positives, which only changes have.  So the
    clean table is ranked once for all runs, with the scores asked for among its own;
    the changes, which are few, are ranked by run, and the counts are added up.
    """
    keys, c, zero = [*runs.columns, *by], F.col, F.lit(0).cast("long")
    n = lambda truth: F.coalesce(F.sum(F.when(truth, c("weight"))), zero)
    moved = stage(changes.groupBy(*keys, "score").agg(n(c("truth")).alias("pos"), n(~c("truth")).alias("neg")), "changed-scores")
    asked = moved.where("pos > 0").select(*by, "score").distinct().withColumns({"pos": zero, "neg": zero})
    levels = clean.groupBy(*by, "score").agg(zero.alias("pos"), F.count("*").alias("neg")).unionByName(asked).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    told = _ranked(levels, by)
    there = [told[k].eqNullSafe(asked[k]) for k in (*by, "score")]
    told = told.join(asked, reduce(lambda a, b: a & b, there), "left_semi")
    told = told.select(*[c(k).alias(f"_{k}") for k in (*by, "score")], c("neg").alias("_neg"), c("neg_below").alias("_below"))
    own = _ranked(moved, keys).where("pos > 0")
    met = own.join(told, reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_{k}")) for k in (*by, "score")]))
    totals = clean.groupBy(*by).agg(F.count("*").alias("n")).crossJoin(F.broadcast(runs)).select(*keys, zero.alias("p"), "n")
    totals = totals.unionByName(moved.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    met = totals.join(met.select(*keys, "pos", "tp", (c("neg") + c("_neg")).alias("neg"), (c("neg_below") + c("_below")).alias("neg_below")), keys, "left")
    return _areas(met.withColumn("fp", c("n_neg") - c("neg_below")), keys)


def fusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: agreement of two detectors' cells (node, window_idx, truth, flag), and what flagging by either gains and costs."""
    left = a.select(*CELL, F.col("flag").alias("fa"), F.col("truth").alias("ta"))
    right = b.select(*CELL, F.col("flag").alias("fb"), F.col("truth").alias("tb"))
    false = F.lit(False)
    cells = left.join(right, CELL, "full").select(F.coalesce("fa", false).alias("a"), F.coalesce("fb", false).alias("b"), F.coalesce("ta", "tb").alias("t"))

    def share(flag: Column, of: Column) -> Column:
        return ratio_or_zero(F.count_if(flag & of), F.count_if(of))

    a_, b_, t = F.col("a"), F.col("b"), F.col("t")
    row = cells.agg(
        ratio_or_null(F.count_if(a_ & b_), F.count_if(a_ | b_)).alias("jaccard"),
        share(a_, t).alias("recall_a"), share(b_, t).alias("recall_b"), share(a_ | b_, t).alias("recall_either"),
        share(t, a_).alias("precision_a"), share(t, b_).alias("precision_b"), share(t, a_ | b_).alias("precision_either"),
    )
    c = F.col
    return row.withColumns(
        {
            "recall_gain_over_a": c("recall_either") - c("recall_a"), "recall_gain_over_b": c("recall_either") - c("recall_b"),
            "precision_cost_vs_a": c("precision_a") - c("precision_either"), "precision_cost_vs_b": c("precision_b") - c("precision_either"),
        }
    )


def bootstrap_ci(cells: DataFrame, labelled: DataFrame, n_injections: int, *, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """One row: AUC and its 95 % interval over resampled injections.

    A positive cell's rank among the negatives never changes, so each replicate
    reweights one small table (an injection's cells and their summed ranks).
    """
    spark: SparkSession = cells.sparkSession
    owner = labelled.groupBy(*CELL).agg(F.max("injection_id").alias("injection_id"))
    ranks = score_table(cells).where("pos > 0").select("score", ((F.col("neg_below") + 0.5 * F.col("neg")) / F.col("n_neg")).alias("rank"))
    positives = cells.where("truth").join(ranks, "score").join(owner, CELL)
    each = positives.groupBy("injection_id").agg(F.count("*").alias("k"), F.sum("rank").alias("ranks"))
    # the first eight digits of an md5, which other engines have too
    text = F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string"))
    draw = (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n_injections).cast("int")
    drawn = (
        spark.range(replicates).withColumnRenamed("id", "rep").crossJoin(spark.range(n_injections).withColumnRenamed("id", "i"))
        .select("rep", draw.alias("injection_id")).groupBy("rep", "injection_id").agg(F.count("*").alias("mult"))
    )
    reps = drawn.join(F.broadcast(each), "injection_id").groupBy("rep").agg((F.sum(F.col("mult") * F.col("ranks")) / F.sum(F.col("mult") * F.col("k"))).alias("auc"))
    interval = reps.agg(F.percentile("auc", F.lit(0.025)).alias("ci_low"), F.percentile("auc", F.lit(0.975)).alias("ci_high"), F.count("*").alias("n_replicates"))
    return each.agg((F.sum("ranks") / F.sum("k")).alias("auc_roc")).crossJoin(interval).withColumn("crosses_chance", (F.col("ci_low") <= 0.5) & (F.col("ci_high") >= 0.5))


def seed_summary(runs: DataFrame, by: list[str], value: str = "auc_roc") -> DataFrame:
    """Mean, deviation and range of a figure over seeds, and whether it lies on both sides of chance."""
    return runs.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n_seeds"), F.min(value).alias("min"),
        F.max(value).alias("max"), ((F.min(value) < 0.5) & (F.max(value) > 0.5)).alias("crosses_chance"),
    )


def f1_stability(results: DataFrame) -> DataFrame:
    """(grid_size_s, ranking): detectors by F1 at each grid size; ``stable``: the order never changes."""
    ranked = results.groupBy("grid_size_s").agg(F.transform(F.sort_array(F.collect_list(F.struct("f1", "detector")), asc=False), lambda x: x["detector"]).alias("ranking"))
    return ranked.crossJoin(ranked.agg((F.countDistinct("ranking") == 1).alias("stable")))


def f1_swing(results: DataFrame) -> DataFrame:
    """Range of each detector's F1 over grid sizes."""
    return results.groupBy("detector").agg(F.min("f1").alias("f1_min"), F.max("f1").alias("f1_max"), (F.max("f1") - F.min("f1")).alias("f1_range"))


def invariance(clean: DataFrame, injected: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: how far the scores (node, window_idx, score) of common windows differ."""
    d = F.abs(F.col("a") - F.col("b"))
    met = clean.select(*CELL, F.col("score").alias("a")).join(injected.select(*CELL, F.col("score").alias("b")), CELL)
    return met.agg(F.count("*").alias("n_common_windows"), F.max(d).alias("max_abs_score_diff"), F.count_if(d > tolerance).alias("n_differing_windows"))


def reassignments(clean: DataFrame, injected: DataFrame) -> DataFrame:
    """One row: rows (row_id, window_idx) whose cell changed."""
    met = clean.select("row_id", F.col("window_idx").alias("a")).join(injected.select("row_id", F.col("window_idx").alias("b")), "row_id")
    return met.agg(F.count("*").alias("n_common_rows"), F.count_if(F.col("a") != F.col("b")).alias("n_reassigned"))


def labelling_diagnostic(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: labelled cells that hold events and those that can't be detected."""
    distinct = labelled.select(*CELL).distinct()
    met = distinct.join(cells.select(*CELL, F.lit(True).alias("_there")).distinct(), CELL, "left")
    empty = F.count_if(F.col("_there").isNull())
    return met.agg(F.count("*").alias("n_labelled"), empty.alias("n_undetectable"), F.count("_there").alias("n_detectable"), (100 * empty / F.count("*")).alias("pct_undetectable"))


def consolidate(results: list[DataFrame], aucs: DataFrame, keys: list[str]) -> DataFrame:
    """Result rows united, the first of each key kept, with their AUC columns; fails if a key has none or several."""
    rows = reduce(DataFrame.unionByName, [r.withColumn("_order", F.lit(i)) for i, r in enumerate(results)])
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))).where("_rank = 1").drop("_rank", "_order")
    met = stage(first.join(aucs.withColumn("_found", F.lit(1)), keys, "left"), "consolidated")
    per_key = met.groupBy(*keys).agg(F.count("_found").alias("n")).where("n <> 1")
    if odd := per_key.limit(5).collect():  # result tables are small
        raise ValueError(f"results without exactly one AUC row: {odd}")
    return met.drop("_found")


def display_table(results: DataFrame, labels: dict[str, str], column: str = "detector") -> DataFrame:
    """Results with the label to show and its place in the order of ``labels``; ``flagged_frac`` is the base rate."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    places = F.create_map(*[F.lit(x) for k, name in enumerate(labels) for x in (name, k)])
    return results.withColumns({f"{column}_label": names[F.col(column)], f"{column}_order": places[F.col(column)]}).withColumnRenamed("flagged_frac", "base_rate")


def side_by_side(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Two result tables by key, each column as ``old_`` and ``new_``, and whether they agree."""
    left = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in columns])
    right = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in columns])
    return left.join(right, keys).withColumn("same", same)


def cross_check(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: keys on both sides, keys on one alone, keys met more than once, and the largest difference of ``value``."""
    left = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    met = left.join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b")), keys, "full")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    one = met.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(both).alias("both"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("diff"))
    return one.agg(
        F.count_if("both").alias("n_both"), F.count_if(~F.col("both")).alias("n_one_side"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.max("diff").alias("max_abs_diff")
    )


def conflicting_duplicates(results: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with several rows that disagree in some column."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(F.struct(*rest)).alias("n_distinct")).where("n_distinct > 1")
