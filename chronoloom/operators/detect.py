"""Anomaly detectors: fitted on normal training rows, scored anywhere."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.ordered import by_node
from ..functions.quantile import exact_quantile
from ..schema import SYSTEM_LOG, Profile
from ..sources.sinks import stage


def threshold(normal_scores: DataFrame, q: float = 0.95) -> DataFrame:
    """One row: linear quantile of ``score`` over normal training rows."""
    scores = stage(normal_scores.select("score"), "normal-scores")  # worked out once, whatever the passes
    return normal_scores.sparkSession.createDataFrame([(exact_quantile(scores, "score", q, written=True),)], "threshold double")


def flag_above(scored: DataFrame, limit: DataFrame) -> DataFrame:
    """``flag``: strictly above the one-row threshold."""
    return scored.crossJoin(F.broadcast(limit)).withColumn("flag", F.col("score") > F.col("threshold"))


def fit_score(detector, train: DataFrame, rows: DataFrame, q: float = 0.95) -> DataFrame:
    """Fit on ``train``, score ``rows`` and flag those above the training quantile."""
    fitted, limit = fit_limit(detector, train, q)
    return flag_above(fitted.score(rows), limit)


def fit_limit(detector, train: DataFrame, q: float = 0.95, *, written: bool = False) -> tuple:
    """(the detector fitted on ``train``, its one-row threshold), to score any number of tables with; ``written``: it is read from files."""
    train = train if written else stage(train, "training-rows")  # read by every step of a fit
    fitted = detector.fit(train)
    return fitted, threshold(fitted.score(train), q)


class FixedZ:
    """abs(z) as score; nothing is fitted and the limit is fixed."""

    def __init__(self, profile: Profile = SYSTEM_LOG):
        self.limit = profile.z_limit

    def fit(self, train: DataFrame) -> FixedZ:
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", F.abs(F.coalesce("z_score", F.lit(0.0))))

    def flag(self, rows: DataFrame) -> DataFrame:
        return self.score(rows).withColumn("flag", F.col("score") > self.limit)


class LogRatio:
    """abs(ln(gap / median)) as score; its limit is a training quantile."""

    def fit(self, train: DataFrame) -> LogRatio:
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", F.abs(F.col("log_ratio")))


class CountPCA:
    """Squared reconstruction error of centred count vectors on their principal axes."""

    def __init__(self, components: int = 20, column: str = "counts"):
        self.components, self.column = components, column

    def fit(self, train: DataFrame) -> CountPCA:
        """Mean and axes; axes are clamped to the width and to one less than the rows."""
        row = train.agg(Summarizer.mean(F.col(self.column)).alias("mean"), F.count("*").alias("n")).first()
        self.mean = row["mean"].toArray()
        k = max(1, min(self.components, row["n"] - 1, len(self.mean)))
        self.axes = PCA(k=k, inputCol=self.column, outputCol="_pc").fit(train.select(self.column)).pc.toArray()
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        mean, axes = self.mean, self.axes
        from pyspark.ml.functions import vector_to_array

        @F.pandas_udf("double")
        def error(x: pd.Series) -> pd.Series:
            centred = np.stack(x.to_list()) - mean if len(x) else np.zeros((0, len(mean)))
            return pd.Series((centred**2).sum(1) - ((centred @ axes) ** 2).sum(1)).clip(lower=0.0)

        return rows.withColumn("score", error(vector_to_array(self.column)))


@dataclass
class _Tree:
    """An isolation tree in arrays: a leaf has feature -1 and its path length as value."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


class IsolationForest:
    """Isolation forest (Liu, Ting and Zhou, 2008); larger scores are more isolated.

    Each tree sees at most ``sample`` rows, so a forest is small whatever the
    training set: one bounded sample is drawn (by hash), trees are built from it on the
    driver, and scoring is a vectorised map with the trees broadcast.
    """

    def __init__(self, columns: list[str] | str, trees: int = 100, sample: int = 256, seed: int = 0):
        self.columns, self.trees, self.sample, self.seed = columns, trees, sample, seed

    def _matrix(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        x = vector_to_array(self.columns) if isinstance(self.columns, str) else F.array(*[F.col(c).cast("double") for c in self.columns])
        return df.withColumn("_x", x)

    def fit(self, train: DataFrame) -> IsolationForest:
        x = self._sampled(train)
        rng = np.random.default_rng(self.seed)
        self.psi = min(self.sample, len(x))
        self.forest = [self._grow(x[rng.choice(len(x), self.psi, replace=False)], rng) for _ in range(self.trees)]
        return self

    def _sampled(self, train: DataFrame) -> np.ndarray:
        """The ``sample * trees`` rows of smallest hash, in order; vectors reach the driver without their zeros.

        A sort with a limit has every task hand in that many rows, so rows are cut at a
        hash first that leaves little more than as many in all.
        """
        keys, most = [c for c in ("row_id", "node", "window_idx") if c in train.columns], self.sample * self.trees
        sparse = isinstance(self.columns, str)
        filled = F.filter(F.transform("_x", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
        told = [F.size("_x").alias("width"), filled["i"].alias("at"), filled["x"].alias("values")] if sparse else [F.col("_x").alias("values")]
        # zeros go before the sort: what follows a limit is worked out on the driver
        rows = self._matrix(train).select(*told, F.xxhash64(F.lit(self.seed), *keys).alias("_o"), *keys)
        n, some = rows.count(), rows
        share = (most + 6 * most**0.5 + 100) / max(n, 1)
        while keys and share < 1:
            some = rows.where(F.col("_o") < int(share * 2.0**64) - 2**63)
            if some.count() >= most:
                break
            some, share = rows, 2 * share
        drawn = some.orderBy("_o", *keys).limit(most).drop("_o", *keys).toPandas()
        if not sparse:
            return np.array(drawn["values"].tolist(), float) if len(drawn) else np.zeros((1, 1))
        x = np.zeros((max(len(drawn), 1), int(drawn["width"].max()) if len(drawn) else 1))
        for row, at, values in zip(x, drawn["at"], drawn["values"]):
            row[np.asarray(at, int)] = values
        return x

    def _grow(self, x: np.ndarray, rng) -> _Tree:
        limit = int(np.ceil(np.log2(max(self.psi, 2))))
        feature, value, left, right = [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(feature)
            for column in (feature, value, left, right):
                column.append(-1)
            spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 else []
            if depth >= limit or not len(spread):
                value[at] = depth + _expected_path(len(rows))
                return at
            f = int(rng.choice(spread))
            cut = rng.uniform(x[rows, f].min(), x[rows, f].max())
            feature[at], value[at] = f, cut
            below = x[rows, f] < cut
            left[at], right[at] = node(rows[below], depth + 1), node(rows[~below], depth + 1)
            return at

        node(np.arange(len(x)), 0)
        return _Tree(np.array(feature), np.array(value, float), np.array(left), np.array(right))

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row over the trees."""
        total = np.zeros(len(x))
        for t in self.forest:
            at = np.zeros(len(x), int)
            while len(inner := np.flatnonzero(t.feature[at] >= 0)):
                a = at[inner]
                at[inner] = np.where(x[inner, t.feature[a]] < t.value[a], t.left[a], t.right[a])
            total += t.value[at]
        return total / len(self.forest)

    def score(self, rows: DataFrame) -> DataFrame:
        shared, norm = rows.sparkSession.sparkContext.broadcast(self), max(_expected_path(self.psi), 1e-12)

        @F.pandas_udf("double")
        def isolation(x: pd.Series) -> pd.Series:
            values = np.array(x.to_list(), float).reshape(len(x), -1)
            return pd.Series(2.0 ** (-shared.value.path_lengths(values) / norm))

        return self._matrix(rows).withColumn("score", isolation("_x")).drop("_x")


#: A context: its length and two hashes of its events, in place of the events.
_CONTEXT = ["size", "h1", "h2"]
#: Contexts of so many events or more are dealt by their last ones, so that a history goes to one task with all of them.
NEAR = 2
#: Times the session's partitions that histories are dealt over: a task makes up to ten contexts of each.
PARTS = 8


def next_event_counts(train: DataFrame, order: int = 10) -> DataFrame:
    """(near, size, h1, h2, total, kinds, targets): next events after every context of up to ``order`` events, the empty one included.

    ``targets`` has the count and rank of each next event.  Stands in for a recurrent
    next-event model behind the same contract: a score -log p(target) and a top-k test.
    Equal histories are counted before anything is made of them; ``near`` is null for
    contexts of under ``NEAR`` events, and long ones lie dealt by it.
    """
    rows = _with_ids(train.select("row_id", "timestamp", "node", "template_id"), order)
    told = stage(rows.groupBy("ids", "template_id").agg(F.count("*").alias("cnt")), "histories")  # short and long contexts are made of it
    short = _contexts(told, 0, NEAR - 1, "template_id", "cnt").withColumn("near", F.lit(None).cast("long"))
    return _targets(short).unionByName(_targets(_contexts(_dealt(told), NEAR, order, "template_id", "cnt", "near")))


def _targets(contexts: DataFrame) -> DataFrame:
    """A row a context, its next events by falling count."""
    key = ["near", *_CONTEXT]
    counts = contexts.groupBy(*key, "template_id").agg(F.sum("cnt").alias("cnt"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("less"), F.col("template_id").alias("target"))))
    of = counts.groupBy(*key).agg(F.sum("cnt").alias("total"), F.count("*").alias("kinds"), best.alias("best"))
    ranked = F.transform("best", lambda x, i: F.struct(x["target"].alias("target"), (-x["less"]).alias("cnt"), (i + 1).alias("rank")))
    return of.select(*key, "total", "kinds", ranked.alias("targets"))


def _with_ids(encoded: DataFrame, order: int) -> DataFrame:
    """``ids``: those of up to ``order`` events before an event; ``before``: how many there are in all."""

    def carried(rows: DataFrame, w: WindowSpec, earlier) -> DataFrame:
        return rows.withColumns({"before": earlier("rows"), "ids": F.collect_list("template_id").over(w.rowsBetween(-order, -1))})

    return by_node(encoded, carried, before=order, sums={"rows": F.lit(1)})


def _hashes(events: Column) -> list[Column]:
    return [F.xxhash64(events).alias("h1"), F.xxhash64(F.lit(7), events).alias("h2")]


def _dealt(histories: DataFrame) -> DataFrame:
    """Histories that have long contexts, dealt by their last events (``near``).

    The number of parts is stated: by what is shuffled, too few would seem enough.
    """
    near = histories.where(F.size("ids") >= NEAR).withColumn("near", F.xxhash64(F.slice("ids", -NEAR, NEAR)))
    return near.repartition(PARTS * int(histories.sparkSession.conf.get("spark.sql.shuffle.partitions")), "near")


def _contexts(histories: DataFrame, least: int, most: int, *columns: str) -> DataFrame:
    """The contexts of ``least`` to ``most`` events that histories end in, as lengths and hashes, each with ``columns`` of its history."""
    longest = F.least(F.size("ids"), F.lit(most))
    sizes = F.when(longest >= least, F.sequence(F.lit(least), longest)).otherwise(F.array().cast("array<int>"))
    events = F.slice("ids", F.size("ids") - F.col("size") + 1, F.col("size"))
    return histories.select("ids", *columns, F.explode(sizes).alias("size")).select(*columns, "size", *_hashes(events))


def _longest(asked: DataFrame, contexts: DataFrame, seen: Column) -> DataFrame:
    """(k1, k2, template_id, seen): what the longest of a history's contexts that is in ``contexts`` says of an event.

    Both tables lie dealt by ``near``.  A join by more columns would deal them anew, with
    all contexts of each history; a window over their union takes them as they lie.
    """
    key = ["near", "h1", "h2"]
    of = contexts.select(*key, F.struct("size", "total", "kinds", "targets").alias("of"))
    both = asked.drop("size").unionByName(of, allowMissingColumns=True).withColumn("of", F.first("of", ignorenulls=True).over(Window.partitionBy(*key)))
    met = both.where("k1 is not null and of is not null").select("k1", "k2", "template_id", "of.*").select("k1", "k2", "template_id", seen.alias("seen")).select("k1", "k2", "template_id", "seen.*")
    told = ["size", "total", "kinds", "cnt", "rank"]  # one by one: a whole struct would be aggregated by sorting
    best = met.groupBy("k1", "k2", "template_id").agg(*[F.max_by(c, "size").alias(c) for c in told])
    return best.select("k1", "k2", "template_id", F.struct(*told).alias("seen"))


def next_event_scores(
    encoded: DataFrame, counts: DataFrame, n_templates: int, *, order: int = 10, history: int = 10, top_k: int = 9, alpha: float = 1.0, wanted: Column | None = None
) -> DataFrame:
    """(row_id, node, score, flag): -log p of each event given those before it, and whether it is outside the top k.

    The longest context seen in training decides; counts are smoothed by ``alpha``.
    Events with fewer than ``history`` predecessors score 0 and aren't flagged.  Each
    history is looked up once with each event after it, however often they come; of the
    short contexts there are few, and the empty one is a single row.  ``wanted``: a
    condition on the time stamp for the events to judge; the others are context alone.
    """
    rows = _with_ids(encoded.select("row_id", "timestamp", "node", "template_id"), order)
    rows = rows if wanted is None else rows.where(wanted)
    full = F.col("before") >= history
    hit = F.get(F.filter("targets", lambda t: t["target"] == F.col("template_id")), F.lit(0))
    seen = lambda size: F.struct(size.alias("size"), "total", "kinds", hit["cnt"].alias("cnt"), hit["rank"].alias("rank"))
    short = stage(counts.where("near is null"), "short-contexts")
    one = short.where("size = 1").select("h1", "h2", "total", "kinds", "targets")
    empty = F.broadcast(short.where("size = 0").select("total", "kinds", "targets"))
    history_key = [h.alias(k) for h, k in zip(_hashes(F.col("ids")), ("k1", "k2"))]
    told = _dealt(rows.where(full).select("ids", "template_id").distinct())
    found = _longest(_contexts(told.select("*", *history_key), NEAR, order, "near", "k1", "k2", "template_id"), counts.where("near is not null"), seen(F.col("size")))
    last = F.array(F.try_element_at("ids", F.lit(-1)))
    judged = rows.select("row_id", "node", "template_id", "before", *history_key, *_hashes(last)).join(found, ["k1", "k2", "template_id"], "left")
    judged = judged.join(one, ["h1", "h2"], "left").withColumn("seen", F.coalesce("seen", F.when(F.col("total").isNotNull(), seen(F.lit(1)))))
    # rows of one id: the longest context, the last of such rows
    longest = F.when(full & F.col("row_id").isNotNull(), F.struct("seen.size", "before"))
    judged = judged.select("row_id", "node", "template_id", "before", F.max_by("seen", longest).over(Window.partitionBy("row_id")).alias("seen"))
    scored = judged.crossJoin(empty).withColumn("seen", F.coalesce("seen", seen(F.lit(0))))
    p = (F.coalesce("seen.cnt", F.lit(0)) + alpha) / (F.col("seen.total") + alpha * (n_templates + 1))
    rank = F.coalesce(F.col("seen.rank").cast("long"), F.col("seen.kinds") + 1)
    return scored.select(
        "row_id", "node", F.when(full, -F.log(p)).otherwise(F.lit(0.0)).alias("score"), F.coalesce(full & (rank > min(top_k, n_templates + 1)), F.lit(False)).alias("flag")
    )


def score_histogram(scored: DataFrame, group: str, bins: int = 20) -> DataFrame:
    """(group, bin, n): plot data of a score by group."""
    edge = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return scored.crossJoin(F.broadcast(edge)).groupBy(group, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def group_statistics(windows: DataFrame, group: str, limit: DataFrame) -> DataFrame:
    """Per group of windows: known events, share unknown, quartiles of the score, share under the threshold (the recall lost)."""
    q = lambda p: F.percentile("score", F.lit(p))
    return (
        windows.crossJoin(F.broadcast(limit)).groupBy(group)
        .agg(
            F.count("*").alias("n_windows"), F.avg("n_known").alias("mean_known"), F.avg(1 - F.col("n_known") / F.col("n_events")).alias("mean_unknown_share"),
            q(0.25).alias("score_p25"), q(0.5).alias("score_p50"), q(0.75).alias("score_p75"),
            F.avg((F.col("score") <= F.col("threshold")).cast("double")).alias("below_threshold"),
        )
    )
