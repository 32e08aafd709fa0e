"""A recurrent next-event model: a small gated network, trained in step by a few tasks.

Examples are ``length`` events and the one that follows.  All of them are dealt by hash
into shares of about ``SHARE``, and the shares over the tasks of one barrier stage, which
keep theirs in a local file and hold one at a time.  In every round gradient steps go
through each share from the same weights; then the tasks gather each other's sums and go
on from the mean over all shares, by their examples, so all end with the same model,
which is (to rounding) the same for any number of tasks.  If one is lost the stage starts
again.  Scoring is a map over all events with the weights broadcast (their size follows
the number of templates, not of events).
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .detect import _with_ids
from .sequence import sliding_sequences

#: Examples of a share, about; a task holds one share at a time.
SHARE = 10_000
#: Bytes that the tasks tell each other in a round at most: with very many templates fewer tasks train.
TOLD = 64_000_000


class GatedNetwork:
    """Embedding, one layer of gated recurrent units (Cho et al., 2014) and a softmax over all events."""

    def __init__(self, n_events: int, embedding: int = 12, hidden: int = 24, seed: int = 0):
        rng = np.random.default_rng(seed)
        shapes = {"e": (n_events, embedding), "w": (embedding, 3 * hidden), "u": (hidden, 3 * hidden), "b": (3 * hidden,), "v": (hidden, n_events), "c": (n_events,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s)) for k, s in shapes.items()}
        self.p["e"] = rng.normal(0, 0.3, shapes["e"])
        self.hidden = hidden

    def vector(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, vector: np.ndarray) -> GatedNetwork:
        """Take weights from a row."""
        at = 0
        for k, x in self.p.items():
            self.p[k] = vector[at : at + x.size].reshape(x.shape).copy()
            at += x.size
        return self

    def _forward(self, context: np.ndarray):
        p, k = self.p, self.hidden
        h, steps = np.zeros((len(context), k)), []
        for t in range(context.shape[1]):
            x = p["e"][context[:, t]]
            a, b = x @ p["w"] + p["b"], h @ p["u"]
            z, r = 1 / (1 + np.exp(-(a[:, :k] + b[:, :k]))), 1 / (1 + np.exp(-(a[:, k : 2 * k] + b[:, k : 2 * k])))
            n = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
            steps.append((x, h, z, r, n, b[:, 2 * k :]))
            h = (1 - z) * n + z * h
        return h, steps

    def log_probabilities(self, context: np.ndarray) -> np.ndarray:
        """log p of every event after each context (rows of equally many events)."""
        y = self._forward(context)[0] @ self.p["v"] + self.p["c"]
        y -= y.max(1, keepdims=True)
        return y - np.log(np.exp(y).sum(1, keepdims=True))

    def gradient(self, context: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean -log p of the targets, and its gradient as one row."""
        p, k, rows = self.p, self.hidden, np.arange(len(target))
        h, steps = self._forward(context)
        y = h @ p["v"] + p["c"]
        y -= y.max(1, keepdims=True)
        q = np.exp(y)
        q /= q.sum(1, keepdims=True)
        loss = -np.log(q[rows, target]).mean()
        q[rows, target] -= 1
        q /= len(target)
        g = {name: np.zeros_like(x) for name, x in p.items()}
        g["v"], g["c"] = h.T @ q, q.sum(0)
        dh = q @ p["v"].T
        for t in range(context.shape[1] - 1, -1, -1):
            x, before, z, r, n, un = steps[t]
            dn = dh * (1 - z) * (1 - n * n)
            da = np.concatenate([dh * (before - n) * z * (1 - z), dn * un * r * (1 - r), dn], 1)
            db = np.concatenate([da[:, : 2 * k], dn * r], 1)
            g["w"] += x.T @ da
            g["b"] += da.sum(0)
            g["u"] += before.T @ db
            np.add.at(g["e"], context[:, t], da @ p["w"].T)
            dh = dh * z + db @ p["u"].T
        return float(loss), np.concatenate([x.ravel() for x in g.values()])


class Adam:
    """Adaptive steps (Kingma and Ba, 2015)."""

    def __init__(self, size: int, rate: float):
        self.m, self.s, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, vector: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.s = 0.999 * self.s + 0.001 * gradient**2
        return vector - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.s / (1 - 0.999**self.t)) + 1e-8)

    def state(self, vector: np.ndarray) -> np.ndarray:
        """Weights, moments and the number of steps in one row, so that means of several can be taken."""
        return np.concatenate([vector, self.m, self.s, [self.t]])

    def resume(self, state: np.ndarray) -> np.ndarray:
        """Go on from a row; its weights are returned."""
        size = len(self.m)
        self.m, self.s, self.t = state[size : 2 * size], state[2 * size : -1], state[-1]
        return state[:size]


def _slots(spark: SparkSession) -> int:
    """Tasks that can run at once as far as the session's settings tell; 2 if they don't."""
    conf = spark.sparkContext.getConf()
    each = int(conf.get("spark.task.cpus", "1"))
    if conf.contains("spark.default.parallelism"):  # which need not be the cores
        cores = int(conf.get("spark.executor.instances", "0")) * int(conf.get("spark.executor.cores", "1")) or 2 * each
    else:
        cores = spark.sparkContext.defaultParallelism
    return max(1, cores // each)


def _keep(batches: Iterator[pa.RecordBatch], file) -> list[tuple[int, int]]:
    """(share, examples) in the order in which their examples, contexts with targets, are written to ``file``."""
    sizes: dict[int, int] = {}
    for b in batches:
        target = b.column(1).to_numpy(zero_copy_only=False)
        np.column_stack([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(target), -1), target]).astype("<i4").tofile(file)
        for share, rows in groupby(b.column(2).to_pylist()):
            sizes[share] = sizes.get(share, 0) + sum(1 for _ in rows)
    return list(sizes.items())


def train(
    examples: DataFrame, n_events: int, *, workers: int | None = None, rounds: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0, share: int | None = None
) -> np.ndarray:
    """Weights of a network fitted to all ``examples`` (``row_id, context, target``), each seen once a round.

    Needs ``workers`` free task slots at once (all that the session has, unless given).
    """
    spark = examples.sparkSession
    kept = stage(examples.select("row_id", "context", "target"), "examples")
    n_examples, begun = kept.count(), GatedNetwork(n_events, seed=seed).vector()
    if not n_examples:
        return begun
    shares, size = max(2, -(-n_examples // (share or SHARE))), len(begun)
    workers = workers or max(1, min(_slots(spark), shares, TOLD // (4 * 8 * size)))
    of = F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(shares)).cast("int")
    dealt = kept.withColumn("share", of).repartitionById(workers, F.col("share") % workers).sortWithinPartitions("share", "row_id").select("context", "target", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, net, steps = BarrierTaskContext.get(), GatedNetwork(n_events, seed=seed), Adam(size, rate)
        state = steps.state(begun)
        with tempfile.TemporaryFile() as file:
            sizes = _keep(batches, file)
            width = file.tell() // max(1, sum(n for _, n in sizes))  # bytes of an example
            for k in range(rounds):
                steps.rate, total = rate * (1 - k / rounds), np.zeros(len(state) + 1)
                file.seek(0)
                for share, n in sizes:
                    some = np.frombuffer(file.read(n * width), "<i4").reshape(n, -1)
                    some = some[np.random.default_rng([seed, share, k]).permutation(n)]
                    vector = steps.resume(state)
                    for at in range(0, n, batch):
                        part = some[at : at + batch]
                        vector = steps.step(vector, net.load(vector).gradient(part[:, :-1], part[:, -1])[1])
                    total += n * np.append(steps.state(vector), 1)  # a share counts by its examples
                told = task.allGather(base64.b64encode(total.astype("<f8").tobytes()).decode())
                total = sum(np.frombuffer(base64.b64decode(x), "<f8") for x in told)
                state = total[:-1] / total[-1]
        if task.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([state[:size].astype("<f8").tobytes()], pa.binary())], ["weights"])

    return np.frombuffer(dealt.mapInArrow(run, "weights binary", barrier=True).collect()[0]["weights"], "<f8")


def fit(encoded: DataFrame, n_events: int, *, length: int = 10, **settings) -> np.ndarray:
    """Weights learned from events with ids (``template_id``, 0 for the unknown)."""
    return train(sliding_sequences(encoded, length), n_events, **settings)


def scores(encoded: DataFrame, weights: np.ndarray, n_events: int, *, length: int = 10, top_k: int = 9, wanted: Column | None = None) -> DataFrame:
    """(row_id, node, score, flag): -log p of each event given the ``length`` before it, and whether it is outside the top k.

    Events with fewer predecessors score 0 and aren't flagged, as with the back-off model.
    ``wanted``: a condition on the time stamp for the events to judge; the others are context alone.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = GatedNetwork(n_events).load(shared.value)
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            ids, target = batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
            full = np.array([len(x) == length for x in ids], bool)
            score, flag = np.zeros(len(ids)), np.zeros(len(ids), bool)
            if full.any():
                logs = net.log_probabilities(np.array([x for x, f in zip(ids, full) if f], np.int64))
                own = logs[np.arange(len(logs)), target[full]]
                score[full], flag[full] = -own, (logs > own[:, None]).sum(1) >= top_k
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array(flag)], ["row_id", "node", "score", "flag"])

    rows = _with_ids(encoded.select("row_id", "timestamp", "node", "template_id"), length)
    rows = rows if wanted is None else rows.where(wanted)
    rows = rows.select("row_id", "node", "ids", F.col("template_id").cast("long").alias("target"))
    return rows.mapInArrow(run, "row_id long, node string, score double, flag boolean")
