"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams.

Features are the presence of words, word pairs and pairs that skip one word,
hashed to ``2**BITS`` places.  Per-coordinate rates and L1 sparsity leave few
weights, which are broadcast as two short sorted arrays.

Fitting reads a bounded sample of labelled rows (``TRAIN_DOCS``, picked by a
hash of id and text, identical ones once); scoring reads every row, whole, and only its text.

Cases: a null or empty text has no features and gets the bias alone; rows
without a label are scored but not learned from; several labels of one document
are each learned from; with nothing to learn from every score is 0.5 less a
hair (predicted 0); repeated rows give repeated rows; other columns are not
carried, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .langid import held_out

#: Labelled rows that are learned from at most.
TRAIN_DOCS = 10_000
#: Hash places: 2 to this power.
BITS = 22
#: Bytes of pieces and their hashes that a worker keeps, about, and the longest piece kept.
_MEMO_BYTES, _MEMO_PIECE = 96_000_000, 64
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Hashes of pieces of text, made on first use; those of long pieces aren't kept, so memory is bounded in bytes."""

    def __init__(self):
        super().__init__()
        self.used = 0

    def __missing__(self, piece: str) -> int:
        word = piece.lower().strip("#*$%&|<>.,;:!?\"'()[]{}-_=+/\\~`@^")
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        if len(piece) <= _MEMO_PIECE:
            self[piece] = found
            self.used += 150 + len(piece)
        return found


class Featurizer:
    """Texts to sorted, distinct feature places; word hashes are kept in a bounded table."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self._hash = _Hashes()

    def words(self, text: str | None) -> np.ndarray:
        """64-bit hashes of the words of a text."""
        pieces = (text or "").split()
        if self._hash.used > _MEMO_BYTES:
            self._hash = _Hashes()
        return np.fromiter(map(self._hash.__getitem__, pieces), np.uint64, len(pieces))

    def places(self, text: str | None) -> np.ndarray:
        """Places of all features of a text, repeats included."""
        w = self.words(text)
        pairs = (w[:-1] * _PAIR) ^ w[1:]
        skips = (w[:-2] * _SKIP) ^ w[2:]
        return (np.concatenate([w, pairs * _SKIP, skips * _PAIR]) * _PAIR) >> self.shift


@dataclass
class Weights:
    """What is left of a fit: sorted places with non-zero weights, and the bias."""

    places: np.ndarray
    values: np.ndarray
    bias: float

    def margin(self, features: np.ndarray) -> float:
        """Sum of the weights of the distinct features present, plus the bias."""
        if not len(self.places):
            return self.bias
        at = np.minimum(np.searchsorted(self.places, features), len(self.places) - 1)
        present = np.unique(at[self.places[at] == features])
        return float(self.values[present].sum()) + self.bias


def ftrl(examples: list[np.ndarray], labels: np.ndarray, *, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5, passes: int = 6, positive: float = 1.0) -> Weights:
    """FTRL-proximal (McMahan et al., 2013) over distinct feature places.

    ``positive`` multiplies the gradients of examples with label 1.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bz = bn = 0.0
    order = np.random.default_rng(0)

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(passes):
        for i in order.permutation(len(examples)):
            x = examples[i]
            w, b = weight(z[x], n[x], l1), float(weight(np.array(bz), np.array(bn), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - labels[i]
            g *= positive if labels[i] else 1.0
            step = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - step * w
            n[x] += g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * b
            bn += g * g
    kept = np.flatnonzero(np.abs(z) > l1)
    return Weights(kept.astype(np.uint64), weight(z[kept], n[kept], l1), float(weight(np.array(bz), np.array(bn), 0.0)))


def fit(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS, bits: int = BITS) -> Weights:
    """Fit on about ``train_docs`` of the labelled rows: features are made on the
    cluster, and those of the sample alone reach the driver."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known.distinct(), "doc_id")
    total = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).join(known.distinct(), "doc_id").count()
    if not total:
        return Weights(np.zeros(0, np.uint64), np.zeros(0), -1e-9)
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("toxicity sample")), F.lit(1_000_000))
    picked = met.withColumn("place", place).where(F.col("place") < 1_200_000 * train_docs / total).distinct()
    sample = picked.orderBy("place", "doc_id", "toxic").limit(train_docs).select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(bits)
        for batch in batches:
            x = [np.unique(featurizer.places(t)).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["doc_id", "toxic", "x"])

    rows = sample.mapInArrow(run, "doc_id long, toxic int, x binary").collect()
    if not rows:
        return Weights(np.zeros(0, np.uint64), np.zeros(0), -1e-9)
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], bytes(r["x"])))  # whatever order tasks end in
    return ftrl([np.frombuffer(bytes(r["x"]), "<u4") for r in rows], np.array([float(r["toxic"] > 0) for r in rows]), bits=bits)


def toxicity_scores(docs: DataFrame, weights: Weights, *, bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row: one narrow map with the weights broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer, w = Featurizer(bits), shared.value
        for batch in batches:
            margin = np.array([w.margin(featurizer.places(t)) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from labels of rows not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    weights = fit(docs.where(~out), labels.where(~out))
    return toxicity_scores(docs, weights).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
