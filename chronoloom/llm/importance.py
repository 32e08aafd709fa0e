"""Importance resampling towards a target by a dictionary of distinct n-gram features.

Texts are numbered once into chunks of some ``CHUNK_WORDS`` words: a chunk has its
distinct words, and its documents as numbers of those.  Of each chunk the distinct
features (runs of one and two words) with their counts go, dealt into parts by a hash of
their words, to the dictionary: there every distinct string of all documents and of the
target is counted and hashed to its bucket once.  The counts of the buckets give their
gains, a table of ``BUCKETS`` rows; the buckets of a chunk's features go back to the chunk
and meet the feature counts of its documents.

Every feature is one row entry a chunk, so no word is hot; a part holds a bounded number
of entries whatever the corpus.  Ranks come from the order of (score, id) dealt by range.

Cases: a null or wordless text has no features, weight 0 and is not drawn; a null id gives
the empty string to its hash and comes first among ties; rows of one id and score tie by
their number of features and weight; repeated rows give repeated rows; an empty table gives
an empty table; an empty target has the counts 0; other columns aren't carried.  A text of
any length lies whole in one chunk.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read_table, slices

#: Hash buckets of features, percent of documents drawn, least words of a drawn one, and seed of the draw.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Words of a chunk, about, and entries of a part of the dictionary, on average.
CHUNK_WORDS, PART_ENTRIES = 1 << 20, 1 << 19

_SMALL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CODEC = "zstd"
_CHUNK = "chunk long, target boolean, doc_id array<long>, sizes binary, n_vocabulary int, vocabulary binary, vocabulary_size int, words binary, entries long"
_CHUNK_NAMES = [f.split()[0] for f in _CHUNK.split(", ")]
_BLOCK = "chunk long, part int, target boolean, n int, names binary, names_size int, counts binary"
_BLOCK_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other than ASCII characters, A-Z made small."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SMALL).split()


def _squeezed(raw: bytes) -> bytes:
    return pa.compress(raw, _CODEC, asbytes=True)


def _whole(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, size, _CODEC, asbytes=True)


class Features:
    """A chunk's distinct features, in an order that follows from its words alone."""

    def __init__(self, vocabulary: list[bytes], words: np.ndarray, sizes: np.ndarray):
        self.vocabulary, self.words, self.sizes = vocabulary, words, sizes
        v = len(vocabulary)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        inside = self.doc[1:] == self.doc[:-1]
        self.pair_doc = self.doc[1:][inside]
        pairs = (words[:-1] * v + words[1:])[inside]
        self.pairs, self.pair_of, self.pair_counts = np.unique(pairs, return_inverse=True, return_counts=True)
        self.counts = np.concatenate([np.bincount(words, minlength=v), self.pair_counts])

    def parts(self, n: int) -> np.ndarray:
        """The part of the dictionary for each feature: single words, then pairs."""
        h = np.fromiter(map(zlib.crc32, self.vocabulary), np.uint64, len(self.vocabulary))
        a, b = (self.pairs // max(len(self.vocabulary), 1), self.pairs % max(len(self.vocabulary), 1)) if len(self.pairs) else (self.pairs, self.pairs)
        mixed = np.concatenate([h, h[a] * np.uint64(0x9E3779B97F4A7C15) + (h[b] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)])
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)

    def names(self, at: np.ndarray) -> list[bytes]:
        """The strings of some features."""
        v, w = len(self.vocabulary), self.vocabulary
        single, pairs = at[at < v], self.pairs[at[at >= v] - v]
        return [w[i] for i in single.tolist()] + [w[a] + b" " + w[b] for a, b in zip((pairs // v).tolist(), (pairs % v).tolist())]

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Each document's sum of the gains of its features, repeats included."""
        v, n = len(self.vocabulary), len(self.sizes)
        total = lambda doc, g: np.bincount(doc, g, n).astype(np.int64)  # noqa: E731  exact: sums of integers below 2 ** 53
        return total(self.doc, gains[:v][self.words]) + total(self.pair_doc, gains[v:][self.pair_of])


def chunks(docs: DataFrame, target: bool, *, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The texts of ``docs`` as numbered words, a row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, ids, sizes, flat, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        number: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            stream = np.concatenate(flat)
            names = sorted(number)
            place = np.empty(len(names), np.int64)
            place[[number[w] for w in names]] = np.arange(len(names))
            stream, text = place[stream].astype("<u4"), b" ".join(names)
            raw = np.ascontiguousarray(stream.view(np.uint8).reshape(-1, 4).T).tobytes()  # bytes of one significance together
            values = [k, target, ids, np.array(sizes, "<u4").tobytes(), len(names), _squeezed(text), len(text), _squeezed(raw), len(names) + len(stream)]
            kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(values, kinds)], _CHUNK_NAMES)

        for part in (p for batch in batches for p in slices(batch, 1)):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = words_of(text)
                ids.append(doc_id)
                sizes.append(len(words))
                flat.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
                held += len(words) + 8
                if held >= chunk_words:
                    yield out()
                    k, ids, sizes, flat, held, number = k + 1, [], [], [], 0, {}
        if ids:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _CHUNK)


def _features(row: dict) -> Features:
    vocabulary = _whole(row["vocabulary"], row["vocabulary_size"]).split(b" ") if row["n_vocabulary"] else []
    sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
    n = int(sizes.sum())
    words = np.frombuffer(_whole(row["words"], 4 * n), np.uint8).reshape(4, n).T if n else np.zeros((0, 4), np.uint8)
    return Features(vocabulary, np.ascontiguousarray(words).view("<u4").reshape(-1).astype(np.int64), sizes)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, so that only one is Python objects at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def blocks(numbered: DataFrame, parts: int) -> DataFrame:
    """A row for each chunk and part of the dictionary: the chunk's features of that part, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = _features(row)
            part = found.parts(parts)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts), side="right")
            columns: list[list] = [[] for _ in range(5)]
            for p in np.unique(part).tolist():
                at = order[ends[p - 1] if p else 0 : ends[p]]
                names = b"\n".join(found.names(at))
                for c, x in zip(columns, (p, len(at), _squeezed(names), len(names), _squeezed(found.counts[at].astype("<u4").tobytes()))):
                    c.append(x)
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["chunk"])), pa.array(columns[0], pa.int32()), pa.array([row["target"]] * n, pa.bool_()), pa.array(columns[1], pa.int32()),
                 pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())], _BLOCK_NAMES)

    return numbered.mapInArrow(run, _BLOCK)


def dictionary(met: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(chunk, part, buckets, s, t): of blocks dealt by part, the bucket of each feature of a documents' block.

    A distinct string is counted and hashed once.  A row without a chunk has a task's
    counts by bucket, of documents (s) and target (t).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        kinds = pa.uint16() if buckets <= 1 << 16 else pa.uint32()
        names = ["chunk", "part", "buckets", "s", "t"]
        held: list[tuple] = []
        place: dict[bytes, int] = {}
        counts, last = [np.zeros(0, np.int64)] * 2, None

        def finished() -> Iterator[pa.RecordBatch]:
            bucket = np.fromiter((zlib.crc32(f) % buckets for f in place), np.int64, len(place))
            for side in (0, 1):
                np.add.at(sums[side], bucket[: len(counts[side])], counts[side])
            for chunk, part, at in held:
                raw = bucket[at].astype(kinds.to_pandas_dtype()).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part], pa.int32()), pa.array([raw], pa.binary()), *[pa.nulls(1, pa.list_(pa.int64()))] * 2], names)

        for row in _rows(batches):
            if place and last != row["part"]:
                yield from finished()
                held, place, counts = [], {}, [np.zeros(0, np.int64)] * 2
            last, side = row["part"], int(row["target"])
            features = _whole(row["names"], row["names_size"]).split(b"\n")
            at = np.fromiter((place.setdefault(f, len(place)) for f in features), np.int32, len(features))
            grown = np.zeros(len(place), np.int64)
            grown[: len(counts[side])] = counts[side]
            grown[at] += np.frombuffer(_whole(row["counts"], 4 * len(at)), "<u4").astype(np.int64)  # a feature is in a block once
            counts[side] = grown
            if not side:
                held.append((row["chunk"], last, at))
        if place:
            yield from finished()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([sums[0]], pa.list_(pa.int64())), pa.array([sums[1]], pa.list_(pa.int64()))], names)

    return met.mapInArrow(run, "chunk long, part int, buckets binary, s array<long>, t array<long>")


def gains_of(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), a bounded table."""
    rows = counted.where("chunk is null").select(F.posexplode(F.arrays_zip("s", "t"))).groupBy("pos").agg(F.sum("col.s").alias("s"), F.sum("col.t").alias("t")).toPandas()
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[rows["pos"]], t[rows["pos"]] = rows["s"], rows["t"]
    of, to = s.sum() + buckets, t.sum() + buckets
    return np.array([math.floor(1000 * math.log((y + 1) * of / ((x + 1) * to))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def document_weights(numbered: DataFrame, counted: DataFrame, gains: np.ndarray, parts: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the buckets of a chunk's features, joined back to its documents."""
    shared = numbered.sparkSession.sparkContext.broadcast(gains)
    kind = np.uint16 if len(gains) <= 1 << 16 else np.uint32
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, back = None, {}

        def out() -> pa.RecordBatch:
            found = _features(row)
            part = found.parts(parts)
            order = np.argsort(part, kind="stable")
            bucket = np.empty(len(part), np.int64)
            if len(order):  # parts ascend in the order of features
                bucket[order] = np.concatenate([np.frombuffer(back[p], kind) for p in sorted(back)])
            n = found.sizes
            features = np.where(n > 0, 2 * n - 1, 0)
            weight = np.floor_divide(found.sums(shared.value[bucket]), np.maximum(features, 1))
            return pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(n), pa.array(features), pa.array(weight)], names)

        for x in _rows(batches):
            if x["part"] is None:
                if row is not None:
                    yield out()
                row, back = x, {}
            else:
                back[x["part"]] = x["buckets"]
        if row is not None:
            yield out()

    whole = numbered.where("not target").withColumns({"part": F.lit(None).cast("int"), "buckets": F.lit(None).cast("binary")})
    both = whole.unionByName(counted.where("chunk is not null").select("chunk", "part", "buckets"), allowMissingColumns=True)
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_first("part"))
    return dealt.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h the first 8 hex digits of sha256("seed:id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``place``, from 1 in ``order``: dealt by range, numbered within a task after the counts of those before."""
    dealt = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranks")
    task = F.shiftrightunsigned("at", 33).alias("task")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = dealt.groupBy(task).agg(F.count("*").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return dealt.withColumn("task", task).join(offsets, "task").withColumn("place", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("task", "offset", "at")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, chunk_words: int = CHUNK_WORDS, part_entries: int = PART_ENTRIES) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` is null where it wasn't drawn."""
    numbered = durable(chunks(docs, False, chunk_words=chunk_words).unionByName(chunks(target, True, chunk_words=chunk_words)), "chunks")
    parts = max(1, (numbered.agg(F.sum("entries")).first()[0] or 0) // part_entries)
    dealt = blocks(numbered, parts).repartition("part").sortWithinPartitions("part")
    counted = durable(dictionary(dealt, buckets), "dictionary")
    weights = document_weights(numbered, counted, gains_of(counted, buckets), parts)
    scored = durable(weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = ranks(scored.where(able), order).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    return placed.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents drawn by their likeness to the benchmark's texts."""
    target = read_table(spark, sf_dir, "benchmark").select(F.lit(None).cast("long").alias("doc_id"), "text")
    return resample(read_table(spark, sf_dir, "documents"), target)
