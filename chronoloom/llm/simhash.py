"""Near-duplicates by SimHash, found through Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments.  Two that differ in at most
two bits agree exactly in some segment, and in the segment after it (cyclically)
they differ in at most two bits.  That next segment is decoded, with each of its
one-bit neighbours, to the nearest codeword of the perfect (23,12) Golay code:
vectors within two bits of each other share one of these few codeword indices.
Each fingerprint therefore joins under a handful of keys (exact segment, codeword
index), and candidates are verified by counting differing bits.

Equal fingerprints are one node, so copies are never paired.  A key with more
than ``BUCKET`` fingerprints isn't paired either: its fingerprints meet at their
one-bit neighbours instead, where at most 65 can meet and all that do are within
two bits, which is exact and linear in their number.

Cases: a null or word-less text has fingerprint zero and is linked like any
other; a null doc_id takes part and gets its group's component; repeated rows give
repeated rows; an empty table gives an empty table; other columns are not
carried, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read_table
from .components import connected_components

#: Words in a shingle, seed of its hash, and bits in which linked fingerprints may differ.
SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Fingerprints under one key that are compared pair by pair.
BUCKET = 16
#: Generator polynomial of the (23,12) Golay code.
GOLAY = 0b101011100011


def fingerprint(text: str | None) -> int:
    """SimHash of a text: majority bits over the hashes of its shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(SHINGLE, len(words))
    starts, ends = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    line, h, total, n = b" ".join(words), xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        total += bit_counts(np.array([h(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], np.uint64))
    return majority(total, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of some 64-bit hashes have each bit set, the highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)


def majority(total: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes from their bit counts."""
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def row_key() -> Column:
    """Hash of id and text, by which rows can be met again."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text", F.col("text").isNull())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp) of every row; ``fp`` is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], ["doc_id", "row_key", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    return slim.mapInArrow(run, "doc_id long, row_key long, fp long")


def golay_table() -> np.ndarray:
    """Error pattern of at most three bits for each of the 2048 remainders."""
    single = [1 << i for i in range(23)]
    errors = np.array(
        [0, *single, *(a | b for i, a in enumerate(single) for b in single[:i]),
         *(a | b | c for i, a in enumerate(single) for j, b in enumerate(single[:i]) for c in single[:j])], np.int64
    )
    table = np.zeros(2048, np.int64)
    table[_remainder(errors)] = errors
    return table


def _remainder(v: np.ndarray) -> np.ndarray:
    r = v.copy()
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


def codeword_indices(v: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Codeword index (12 bits) of each vector and of its 23 one-bit neighbours."""
    near = v[:, None] ^ np.array([0, *(1 << i for i in range(23))], np.int64)
    return (near ^ table[_remainder(near)]) >> 11


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """(fp, key): the keys of every fingerprint, sixteen or so each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = golay_table()
        for batch in batches:
            signed = batch.column(0).to_numpy()
            fp = signed.view(np.uint64)
            segment = [(fp >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in ((43, 21), (22, 21), (0, 22))]
            rows, keys = [], []
            for i in range(3):
                index = np.sort(codeword_indices(segment[(i + 1) % 3], table), 1)
                new = np.concatenate([np.ones((len(fp), 1), bool), index[:, 1:] != index[:, :-1]], 1)
                row, col = np.nonzero(new)
                rows.append(signed[row])
                keys.append(i << 34 | segment[i][row] << 12 | index[row, col])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(keys))], ["fp", "key"])

    return prints.select("fp").mapInArrow(run, "fp long, key long")


def links(prints: DataFrame, *, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within two bits of each other.

    With a larger ``distance`` those that meet under a key of at most ``bucket`` are
    edges up to it, too: for callers that verify edges by other means.
    """
    keyed = fuzzy_keys(prints)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key")
    close = lambda x, y: (x < y) & (F.bit_count(x.bitwiseXOR(y)) <= distance)
    pairs = (
        shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
        .select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda y: close(F.col("a"), y))).alias("b"))
    )
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    stars = (
        shared.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(flips).alias("between"))
        .groupBy("between").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
        .select(F.get("fps", F.lit(0)).alias("a"), F.explode(F.slice("fps", F.lit(2), F.size("fps"))).alias("b"))
    )
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp, label, component_id) of every row of ``docs`` (``doc_id, text``).

    ``label`` names the group, ``component_id`` is its smallest doc_id.
    """
    rows = durable(fingerprints(docs), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(links(prints)).withColumnRenamed("node", "fp")
    grouped = prints.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.join(grouped.join(smallest, "label").select("fp", "label", "component_id"), "fp").select("doc_id", "row_key", "fp", "label", "component_id")


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest doc_id, with all its columns.

    A row is told by its id and the hash of id and text together.
    """
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    kept = groups(docs).groupBy("label").agg(F.min(ranked).alias("least")).select(F.coalesce("least.doc_id", F.lit(0)).alias("\x00id"), F.col("least.row_key").alias("\x00key"))
    named = docs.withColumns({"\x00id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "\x00key": row_key()})
    return named.join(kept, ["\x00id", "\x00key"], "left_semi").dropDuplicates(["\x00id", "\x00key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
