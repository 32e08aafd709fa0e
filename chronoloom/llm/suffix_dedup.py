"""Removal of long repeated byte strings by distributed prefix doubling.

Whether ``LENGTH`` bytes recur is decided by naming substrings of growing extent
and sorting (rank, place) rows on Spark: places whose name is unique at one
extent drop out, those that recur are ranked again at the next, until they are
unique or past the threshold.  Ranks are 64-bit substring hashes rather than
dense integers, as only equality matters, and two changes keep 100 TB feasible:

* Only anchors (about 1 byte in 65, picked by content, see ``anchors``) are
  ranked.  Every window of ``LENGTH`` bytes belongs to one anchor, and equal
  windows to equal anchors at equal offsets, so none is missed.
* Extents that recur whole settle all their windows at once.  Extents that don't,
  while their common core does, are cut into pieces of 16 windows and then into
  single windows and ranked again.

Each round is: count (core, block) with a combine before the shuffle; blocks
counted twice or more mark their windows; cores with several different blocks go
on with one representative a block.  A text or passage that a third of the corpus
shares is thus one row a task in every count.  Where rows meet the counts again,
those of a name with over one in ``HOT`` of all rows (so ``HOT`` names at most) are
dealt over ``SALTS`` tasks.

:func:`by_prefix_doubling` is the method in its plain form, every byte position
ranked; it gives the same windows and is kept to compare with (see the README for
what it costs).

Cases: a null or empty text has no bytes, no spans and the digest of nothing; a
text under ``LENGTH`` bytes keeps all; repeated rows are copies of each other, so
long ones lose all bytes; a null doc_id is carried through; an empty table gives
an empty table; other columns are not carried, so their names can't clash.
Matches never cross documents.  Long texts are hashed in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import CHUNK, CORE, LENGTH, Rolled, anchor_runs
from .common import durable, forget, read_table

#: Windows in a piece, round by round, after whole blocks.
PIECES = (16, 1)
#: Names with more than this part of all rows are dealt over so many tasks.
HOT, SALTS = 1000, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A text is told by its id and the hash of its bytes.
_TEXT = ["doc", "key"]
_ROW = "core long, block long, doc long, key long, anchor int, first int, last int"
_NAMES = ["core", "block", "doc", "key", "anchor", "first", "last"]


def _mixed(block: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return block ^ (offset.astype(np.uint64) * _MIX)


def _stretches(keys: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, key, offset) of texts put together up to ``CHUNK`` bytes.

    A longer text is cut into stretches that overlap by ``LENGTH - 1`` bytes, so
    that every window lies in exactly one.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        return data, np.cumsum([len(p[2]) for p in parts]), np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)

    for key, text in zip(keys, texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            piece = text[at : at + CHUNK + LENGTH - 1]
            if parts and size + len(piece) > CHUNK:
                yield out()
                parts, size = [], 0
            parts.append((key, at, piece))
            size += len(piece)
    if parts:
        yield out()


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with id and hash of their text: rows equal in both share a fate."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text")
    )


def anchor_rows(keyed: DataFrame, *, cores_only: bool) -> DataFrame:
    """The anchors of all texts: only their cores, or with their blocks and places.

    ``first`` to ``last`` are the windows of an anchor, by their starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, row, offset in _stretches(range(batch.num_rows), batch.column(2).to_pylist()):
                rolled, anchor, first, last = anchor_runs(data, ends)
                core = pa.array(rolled.of(anchor, CORE).view(np.int64))
                if cores_only:
                    yield pa.RecordBatch.from_arrays([core], ["core"])
                    continue
                block = _mixed(rolled.of(first, last - first + LENGTH), anchor - first)
                text = np.searchsorted(ends, first, side="right")
                shift = offset[text] - np.concatenate([[0], ends[:-1]])[text]
                places = [pa.array((x + shift).astype(np.int32)) for x in (anchor, first, last)]
                at = pa.array(row[text])
                yield pa.RecordBatch.from_arrays([core, pa.array(block.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), *places], _NAMES)

    return keyed.select(*_TEXT, "text").mapInArrow(run, "core long" if cores_only else _ROW)


def piece_rows(blocks: DataFrame, size: int) -> DataFrame:
    """Rows of the pieces of ``size`` windows of ``blocks`` (doc, key, anchor, first, last, start, data).

    Pieces begin at multiples of ``size`` bytes before the anchor.  A piece's core
    are the bytes that all windows of a whole such piece share; they lie within
    the data of a partial one too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(6).to_pylist()
            if not data:
                continue
            anchor, first, last, start = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4, 5))
            rolled = Rolled(np.frombuffer(b"".join(data), np.uint8))
            base = np.cumsum([len(d) for d in data]) - [len(d) for d in data] - start
            low, high = (anchor - last) // size, (anchor - first) // size
            row = np.repeat(np.arange(len(data)), high - low + 1)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
            a = anchor[row]
            p0, p1 = np.maximum(first[row], a - (piece * size + size - 1)), np.minimum(last[row], a - piece * size)
            core = _mixed(rolled.of(base[row] + a - piece * size, LENGTH - size + 1), piece)
            block = _mixed(rolled.of(base[row] + p0, p1 - p0 + LENGTH), a - p0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(core.view(np.int64)), pa.array(block.view(np.int64)), *[batch.column(i).take(pa.array(row)) for i in (0, 1)],
                    *[pa.array(x.astype(np.int32)) for x in (a, p0, p1)],
                ],
                _NAMES,
            )

    return blocks.select(*_TEXT, "anchor", "first", "last", "start", "data").mapInArrow(run, _ROW)


def _of(rows: DataFrame, wanted: DataFrame, name: str, count: str) -> DataFrame:
    """The rows whose ``name`` is in ``wanted`` (``name, count``: each name once), hot names dealt over many tasks.

    A name is hot if its count is over one in ``HOT`` of the sum, so ``HOT`` bounds
    how many the driver sees.
    """
    total = wanted.agg(F.sum(count)).first()[0] or 0
    hot = [r[0] for r in wanted.where(F.col(count) > max(total // HOT, SALTS)).select(name).collect()]
    if not hot:
        return rows.join(wanted.select(name), name, "left_semi")
    is_hot, salts = F.col(name).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))
    dealt = wanted.select(name, F.explode(F.when(is_hot, salts).otherwise(F.array(F.lit(0)))).alias("salt"))
    salted = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    return salted.join(dealt, [name, "salt"], "left_semi").drop("salt")


def _round(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marked windows, blocks to cut further, the written table behind both) of one round's rows."""
    block = rows.groupBy("core", "block").agg(F.count("*").alias("n"), F.min(F.struct(*_TEXT, "anchor", "first", "last")).alias("at"))
    block = durable(block.withColumn("name", F.xxhash64("core", "block")), "blocks")
    named = rows.withColumn("name", F.xxhash64("core", "block"))
    marked = _of(named, block.where("n > 1").select("name", "n"), "name", "n").select(*_TEXT, "first", "last")
    several = block.groupBy("core").agg(F.count("*").alias("blocks")).where("blocks > 1")
    return marked, _of(block.select("core", "at"), several, "core", "blocks").select("at.*"), block


def repeated_windows(keyed: DataFrame) -> DataFrame:
    """(doc, key, first, last): runs of starts of windows that also start elsewhere."""
    again = durable(anchor_rows(keyed, cores_only=True).groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), "cores")
    rows = durable(_of(anchor_rows(keyed, cores_only=False), again, "core", "n"), "anchors")
    marked, open_blocks, counted = _round(rows)
    found = durable(marked, "windows")
    blocks = durable(_with_data(keyed, open_blocks), "block-data")
    for used in (again, rows, counted):
        forget(used)
    for size in PIECES:
        rows = durable(piece_rows(blocks, size), "pieces") if size > 1 else piece_rows(blocks, size)
        marked, open_blocks, counted = _round(rows)
        found = found.unionByName(durable(marked, "windows"))
        if size > 1:
            place = [*_TEXT, "anchor"]
            inside = (F.col("first") >= F.col("start")) & (F.col("last") <= F.col("start") + F.octet_length("data") - LENGTH)
            following = durable(open_blocks.join(blocks.select(*place, "start", "data"), place).where(inside), "block-data")
            forget(rows)
        forget(counted)
        forget(blocks)
        if size > 1:
            blocks = following
    return found


def _with_data(keyed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks with their bytes: the blocks of a text meet it as one row, so it isn't multiplied."""
    of_text = blocks.groupBy(*_TEXT).agg(F.collect_list(F.struct("anchor", "first", "last")).alias("blocks"))
    texts = keyed.select(*_TEXT, "text").join(of_text, _TEXT)
    cut = F.substring(F.col("text"), F.col("b.first") + 1, F.col("b.last") - F.col("b.first") + LENGTH)
    return (
        texts.select(*_TEXT, "text", F.explode("blocks").alias("b"))
        .select(*_TEXT, "b.anchor", "b.first", "b.last", F.col("b.first").alias("start"), cut.alias("data"))
        .dropDuplicates([*_TEXT, "anchor", "first"])
    )


def by_prefix_doubling(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, key, place): starts of strings of ``length`` bytes that also start elsewhere, by ranks of every position.

    Ranks of ``k`` bytes come from sorted pairs of the ranks of ``k / 2`` bytes at a
    place and ``k / 2`` further on; places whose rank is unique drop out of the
    pairs' left side, and the last pair overlaps so as to reach ``length``.  Rows
    are (text, place, rank) throughout: some 30 bytes a byte of text in every
    one of eight shuffles, which is why :func:`repeated_windows` ranks anchors.
    """
    keyed = _keyed(docs).withColumn("copy", F.monotonically_increasing_id())
    rows = durable(
        keyed.where(F.octet_length("text") >= length)
        .select(*_TEXT, "copy", F.posexplode(F.split(F.hex("text"), "(?<=\\G..)")).alias("place", "byte")).where("byte <> ''")
        .select(*_TEXT, "copy", "place", F.conv("byte", 16, 10).cast("long").alias("rank")),
        "ranks",
    )
    k = 1
    while k < length:
        step = min(k, length - k)
        ahead = rows.select(*_TEXT, "copy", (F.col("place") - step).alias("place"), F.col("rank").alias("second"))
        pairs = rows.join(ahead, [*_TEXT, "copy", "place"])
        # a rank is the smallest place that has the pair: dense numbers would need one more sort
        first = F.min(F.struct("copy", "place")).alias("first")
        ranks = pairs.groupBy("rank", "second").agg(F.count("*").alias("n"), first).where("n > 1")
        ranked = pairs.join(ranks, ["rank", "second"])
        after = durable(ranked.select(*_TEXT, "copy", "place", F.xxhash64("first.copy", "first.place").alias("rank")), "ranks")
        forget(rows)
        rows, k = after, k + step
    return rows.select(*_TEXT, "place").distinct()


def remove_repeats(docs: DataFrame, *, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    ``kept`` are the bytes that remain, which may cut a character in two.
    """
    keyed = _keyed(docs)
    spans = repeated_windows(keyed).groupBy(*_TEXT).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    met = keyed.join(spans, _TEXT, "left").select("doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names[1:]]
            for text, first, last in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                data, n_removed, n_spans = text, 0, 0
                if first.is_valid and len(first):
                    f, e = first.values.to_numpy(), last.values.to_numpy() + LENGTH
                    step = np.bincount(f, minlength=len(text) + 1) - np.bincount(e, minlength=len(text) + 1)
                    gone = np.cumsum(step[:-1]) > 0
                    n_removed = int(gone.sum())
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    data = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (len(text), n_removed, n_spans, hashlib.sha256(data).hexdigest(), data)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return met.mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings taken out of every whole document."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))
