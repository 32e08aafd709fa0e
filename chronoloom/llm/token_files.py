"""Token-id files of directly addressable codes, written and read by Spark.

Texts are dealt and sorted by id, encoded where they then lie and written as files of
``dac``; Spark's text writer puts the bytes down as they are (a line feed ends each
file), so any store and its commit protocol serve.  A file holds whole documents, some
``FILE_TOKENS`` tokens of them; the first token of every file in the whole is a sum of
the counts in their heads, one row a file.

A blank between two characters that aren't white space always begins a word of the
tokenizer's pattern, so texts are cut there and the ids of a piece are kept (bounded in
bytes) for when it recurs.

Cases: a null text counts as empty, an empty one has the end id alone; a null id comes
first; rows of one id come by hash of their text, then text; repeated rows give repeated
rows (all in one task, through which they stream); an empty table gives no file and no
rows; other columns aren't carried.  Memory follows a file's tokens, or those of the
longest text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols, file_bytes, packed
from .common import durable, read_table, scratch, slices
from .dac import DacFile, encode

#: Tokens of a file, about, and the id that ends a document.
FILE_TOKENS, END = 1 << 22, 2
#: Bytes of pieces and their ids that a worker keeps, about, and the longest piece kept.
MEMO_BYTES, MEMO_PIECE = 192_000_000, 64
#: White space other than blanks and line feeds, by any version of Unicode.
_OTHER = re.compile("[\t\v-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Where a blank between two characters that aren't white space begins a word.
_CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")
#: Pieces of characters beyond these go to the tokenizers library, whose classes of later ones may differ.
_PLAIN = re.compile(r"[\n -~\xa1-\u024f]*")


# The step of a tokenizer file that this module follows, and its pattern.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Pieces(dict):
    """Ids by piece, without the blank before it; those of long pieces aren't kept."""

    def __init__(self, make):
        super().__init__()
        self._make, self.used = make, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self._make(" " + piece)
        if len(piece) <= MEMO_PIECE:
            self[piece] = ids
            self.used += 150 + len(piece) + len(ids)
        return ids


class PieceEncoder:
    """Ids of texts as the tokenizers library gives them, piece by piece.

    Pieces of plain characters are encoded by tiktoken with the ranks of the same file,
    which is quicker and agrees there; all others, and those with special tokens, by the library.
    """

    def __init__(self, raw: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the machine already
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        if spec.get("normalizer") is not None or spec["pre_tokenizer"] != PRE_TOKENIZER or spec["model"]["type"] != "BPE":
            raise ValueError("the tokenizer file's normalizer, pre-tokenizer or model isn't one that is supported")
        self._tokenizer = Tokenizer.from_str(raw.decode("utf-8"))
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        special = [t["content"] for t in spec["added_tokens"]]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._has_special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        self._memo = _Pieces(self._piece)

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() or _PLAIN.fullmatch(piece)
        if plain and not self._has_special(piece):
            return packed(self._plain.encode_ordinary(piece))
        return packed(self._tokenizer.encode(piece, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, memo = [], self._memo
        if memo.used > MEMO_BYTES:
            memo.clear()
            memo.used = 0
        for t in texts:
            t = t or ""
            odd = "  " in t or " \n" in t or "\n " in t or _OTHER.search(t)
            first, *later = _CUT.split(t) if odd else t.split(" ")
            out.append(self._piece(first) + b"".join(map(memo.__getitem__, later)))
        return out


_ENCODERS: dict[int, PieceEncoder] = {}


def _encoder(raw: bytes) -> PieceEncoder:
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(raw)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, vocabulary: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END, file_tokens: int = FILE_TOKENS) -> None:
    """Write the ids of every text, each with ``end`` after it, in ascending order of id.

    One shuffle, of the texts by range of id; the ids exist only in the files.
    """
    raw = docs.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, partition, number = _encoder(raw.value), TaskContext.get().partitionId(), 0
        ids: list = []
        coded: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // 4 for p in coded])
            body = encode(np.frombuffer(b"".join(coded), "<u4"), ids, ends, partition, number)
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["file"])

        for part in (p for batch in batches for p in slices(batch, 1, rows=1024, size=2_000_000)):
            for doc_id, found in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                ids.append(doc_id)
                coded.append(found + tail)
                held += len(found) // 4 + 1
                if held >= file_tokens:
                    yield out()
                    ids, coded, held, number = [], [], 0, number + 1
        if ids:
            yield out()

    tie = F.xxhash64("text")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = slim.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _file_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(partition, number, at, doc_id, first, n_tokens, ids_crc32) of every document in the files.

    ``first`` is the document's first token within its file, ``at`` its place there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["partition", "number", "at", "doc_id", "first", "n_tokens", "ids_crc32"]
        for batch in batches:
            for k in range(batch.num_rows):
                file = DacFile(memoryview(batch.column(0)[k].as_buffer()))
                ids, ends = file.documents()
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                crcs, lo = [], 0
                while lo < len(ids):  # some documents at a time, so that the ids of a file never lie decoded together
                    hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 20), side="right")))
                    raw = memoryview(file.tokens(int(starts[lo]), int(ends[hi - 1])).astype("<u4").tobytes())
                    crcs += [zlib.crc32(raw[4 * (a - starts[lo]) : 4 * (b - starts[lo])]) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                    lo = hi
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, file.partition, np.int32)), pa.array(np.full(n, file.number, np.int32)), pa.array(np.arange(n, dtype=np.int64)), pa.array(ids, pa.int64()),
                     pa.array(starts.astype(np.int64)), pa.array((ends - starts).astype(np.int64)), pa.array(crcs, pa.int64())], names)

    return _file_rows(spark, path).mapInArrow(run, "partition int, number int, at long, doc_id long, first long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start`` to rows of :func:`read_documents`: the number of tokens before the document in all files."""
    sizes = rows.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    whole = sizes.groupBy("partition").agg(F.sum("n").alias("n"))
    frames = Window.unboundedPreceding, -1
    # a row for each task of the writer, then a row for each file of a task
    tasks = whole.select("partition", F.coalesce(F.sum("n").over(Window.orderBy("partition").rowsBetween(*frames)), F.lit(0)).alias("of_task"))
    files = sizes.select("partition", "number", F.coalesce(F.sum("n").over(Window.partitionBy("partition").orderBy("number").rowsBetween(*frames)), F.lit(0)).alias("of_file"))
    return rows.join(files.join(tasks, "partition"), ["partition", "number"]).withColumn("start", F.col("of_task") + F.col("of_file") + F.col("first")).drop("of_task", "of_file")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(partition, number, place, token) for ``places`` (partition, number, place): tokens read in place, no block decoded."""
    wanted = places.groupBy("partition", "number").agg(F.sort_array(F.collect_set("place")).alias("places"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [DacFile(memoryview(x.as_buffer())) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f.partition for f in files], pa.int32()), pa.array([f.number for f in files], pa.int32()), batch.column(0)], ["partition", "number", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                partition, number, found = (batch.column(c)[k].as_py() for c in (0, 1, 3))
                file = DacFile(memoryview(batch.column(2)[k].as_buffer()))
                found = [i for i in found if i is not None and 0 <= i < file.n_tokens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition] * len(found), pa.int32()), pa.array([number] * len(found), pa.int32()), pa.array(found, pa.int64()), pa.array([file.token(i) for i in found], pa.int64())],
                    ["partition", "number", "place", "token"])

    files = _file_rows(spark, path).mapInArrow(heads, "partition int, number int, content binary")
    return files.join(wanted, ["partition", "number"]).select("partition", "number", "content", "places").mapInArrow(run, "partition int, number int, place long, token long")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every whole document's ids with the end id, read the files back: (doc_id, start, n_tokens, ids_crc32)."""
    import public_tokenizers

    path = scratch(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    rows = durable(read_documents(spark, path), "token-documents")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
