"""Byte-pair encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that no vocabulary token holds side by side can never be
merged, so a word is cut there, each fragment is encoded by itself (fragments
recur far more often than words) and the ids are concatenated.

Cases: a null text is treated as empty (no ids, empty decoded text); special
tokens' strings inside a text become their ids, as the library does by default;
repeated rows give repeated rows; an empty table gives an empty table; other
columns are kept by :func:`encode`/:func:`decode` unless they bear the name of
the new column, which is then replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Codec, default_vocabulary, file_bytes, on_worker
from .common import read_table, slices


def _with_column(df: DataFrame, source: str, name: str, kind: T.DataType, arrow: pa.DataType, make, raw) -> DataFrame:
    """Add or replace one column by a function of another, batch by batch."""
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind)])
    read = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias("\x00source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = on_worker(Codec, raw.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                new = pa.array([make(codec, v) for v in part.column(len(kept)).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], new], [*kept, name])

    return read.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the ids of ``text_col`` as an array of integers."""
    raw = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    return _with_column(
        df, text_col, ids_col, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()),
        lambda codec, text: np.frombuffer(codec.encode(text), "<u4").astype(np.int32), raw,
    )


def decode(df: DataFrame, vocabulary: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of ``ids_col``; null ids give an empty text."""
    raw = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    return _with_column(
        df, ids_col, text_col, T.StringType(), pa.string(),
        lambda codec, ids: codec.decode([] if ids is None else ids), raw,
    )


def codec_digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): a round trip in one narrow map.

    The digests are made where the ids are, so neither ids nor decoded texts
    leave the worker.
    """
    raw = docs.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = on_worker(Codec, raw.value)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                packed = codec.encode(text)
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                back = codec.decode(np.frombuffer(packed, "<u4").tolist())
                text_sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ids in place of their text, their number and the digest of the text they decode to.

    One narrow map, a few texts at a time: ids are arrays of four bytes each,
    never Python lists of a whole batch.
    """
    raw = docs.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded_sha256")]
    names = [*kept, "n_tokens", "ids", "decoded_sha256"]
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = on_worker(Codec, raw.value)
        for part in (p for batch in batches for p in slices(batch, len(kept), rows=64)):
            packed = [codec.encode(t) for t in part.column(len(kept)).to_pylist()]
            digests = [hashlib.sha256(codec.decode(np.frombuffer(x, "<u4").tolist()).encode("utf-8")).hexdigest() for x in packed]
            size = np.array([len(x) // 4 for x in packed], np.int64)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(size), ids, pa.array(digests, pa.string())], names)

    read = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias("\x00text"))
    return read.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + new))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole document with the public word-level vocabulary."""
    return codec_digests(read_table(spark, sf_dir, "documents"), default_vocabulary())
