"""Directly addressable codes and token files, against the library and plain lists."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoloom.llm import token_files
from chronoloom.llm.bpe import file_bytes
from chronoloom.llm.common import read_table, scratch
from chronoloom.llm.dac import BLOCK, DacFile, best_widths, encode, pack, unpack

from ..conftest import SF

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = "a{0} b {0}c {0} d  {0}e{0}  f {0}"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def expected(library, rows):
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, text) in their order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = ids_of(library, text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("width", [1, 3, 8, 11, 32])
@pytest.mark.parametrize("first,n", [(0, 5000), (7, 100), (4999, 1), (13, 0)])
def test_packed_values_are_read_from_any_place(width, first, n):
    values = np.random.default_rng(width).integers(0, 1 << width, 5000, np.uint64).astype(np.uint32)
    raw = pack(values, width)
    assert len(raw) == (5000 * width + 7) // 8
    assert unpack(raw[first // 8 * width :], width, first, n).tolist() == values[first : first + n].tolist()


def test_widths_cost_the_fewest_bits():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 8, 900), rng.integers(0, 1 << 14, 100)])

    def cost(widths):
        left, total, at = values, 0, 0
        for k, w in enumerate(widths):
            total += len(left) * (w + (k + 1 < len(widths)))
            at += w
            left = values[values >> at > 0]
        return total

    longest = int(values.max()).bit_length()
    ways = [w for k in range(1 << (longest - 1)) for w in [[len(x) + 1 for x in f"{k:0{longest - 1}b}".replace("1", ",").split(",")]]]
    ways = [w for w in ways if sum(w) == longest]
    assert cost(best_widths(values)) == min(map(cost, ways))


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 9000])
@pytest.mark.parametrize("top", [1, 300, 60_000, (1 << 32) - 1])
def test_tokens_are_read_in_place(n, top):
    rng = np.random.default_rng(n)
    values = (top * rng.random(n) ** 6).astype(np.uint32)
    ends = np.unique(np.concatenate([rng.integers(0, n + 1, 20), [n]]))
    ids = [None, *range(5, 5 + len(ends) - 1)]
    whole = encode(values, ids, ends, 3, 9)
    reads = []

    def read(at, size):
        reads.append(size)
        return whole[at : at + size]

    file = DacFile(read)
    assert (file.partition, file.number, file.n_tokens) == (3, 9, n)
    assert file.documents()[0] == ids and file.documents()[1].tolist() == ends.tolist()
    assert file.tokens(0, n).tolist() == values.tolist()
    reads.clear()
    for i in rng.integers(0, max(n, 1), 50 if n else 0):
        assert file.token(int(i)) == values[i]
    assert max(reads, default=0) <= BLOCK // 8  # never more than a block of a bitmap
    for a in range(0, n, 777):
        assert file.tokens(a, min(n, a + 1000)).tolist() == values[a : a + 1000].tolist()
    with pytest.raises(IndexError):
        file.token(n)


def test_a_file_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        DacFile(b"x" * 200)


def test_pieces_encode_as_the_library_does(library):
    encoder = token_files.PieceEncoder(file_bytes(VOCABULARY))
    points = [*range(0x3000), 0xFEFF, 0x1F600, 0x2000B, 0xE0020, 0x10FFFF]
    texts = [ODD.format(chr(c)) for c in points] + ["", " ", "  ", " a", "a ", "x <|endoftext|> y<|endoftext|>", "don't  can't\n\n  we'll", "a" * 500]
    got = encoder.encode([*texts, None])
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == [*want, b""]
    assert all(len(w) <= token_files.MEMO_PIECE for w in encoder._memo)


def test_query_matches_the_library(spark, library):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    got = token_files.op11_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == expected(library, rows)


def test_awkward_rows_and_small_files(spark, library):
    long = "word " * 3000
    rows = [(7, "b"), (None, "null id"), (3, None), (3, ""), (7, "b"), (-4, long), (9, " <|endoftext|>\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("n_tokens", F.lit(0)).repartition(3)
    path = scratch(spark, "files")
    token_files.write_token_files(docs, VOCABULARY, path, file_tokens=4)
    found = token_files.with_starts(token_files.read_documents(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    key = lambda r: (r[0] is not None, r[0] or 0)
    in_order = sorted(rows, key=key)  # both texts of id 3 are empty, both rows of id 7 alike
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == expected(library, in_order)
    places = spark.createDataFrame([(p, n, i) for p, n, i in token_files.read_documents(spark, path).select("partition", "number", "first").collect()], "partition int, number int, place long")
    first = {(r["partition"], r["number"], r["place"]): r["token"] for r in token_files.tokens_at(spark, path, places).collect()}
    begins = token_files.with_starts(token_files.read_documents(spark, path)).collect()
    stream = [i for r in in_order for i in ids_of(library, r[1])]
    assert first == {(r["partition"], r["number"], r["first"]): stream[r["start"]] for r in begins}


def test_empty_table(spark):
    path = scratch(spark, "files")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, path)
    assert token_files.with_starts(token_files.read_documents(spark, path)).count() == 0
