"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import importance
from chronoloom.llm.common import read_table

from ..conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features_of(text):
    w = WORD.findall((text or "").translate(SMALL))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target, percent=25, least=20, buckets=10_000, seed=7):
    """{(doc_id, n_features, weight, score, rank)} straight from the formula."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    every = [(i, *features_of(t)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in every for f in fs)
    t = Counter(bucket(f) for x in target for f in features_of(x)[1])
    of, to = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (of + buckets) / ((s[b] + 1) * (to + buckets)))) for b in s}
    rows = []
    for i, n, fs in every:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in rows), key=repr)


def test_query_matches_plain_version(spark):
    docs = [tuple(r) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in read_table(spark, SF, "benchmark").select("text").collect()]
    got = importance.op12_importance_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target)


@pytest.mark.parametrize("chunk_words,part_entries,buckets", [(1, 1, 97), (40, 60, 10_000), (1 << 20, 1 << 19, 70_000)])
def test_chunks_and_parts_of_any_size(spark, chunk_words, part_entries, buckets):
    rng = np.random.default_rng(3)
    words = ["The", "été", "don't", "x1", "naïve", "of", "日本", "a", "b", "c"]
    docs = [(k, " ".join(rng.choice(words, rng.integers(0, 60)))) for k in range(60)] + [(100, ""), (101, None), (102, "--"), (103, "one"), (104, "a b " * 3000)]
    target = ["the of the of", "日本 x1", "", None]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("chunk", F.lit(1)).repartition(3)
    t = spark.createDataFrame([(None, x) for x in target], "doc_id long, text string")
    got = importance.resample(d, t, chunk_words=chunk_words, part_entries=part_entries, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, buckets=buckets)


def test_each_distinct_string_is_in_the_dictionary_once(spark):
    docs = spark.createDataFrame([(k, "alpha beta alpha") for k in range(50)], "doc_id long, text string").repartition(5)
    numbered = importance.chunks(docs, False, chunk_words=30)
    parts = importance.blocks(numbered, 7)
    assert parts.groupBy("chunk").agg(F.sum("n").alias("n")).where("n <> 4").isEmpty()  # alpha, beta and two pairs
    counted = importance.dictionary(importance.blocks(numbered, 7).repartition("part").sortWithinPartitions("part"))
    total = counted.where("chunk is null").select(F.explode("s").alias("s")).agg(F.sum("s")).first()[0]
    assert total == 50 * 5


def test_awkward_rows_and_empty_tables(spark):
    text = "one two three " * 8
    rows = [(1, text), (1, text), (None, text), (2, "one " * 25), (3, None), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(None, "one two")], "doc_id long, text string")
    got = importance.resample(docs, target, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4] and len(got) == 6
    want = plain(rows, ["one two"], percent=100)
    assert sorted((r[:4] for r in map(tuple, got)), key=repr) == sorted((r[:4] for r in want), key=repr)
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == 6
