"""The pipeline's near dedup finds candidates by SimHash fingerprints and Golay keys."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import near_copies

from ..conftest import SF


def copies(rng, n=1500):
    """Pairs of long texts that differ in their last word, apart from those without a copy."""
    texts = []
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 10**6, n)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
    return texts + [" ".join(f"w{k}" for k in rng.integers(0, 10**6, n)) for _ in range(8)]


def bits(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def test_fingerprints_alone_link_copies_within_two_bits(spark, monkeypatch):
    texts = copies(np.random.default_rng(3))
    prints = [near_copies.fingerprint(near_copies.shingles(t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = lambda rows: rows.select(F.lit(0).cast("long").alias("key"), "fp", "size", F.col("size").alias("rest"), F.lit(2).cast("long").alias("n")).where("false")
    monkeypatch.setattr(near_copies, "shared_bands", none)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, SF).collect()}
    near = {k for k in range(1, 24, 2) if bits(prints[k - 1], prints[k]) <= 2}
    assert len(near) >= 8 and not near & kept  # every pair within two bits is one document
    assert kept >= set(range(0, 24, 2)) | set(range(24, 32))


def test_close_prints_hold_every_pair_within_two_bits(spark):
    """Against all pairs, with fingerprints that several nodes share and keys that hold many."""
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    prints = [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (30, 2))] + base + base
    rows = [(k, 100, p) for k, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "fp long, size int, print long")
    for bucket in (2, 16):
        parent = list(range(len(rows)))
        for r in near_copies.close_prints(df, bucket).collect():
            a, b = parent[r["a"]], parent[r["b"]]
            parent = [min(a, b) if p in (a, b) else p for p in parent]
        assert all(parent[i] == parent[j] for i in range(len(rows)) for j in range(i) if bits(prints[i], prints[j]) <= 2)
