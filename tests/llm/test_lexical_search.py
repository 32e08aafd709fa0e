"""Ranked search against SQL and a plain version."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import lexical_search
from chronoloom.llm.common import read_table

from ..conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top):
    """[(item_id, rank, doc_id, score)] by the formula; docs: [(doc_id, text)] with distinct ids."""
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    n = {i: sum(c.values()) for i, c in counts}
    of = sum(v > 0 for v in n.values())
    length = sum(n.values())
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item_id, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 25 + 25 * n[i] * of // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * of + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words_of(text) if w in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item_id, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def test_query_matches_sql_and_plain_version(spark):
    got = sorted(map(tuple, lexical_search.op13_lexical_search(spark, SF).collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert got == sorted(con.sql(lexical_search.OP13_SQL).fetchall())
    rows = lambda t, c: [tuple(r) for r in read_table(spark, SF, t).select(c, "text").collect()]
    assert got == sorted(plain(rows("documents", "doc_id"), rows("benchmark", "item_id"), 20))


@pytest.mark.parametrize("few", [0, 1000])
def test_blocks_ties_and_long_texts(spark, monkeypatch, few):
    monkeypatch.setattr(lexical_search, "FEW_TERMS", few)
    monkeypatch.setattr(lexical_search, "ITEM_GROUP", 1)
    texts = ["alpha beta", "Alpha BETA", "beta beta gamma", "x " * 5000 + "alpha", "çédille alpha-beta", "", "--", "été alpha beta"]
    docs = [(k, t) for k, t in enumerate(texts * 4)]
    items = [(1, "alpha alpha beta"), (2, "Été"), (3, "unknown"), (4, ""), (5, "gamma x")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("y")).withColumn("score", F.lit(1)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    asked = lexical_search.item_terms(i).select("term").distinct()
    index = lexical_search.postings(d, asked, block_rows=5)
    got = lexical_search.ranked(d, i, top=3, index=index)
    assert sorted(map(tuple, got.collect())) == sorted(plain(docs, items, 3))
    assert index.where("term is not null and size(at) > 5").isEmpty()


def test_awkward_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a"), (9, "a"), (9, "b"), (None, "c"), (8, None)], "item_id long, text string")
    got = [tuple(r)[:3] for r in lexical_search.ranked(docs, items).collect()]
    # a null id comes first among ties; the two texts of item 9 rank apart
    want = [(9, 1, None), (9, 2, 1), (9, 3, 1), (9, 1, 1), (9, 2, 1), (None, 1, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lexical_search.ranked(docs.limit(0), items).count() == 0
    assert lexical_search.ranked(docs, items.limit(0)).count() == 0
