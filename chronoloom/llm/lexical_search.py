"""Ranked lexical search: posting lists as a term-bucketed DataFrame, integer scores, the best of each item.

Documents are taken in blocks; a block's texts become one row a term, with the
documents of the block that hold it, how often, and how long they are.  These rows are
dealt and sorted by bucket of their term and written; a term's frequency is a sum over
its rows.  Item terms join the postings by term; the matching rows, each with a bounded
group of the items that ask for it, are then dealt by block, where every document's
scores are summed without moving a match, and the best of each block compete for an
item's ranks.

Cases: a null or wordless text has no terms, never ranks and isn't counted; a document of
any length lies whole in one block; every row is a document of its own, so repeated and
null ids rank by themselves (ties: ascending id, null first, then place in the table);
identical items count once, items of one id with other texts are ranked each by itself; an
item with a null or wordless text has no rows; empty tables give no rows; other columns
aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read_table, slices

#: Documents of a block, and bytes of text from which it ends.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8_000_000
#: Buckets that terms are hashed to, and tasks that the blocks of one bucket are dealt over.
BUCKETS, SALTS = 256, 8
#: Items in one row of a term's items.
ITEM_GROUP = 512
#: Distinct item terms up to which documents' other terms are passed over when postings are made.
FEW_TERMS = 200_000
#: Results of an item.
TOP = 20

_SMALL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POSTING = "term string, block long, at array<int>, doc_id array<long>, tf array<int>, n array<long>, n_docs long, n_words long"
_NAMES = [f.split()[0] for f in _POSTING.split(", ")]


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other than ASCII characters, A-Z made small."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SMALL).split()


def inverted(texts: list[str | None], wanted: set[bytes] | None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, ends, at, tf, n) of a block: sorted terms, where each one's postings end, its documents, how often; words of every text."""
    number: dict[bytes, int] = {}
    n, flat = np.zeros(len(texts), np.int64), []
    for k, words in enumerate(map(terms_of, texts)):
        n[k] = len(words)
        kept = words if wanted is None else [w for w in words if w in wanted]
        flat.append(np.fromiter((number.setdefault(w, len(number)) for w in kept), np.int64, len(kept)))
    names = sorted(number)
    place = np.empty(len(names), np.int64)
    place[[number[w] for w in names]] = np.arange(len(names))
    where = np.repeat(np.arange(len(texts)), [len(f) for f in flat])
    pairs, tf = np.unique(place[np.concatenate(flat)] * max(len(texts), 1) + where if len(where) else where, return_counts=True)
    term, at = np.divmod(pairs, max(len(texts), 1))
    return names, np.searchsorted(term, np.arange(len(names)), side="right"), at, tf, n


def postings(docs: DataFrame, terms: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The written postings of ``docs``: one row a block and term, laid out by bucket of the term.

    With ``terms`` (``term``) only theirs are kept.  A row without a term has a block's
    documents with terms and their words.
    """
    wanted = None
    if terms is not None:
        found = [r["term"].encode("utf-8", "surrogatepass") for r in terms.limit(FEW_TERMS + 1).collect()]
        wanted = frozenset(found) if len(found) <= FEW_TERMS else None  # too many to send: the join passes over the rest
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in (p for batch in batches for p in slices(batch, 1, rows=block_rows, size=BLOCK_BYTES)):
            held.append(part)
            size += part.column(1).nbytes
            if sum(p.num_rows for p in held) >= block_rows or size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held and sum(p.num_rows for p in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, block in enumerate(blocks(batches)):
            names, ends, at, tf, n = inverted(block.column(1).to_pylist(), shared.value)
            rows = len(names)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(at.astype(np.int32)), block.column(0).take(pa.array(at)), pa.array(tf.astype(np.int32)), pa.array(n[at]))]
            none = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in names], pa.string()), pa.array(np.full(rows, first + k)), *lists, none, none], _NAMES)
            empty = [pa.nulls(1, x.type) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([first + k]), *empty, pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], _NAMES)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = slim.mapInArrow(run, _POSTING).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    # a term of every document has a row in each block, so the blocks of a bucket are dealt over some tasks
    return durable(made.repartition("bucket", F.pmod("block", F.lit(SALTS))).sortWithinPartitions("bucket", "term", "block"), "postings")


def item_terms(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, qtf) of every distinct item; ``item`` tells items apart."""
    distinct = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    numbered = durable(distinct.withColumn("item", F.monotonically_increasing_id()), "search-items")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(small, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return numbered.select("item", "item_id", F.explode(words).alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("qtf"))


def _score(w: Column, tf: Column, m: Column) -> Column:
    """w * ((10**9 tf) div (1000 tf + 12 m)) in 64-bit integers."""
    return w * F.call_function("div", F.lit(1_000_000_000) * tf, 1000 * tf + 12 * m)


def ranked(docs: DataFrame, items: DataFrame, *, top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item.

    ``index``: postings that exist already; else those of the items' terms are made.
    """
    asked = durable(item_terms(items), "search-terms")
    index = postings(docs, asked.select("term").distinct()) if index is None else index
    whole = index.where("term is null").agg(F.sum("n_docs").alias("of"), F.sum("n_words").alias("length"))
    lists = index.where("term is not null")
    df = lists.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.col("of") + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df, "term").crossJoin(F.broadcast(whole)).withColumn("w", weight)
    # a row has a bounded number of items, so that a term of all items isn't one array
    n_groups = max(1, -(-asked.select("item").distinct().count() // ITEM_GROUP))
    group = F.pmod(F.xxhash64("item"), F.lit(n_groups))
    by_term = weighed.groupBy("term", group.alias("group"), "w", "of", "length").agg(F.collect_list(F.struct("item", "qtf")).alias("items"))
    met = lists.join(by_term, "term").select("block", "at", "doc_id", "tf", "n", "w", "of", "length", "items")
    # dealt by block, all matches of a document lie in one task: sums and the best of a block need no further shuffle
    each = met.repartition("block").select("block", "items", "w", "of", "length", F.explode(F.arrays_zip("at", "doc_id", "tf", "n")).alias("p"))
    m = 100 - 25 + F.call_function("div", 25 * F.col("p.n") * F.col("of"), F.col("length"))
    scored = each.select("block", "items", F.col("p.at").alias("at"), F.col("p.doc_id").alias("doc_id"), _score(F.col("w"), F.col("p.tf").cast("long"), m).alias("s"))
    matches = scored.select("block", "at", "doc_id", "s", F.explode("items").alias("i")).select("block", "at", "doc_id", F.col("i.item").alias("item"), (F.col("s") * F.col("i.qtf")).alias("s"))
    sums = matches.groupBy("block", "item", "at", "doc_id").agg(F.sum("s").alias("score")).where("score > 0")
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("block"), F.asc("at")]
    best = sums.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).where(F.col("rank") <= top)
    final = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    names = asked.select("item", "item_id").distinct()
    return final.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL),
whole AS (SELECT count(*) AS N_, sum(n)::BIGINT AS L_ FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
sums AS (
  SELECT item_id, doc_id,
         sum(qtf * floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * N_) // L_)))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN dfs USING (term) JOIN lengths USING (doc_id), whole
  GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM sums WHERE score > 0
QUALIFY rank <= 20
"""
