"""Near copies by the similarity of word shingles, for the pipeline.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more.  Candidates come from SimHash fingerprints of those sets that
meet under Golay-code fuzzy keys (:func:`.simhash.links`): all within two bits, and
those up to ``DISTANCE`` bits apart that share a key.  At 0.8, though, fingerprints lie
some ten bits apart, too far for segments that still tell texts apart, so minimum
hashes in ``BANDS`` bands of ``ROWS`` propose more (a pair at 0.8 shares a band in all
but three of 100,000 cases).  Every candidate of either is verified on the shingle
sets themselves.

Texts with equal sets are one node.  Up to ``BUCKET`` nodes under one band are
compared pair by pair.  Crowded bands mostly hold texts that share a passage and
aren't near copies, so their nodes are met again under sharper keys: of its
shingles, in an order that puts rare ones first, each has its first
n - ceil(0.8 n) + 1 as keys.  Any two sets with a similarity of 0.8 share such a
key, whatever the order, so this is exact; and what many texts hold comes last
and is hardly ever a key.  Two sets meet under a key only if what follows it in
both could still make up their similarity, as it must for the first they share.

Keys of more than ``BUCKET`` nodes take turns: all nodes are compared with some
eight of them, then those of keys that still hold more than one group with the
next 120, and so on, only across groups and each pair once, until a key is one
group or every node has had its turn.  So no link between groups is lost, and a
large group of copies costs a few comparisons a row; only a large set of texts
that share four fifths of their text in part and still aren't near copies costs
its pairs.

Cases: null and word-less texts have the empty set and are copies of each other;
a text shorter than a shingle is one shingle; a null doc_id takes part; repeated
rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, marked, marks, slices
from .components import connected_components
from .simhash import bit_counts, links, majority, row_key

#: Words in a shingle and seed of its hash.
SHINGLE, SEED = 5, 42
#: Bands of minimum hashes and hashes in a band.
BANDS, ROWS = 20, 4
#: Bits in which fingerprints of candidates may differ.
DISTANCE = 16
#: Nodes under one band or key that are compared pair by pair.
BUCKET = 16
#: Counters that shingles are counted in, to tell rare from common ones.
COUNTERS = 1 << 18
#: Nodes of a larger key in its first turn, and growth of that number by turn.
FIRST, GROWTH = 8, 16
#: Nodes of a key that one task compares with those whose turn it is.
PART = 1000

_RNG = np.random.default_rng(SEED)
_FACTOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(SHINGLE, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def bands(found: np.ndarray) -> list[int]:
    """Signed key of every band of a shingle set; none for the empty set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 12):
        least = np.minimum(least, (found[at : at + (1 << 12), None] * _FACTOR + _ADD).min(0))
    keys = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))] if len(found) else []
    return np.array(keys, np.uint64).view(np.int64).tolist()


def node_of(found: np.ndarray) -> int:
    """Signed hash of a shingle set."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def fingerprint(found: np.ndarray) -> int:
    """Signed SimHash of a shingle set: the bits that over half its hashes have."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        total += bit_counts(found[at : at + (1 << 16)])
    return int(np.array([majority(total, len(found))], np.uint64).view(np.int64)[0])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp, size, print, bands) of every row; ``fp`` stands for the shingle set, ``print`` is its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            signed = lambda f: pa.array([f(s) for s in sets], pa.int64())  # noqa: B023, E731
            out = [signed(node_of), pa.array([len(s) for s in sets], pa.int32()), signed(fingerprint), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *out], ["doc_id", "row_key", "fp", "size", "print", "bands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    return slim.mapInArrow(run, "doc_id long, row_key long, fp long, size int, print long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(fp, shingles) of ``texts`` (``fp, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["fp", "shingles"])

    return texts.mapInArrow(run, "fp long, shingles array<long>")


def close_prints(rows: DataFrame, bucket: int) -> DataFrame:
    """(a, b, parts): pairs of nodes of ``rows`` (``fp, size, print``) by their fingerprints.

    Nodes with one fingerprint are paired with the first of them, which stands for all
    of them in the pairs of fingerprints that meet under a fuzzy key.
    """
    nodes = rows.where("size > 0").select("fp", "size", "print").distinct()
    first = nodes.groupBy("print").agg(F.min(F.struct("fp", "size")).alias("one"), F.count("*").alias("n"))
    edges = links(first.select(F.col("print").alias("fp")), bucket=bucket, distance=DISTANCE)
    of = lambda c: first.select(F.col("print").alias(c), F.col("one").alias(f"of_{c}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").select(F.least("of_a", "of_b").alias("x"), F.greatest("of_a", "of_b").alias("y"), F.lit(1).alias("parts"))
    equal = nodes.join(first.where("n > 1"), "print").where(F.col("fp") != F.col("one.fp")).select(F.struct("fp", "size").alias("x"), F.col("one").alias("y"), _parts(F.col("n")).alias("parts"))
    similar = fits(F.col("x.size"), F.col("x.size"), F.col("y.size"), F.col("y.size"))
    return between.unionByName(equal).where(similar).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), "parts")


def shared_bands(rows: DataFrame) -> DataFrame:
    """(key, fp, size, rest, n): the nodes of ``rows`` (``fp, size, bands``) under every band that ``n`` > 1 of them share."""
    keyed = rows.select(F.explode("bands").alias("key"), "fp", "size").distinct().withColumn("rest", F.col("size"))
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def counted(sets: DataFrame) -> np.ndarray:
    """Number of shingles of ``sets`` (``fp, shingles``) in each of ``COUNTERS`` counters, a bounded table."""
    at = F.pmod("h", F.lit(COUNTERS)).cast("int").alias("at")
    found = sets.select(F.explode("shingles").alias("h")).groupBy(at).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def first_shingles(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of a set's shingles of which any set with a similarity of 0.8 holds one: rare ones, then by hash."""
    n = len(found)
    order = np.lexsort((found, counts[found % COUNTERS]))
    return found[order[: n - -(-4 * n // 5) + 1]]


def shared_firsts(sets: DataFrame) -> DataFrame:
    """(key, fp, size, rest, n): the nodes of ``sets`` (``fp, shingles``) that hold a first shingle of ``n`` > 1 nodes.

    ``rest`` counts the shingles of a set from this one on.
    """
    counts = counted(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            sets_here = [x.values.to_numpy() for x in batch.column(1)]
            firsts = [first_shingles(x, counts) for x in sets_here]
            times = [len(x) for x in firsts]
            fp = np.repeat(batch.column(0).to_numpy(), times)
            size = np.repeat(np.array([len(x) for x in sets_here], np.int32), times)
            rest = np.concatenate([np.arange(len(x), len(x) - n, -1, np.int32) for x, n in zip(sets_here, times)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), pa.array(fp), pa.array(size), pa.array(rest)], ["key", "fp", "size", "rest"])

    keyed = durable(sets.select("fp", "shingles").mapInArrow(run, "key long, fp long, size int, rest int"), "firsts")
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def fits(size: Column, rest: Column, other: Column, other_rest: Column) -> Column:
    """Whether two sets of these sizes, whose first common shingle has these on its right, can have a similarity of 0.8."""
    return 9 * F.least(rest, other_rest) >= 4 * (size + other)


def small_pairs(shared: DataFrame, bucket: int) -> DataFrame:
    """(a, b, parts): pairs of nodes under a band or key of at most ``bucket``."""
    x = F.struct("fp", "size", "rest")
    met = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list(x).alias("others")).select(F.explode("others").alias("x"), "others")
    later = lambda y: (y["fp"] > F.col("x.fp")) & fits(y["size"], y["rest"], F.col("x.size"), F.col("x.rest"))
    return met.select(F.col("x.fp").alias("a"), F.explode(F.filter("others", later)).alias("y")).select("a", F.col("y.fp").alias("b"), F.lit(1).alias("parts")).distinct()


def _parts(n: Column) -> Column:
    return F.ceil(n / PART).cast("int")


def _part(node: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(node), parts).cast("int")


def open_keys(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``large``, with their groups so far, of keys that hold more than one group."""
    rows = large.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")).withColumn("part", _part(F.col("fp"), _parts(F.col("n"))))
    still = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("n").alias("n")).where("x <> y")
    return rows.join(still.select("key", F.explode(F.sequence(F.lit(0), _parts(F.col("n")) - 1)).alias("part")), ["key", "part"])


def _size_class(size: Column) -> Column:
    """Sizes within some two percent of each other, so that a range of sizes is a few classes to join on."""
    return F.floor(50 * F.log(size.cast("double"))).cast("int")


def large_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b, parts): rows of open keys against those whose turn it is, where the groups differ.

    A node's turn comes by its hash, so that the keys of a group of copies agree on
    whose it is: ``FIRST`` nodes of a key on average, then up to ``GROWTH`` times
    as many, until all have had theirs.  A node meets only those whose size could
    still make up the similarity with what follows the key in it, so texts that
    hold a passage and too much else besides don't meet.
    """
    place = F.shiftrightunsigned(F.xxhash64("fp", F.lit(SEED)), 11) / F.lit(float(1 << 53))
    until = lambda t: FIRST * float(GROWTH) ** t / F.col("n")
    waiting = rows.withColumns({"place": place, "class": _size_class(F.col("size"))}).where(F.col("place") >= (until(turn - 1) if turn else F.lit(0.0)))
    its_turn = waiting.where(F.col("place") < until(turn))
    # fits() asks for a size of at most 9/4 of the rest less b's own, similarity for 4/5 to 5/4 of b's
    least, most = F.ceil(4 * F.col("size") / 5), F.least(F.floor(5 * F.col("size") / 4), F.floor((9 * F.col("rest") - 4 * F.col("size")) / 4))
    ranged = its_turn.withColumns({"least": least, "most": most}).where("most >= least and least > 0")
    classes = F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most"))))
    b = ranged.select("key", "n", F.col("fp").alias("b"), F.col("size").alias("of_b"), F.col("rest").alias("rest_b"), F.col("label").alias("label_b"), F.col("place").alias("at_b"), classes.alias("class"))
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), _parts(F.col("n")) - 1))).drop("n")
    once = (F.col("place") > F.col("at_b")) | ((F.col("place") == F.col("at_b")) & (F.col("fp") > F.col("b")))
    met = waiting.join(b, ["key", "part", "class"]).where(once & (F.col("label") != F.col("label_b")) & fits(F.col("size"), F.col("rest"), F.col("of_b"), F.col("rest_b")))
    return met.groupBy(F.col("fp").alias("a"), "b").agg(F.max(_parts(F.col("n"))).alias("parts"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have a similarity of 0.8 or more.

    A ``b`` that many pairs hold has its pairs dealt over ``parts`` tasks.
    """
    a = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("of_a"))
    hubs = pairs.groupBy("b").agg(F.max("parts").alias("parts")).join(sets.withColumnRenamed("fp", "b"), "b")
    b = hubs.select("b", F.col("shingles").alias("of_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    met = pairs.withColumn("part", _part(F.col("a"), F.col("parts"))).join(a, "a").join(b, ["b", "part"])
    return met.where(9 * common >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def groups(docs: DataFrame, rows: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """(node, label): the group of every node that has a link."""
    shared = durable(shared_bands(rows), "bands")
    close = durable(close_prints(rows, bucket), "close-prints")
    doc = F.coalesce("doc_id", F.lit(0)).alias("doc")
    met = shared.select("fp").unionByName(close.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    some = rows.join(met, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct(doc, "row_key")).alias("one"))
    wanted = durable(some.select("fp", "one.*"), "wanted")  # written, so that the join below is planned by its size
    mark = marks(wanted, "row_key")
    texts = marked(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), row_key().alias("row_key"), "text"), "row_key", mark)
    sets = durable(shingle_sets(texts.join(wanted, ["doc", "row_key"]).groupBy("fp").agg(F.first("text").alias("text"))), "shingles")
    for used in (wanted, mark):
        forget(used)
    crowded = sets.join(shared.where(F.col("n") > bucket).select("fp").distinct(), "fp", "left_semi")
    crowded = durable(crowded, "crowded")
    firsts = durable(shared_firsts(crowded), "first-keys")
    forget(crowded)
    near = durable(close.unionByName(small_pairs(shared, bucket)).unionByName(small_pairs(firsts, bucket)).dropDuplicates(["a", "b"]), "pairs")
    labels = connected_components(verified(near, sets))
    large = durable(firsts.where(F.col("n") > bucket), "large")
    for used in (near, shared, close, firsts):  # components and rows of large keys are written by now
        forget(used)
    largest, turn, n = large.agg(F.max("n")).first()[0] or 0, 0, large.count()
    while FIRST * GROWTH ** (turn - 1) < largest:  # a last turn in which all have had theirs is over
        left = durable(open_keys(large, labels), "open", rows=n)
        forget(large)
        if left.isEmpty():
            break
        near = durable(large_pairs(left, turn), "pairs")
        links = verified(near, sets)
        named = labels.select(F.col("node").alias("fp"), "label")
        to = lambda c: named.select(F.col("fp").alias(c), F.col("label").alias(f"to_{c}"))  # noqa: B023, E731
        between = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        joined = connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("next"))
        old = labels.join(joined, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        new = joined.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("next").alias("label"))
        labels, large, turn = durable(old.unionByName(new), "labels", rows=labels.count() + joined.count()), left.select(*large.columns), turn + 1
        forget(near)
    forget(large)
    forget(sets)
    return labels


def near_copies(docs: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, row_key, label) of every row of ``docs`` (``doc_id, text``); ``label`` names its group."""
    rows = durable(signatures(docs), "signatures")
    labels = groups(docs, rows, bucket=bucket).withColumnRenamed("node", "fp")
    return rows.join(labels, "fp", "left").select("doc_id", "row_key", F.coalesce("label", "fp").alias("label"))
