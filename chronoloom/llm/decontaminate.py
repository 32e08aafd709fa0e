"""Benchmark decontamination by template canonicalisation.

Numbers (in digits or words), names (words with a capital) and units become typed
placeholders, so that a benchmark question with other numbers and names keeps its
template.  Where there are names, windows also go with these as words in small letters, so
that a copy in other letter case, with other numbers or not, keeps one template too.
Windows of the templates are hash-joined.  A window has ``WINDOW`` words; where fewer than ``LITERALS`` of them
are literal it is lengthened until it holds that many, to the right from each word
and to the left, so that every word of an item with that many literal words lies in
some window.  Windows of ``WINDOW`` words with fewer literal ones also go by
their real words, so that copies in part match there too.  Items that are too short or too
dense in slots for either match a whole line, or a whole document, of their template (of
their real words, if they have no literal one).

A match counts only where the values in its slots fit a one-to-one mapping between
the item's values and the document's, or equal the item's.  A document is
contaminated by an item if consistent windows cover ``SIMILARITY`` of the item's
words, or an unbroken run of ``RUN`` words.  The mapping is judged for each
occurrence by itself (a band of shifts narrower than the item), so several versions
of an item in one document don't spoil each other, and once for the document as a
whole, so an item in scattered parts counts too; the best one counts.

Items that differ in nothing but their values, and whose values are equal to each
other in the same places, contaminate the same documents.  They are one class, which
the smallest item_id stands for, and ``n_items`` counts it: a benchmark of one question in a
thousand versions costs one question.

A document's windows are tested in its own task against the sorted window hashes
of the benchmark, broadcast in blocks of at most ``BLOCK_WINDOWS`` (16 MB), so a
benchmark of any size costs one pass a block; only hits, written once, are
shuffled.

Cases: a null or empty text matches nothing; a null doc_id or item_id is carried
through; words of punctuation alone are passed over; one doc_id on several rows is
judged by each text; repeated rows and items give one row a pair; empty tables give
an empty table; other columns are not carried, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import running_powers
from .common import Numbering, durable, read_table, slices

#: Words in a window, at least.
WINDOW = 5
#: Words of a window that must be literal for its template to count.
LITERALS = 3
#: Share of an item's words that consistent windows must cover ...
SIMILARITY = 0.8
#: ... or words of an item matched in one unbroken run.
RUN = 20
#: Window hashes in a broadcast block.
BLOCK_WINDOWS = 2_000_000

#: Unit words.
UNITS = frozenset(
    "percent mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur degree degrees km/h mph kmh hz khz mhz kb mb gb tb w kw v".split()
)
#: Number words.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen".split()
)
_EDGES = "#*$&|<>.,;:!?\"'()[]{}-_=+/\\~`@^%"
#: Starts of the hashes over real words, over whole lines and over both, which keep them apart from templates.
_EXACT, _LINE, _EXACT_LINE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_Q = np.uint64(0xD6E8FEB86659FD93)
_DIGIT = re.compile(r"\d")
_SKIP, _LITERAL, _NUMBER, _NAME, _UNIT = -1, 0, 1, 2, 3


def _kind_of(core: str, low: str) -> int:
    """Kind of a word without its punctuation; ``low`` is the word in lower case.

    A number has a digit or is made of number words; a name begins with a capital,
    whatever follows (all capitals, McGregor, O'Brien).
    """
    if not core:
        return _SKIP
    if not core.isalpha() and _DIGIT.search(core) or low in NUMBER_WORDS or "-" in low and all(x in NUMBER_WORDS for x in low.split("-")):
        return _NUMBER
    if low in UNITS:
        return _UNIT
    return _NAME if len(core) > 1 and core[0] != low[0] else _LITERAL


class Sums:
    """Hashes of any stretch of words, from running sums modulo 2**64."""

    def __init__(self, words: np.ndarray, start: np.uint64 = np.uint64(0)):
        up, self._down = running_powers(len(words) + 1)
        self._sum, self._start = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)])]), start

    def of(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self._sum[end] - self._sum[at]) * self._down[at] + (end - at).astype(np.uint64) * _Q
        x = (x ^ self._start ^ (x >> np.uint64(32))) * _Q
        return x ^ (x >> np.uint64(29))


class Template:
    """Words of many texts: hash in the template and as they are, kind, row in the table of words, and where lines and texts end."""

    def __init__(self, hashed: np.ndarray, plain: np.ndarray, kind: np.ndarray, row: np.ndarray, line_ends: np.ndarray, ends: np.ndarray):
        self.kind, self.row, self.line_ends, self.ends = kind, row, line_ends, ends
        self._sums = {k: Sums(w, k) for k, w in ((np.uint64(0), hashed), (_EXACT, plain), (_LINE, hashed), (_EXACT_LINE, plain))}
        self._literals = np.concatenate([[0], np.cumsum(kind == _LITERAL)])
        self._names = np.concatenate([[0], np.cumsum(kind == _NAME)])
        self._hashed, self._plain = hashed, plain

    def nameless(self) -> Template:
        """The same words with names as literal words in small letters, so that texts in other letter case match."""
        name = self.kind == _NAME
        return Template(np.where(name, self._plain, self._hashed), self._plain, np.where(name, _LITERAL, self.kind), self.row, self.line_ends, self.ends)

    def stretches(self, lengths: np.ndarray | None = None) -> list[tuple[Template, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, start, end, hash) of windows and lines: with names as slots, and, where there are names, with them as words."""
        found = []
        for t in (self, self.nameless()):
            at, end, hashed = (np.concatenate(x) for x in zip(t.windows(), t.lines(lengths)))
            if t is not self:
                some = self._names[end] > self._names[at]
                at, end, hashed = at[some], end[some], hashed[some]
            found.append((t, at, end, hashed))
        return found

    def literals(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._literals[end] - self._literals[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every window."""
        n = len(self.kind)
        places, starts = np.flatnonzero(self.kind == _LITERAL), np.concatenate([[0], self.ends[:-1]])
        word = np.arange(n)
        of = np.searchsorted(self.ends, word, side="right")
        last, first = self.ends[of], starts[of]
        # to the right from each word: the literal word that completes it lies LITERALS - 1 literal words on
        far = np.append(places, np.full(LITERALS, n + 1))[np.searchsorted(places, word) + LITERALS - 1] + 1
        right = np.maximum(word + WINDOW, far)
        # to the left from the end of each word
        near = np.concatenate([np.full(LITERALS, -1), places])[np.searchsorted(places, word, side="right")]
        left = np.minimum(word + 1 - WINDOW, near)
        a, b = np.flatnonzero(right <= last), np.flatnonzero((left >= first) & (left < word + 1 - WINDOW))
        b = b[right[left[b]] != b + 1]  # those that the first kind has too
        short = np.flatnonzero(word + WINDOW <= last)
        short = short[self.literals(short, short + WINDOW) < LITERALS]
        at, end = np.concatenate([a, left[b], short]), np.concatenate([right[a], b + 1, short + WINDOW])
        plain = len(a) + len(b)
        hashed = np.concatenate([self._sums[np.uint64(0)].of(at[:plain], end[:plain]), self._sums[_EXACT].of(at[plain:], end[plain:])])
        return at, end, hashed

    def lines(self, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of whole texts, and of whole lines of ``lengths`` words, by template or else by real words."""
        which = (self.ends,) if lengths is None else (self.line_ends, self.ends)
        at = np.concatenate([np.concatenate([[0], e[:-1]]) for e in which]).astype(np.int64)
        end = np.concatenate(which)
        size = end - at
        fits = size > 0 if lengths is None else np.isin(size, lengths[lengths > 0])
        at, end = at[fits], end[fits]
        literal = self.literals(at, end)
        some, none = (literal > 0) & weak(end - at, literal), literal == 0
        by = [(at[m], end[m], self._sums[k].of(at[m], end[m])) for k, m in ((_LINE, some), (_EXACT_LINE, none))]
        return tuple(np.concatenate(x) for x in zip(*by))


def weak(n_words: np.ndarray, literals: np.ndarray) -> np.ndarray:
    """Stretches that no window can represent: short ones, or ones with too few literal words."""
    return (n_words < WINDOW) | (literals < LITERALS)


class Canonicalizer:
    """Texts to templates: a hash and a kind for each word, from a bounded table of words."""

    def __init__(self):
        self._slot = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>", 3)) for k in (_NUMBER, _NAME, _UNIT)}
        self._hash, self._kind = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int8)
        self._clear()

    def _clear(self) -> None:
        self._row = Numbering()
        self._core: list[str] = []

    def _learn(self, pieces: list[str]) -> None:
        at, core = len(self._core), [p.strip(_EDGES) for p in pieces]
        low = [c.lower() for c in core]
        kind = [_kind_of(c, w) for c, w in zip(core, low)]
        if at + len(pieces) > len(self._hash):
            more = max(len(self._hash), len(pieces))
            self._hash, self._kind = np.pad(self._hash, (0, more)), np.pad(self._kind, (0, more))
        self._core += low
        self._kind[at : at + len(pieces)] = kind
        self._hash[at : at + len(pieces)] = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 3) for w in low]

    def template(self, texts: list[str | None]) -> Template:
        """The words of all texts."""
        if self._row.full:
            self._clear()
        lines = [(t or "").split("\n") for t in texts]
        pieces = [x.split() for x in chain.from_iterable(lines)]
        row = np.fromiter(map(self._row.__getitem__, chain.from_iterable(pieces)), np.int64)
        self._learn(self._row.new)
        self._row.new = []
        line = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
        real = self._kind[row] != _SKIP
        row, line = row[real], line[real]
        line_ends = np.cumsum(np.bincount(line, minlength=len(pieces)))
        ends = np.append(0, line_ends)[np.cumsum([len(x) for x in lines])] if lines else np.zeros(0, np.int64)
        kind, plain = self._kind[row], self._hash[row]
        hashed = plain.copy()
        after_number = np.zeros(len(kind), bool)
        after_number[1:] = kind[:-1] == _NUMBER
        after_number[ends[ends < len(kind)]] = False  # not across texts
        kind = np.where((kind == _UNIT) & ~after_number, _LITERAL, kind)
        for k, slot in self._slot.items():
            hashed[kind == k] = slot
        return Template(hashed, plain, kind, row, line_ends.astype(np.int64), ends.astype(np.int64))

    def values(self, at: int, end: int, t: Template) -> list[str]:
        """The values in the slots of a stretch of words."""
        return [self._core[t.row[j]] for j in range(at, end) if t.kind[j] != _LITERAL]


_WINDOW_ROW = "id long, content long, n_words long, place long, length long, window long, slots array<string>"
_WINDOW_NAMES = ["id", "content", "n_words", "place", "length", "window", "slots"]


def _window_batch(canon: Canonicalizer, t: Template, keys: list, contents: list, at: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> pa.RecordBatch:
    of = np.searchsorted(t.ends, at, side="right").tolist()
    start = np.concatenate([[0], t.ends[:-1]]).astype(np.int64)
    out = [
        [keys[i] for i in of], [contents[i] for i in of], (t.ends - start)[of], at - start[of], end - at, hashed.view(np.int64),
        [canon.values(a, e, t) for a, e in zip(at.tolist(), end.tolist())],
    ]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], _WINDOW_NAMES)


def item_windows(items: DataFrame) -> DataFrame:
    """(id, content, n_words, place, length, window, slots) of all windows of ``items`` (``id, content, text``), or of the whole item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canonicalizer()
        for batch in (part for whole in batches for part in slices(whole, 2)):
            for t, *found in canon.template(batch.column(2).to_pylist()).stretches():
                yield _window_batch(canon, t, batch.column(0).to_pylist(), batch.column(1).to_pylist(), *found)

    return items.select("id", "content", "text").mapInArrow(run, _WINDOW_ROW)


def document_windows(docs: DataFrame, only: np.ndarray, lengths: np.ndarray) -> DataFrame:
    """The windows of ``docs`` (``id, content, text``) whose hash is in ``only`` (sorted), lines of ``lengths`` words too."""
    shared = docs.sparkSession.sparkContext.broadcast((only, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, (wanted, sizes) = Canonicalizer(), shared.value
        for batch in (part for whole in batches for part in slices(whole, 2)):
            for t, at, end, hashed in canon.template(batch.column(2).to_pylist()).stretches(sizes):
                hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, hashed), len(wanted) - 1)] == hashed)
                yield _window_batch(canon, t, batch.column(0).to_pylist(), batch.column(1).to_pylist(), at[hit], end[hit], hashed[hit])

    return docs.select("id", "content", "text").mapInArrow(run, _WINDOW_ROW)


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(id, content, n_items, text): one item for each template and pattern of equal values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canonicalizer()
        for batch in (part for whole in batches for part in slices(whole, 2)):
            t = canon.template(batch.column(2).to_pylist())
            names = []
            for a, e in zip(np.concatenate([[0], t.ends[:-1]]).astype(int).tolist(), t.ends.tolist()):
                seen: dict[str, int] = {}
                pattern = [seen.setdefault(v, len(seen)) for v in canon.values(a, e, t)]
                whole = t._sums[_LINE if t.literals(a, e) else _EXACT_LINE].of(np.array([a]), np.array([e]))
                names.append(f"{int(whole[0]):016x}{pattern}" if e > a else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], ["id", "content", "text", "name"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("content"), "text").distinct()
    named = rows.mapInArrow(run, "id long, content long, text string, name string").where("name is not null")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content", "text"))
    return named.groupBy("name").agg(least.alias("one"), F.count("*").alias("n_items")).select("one.id", "one.content", "n_items", "one.text")


def hits(docs: DataFrame, items: DataFrame, *, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Windows of ``docs`` that are windows of ``items`` (written by now): one pass for each block of item windows."""
    known = items.select("window").distinct()
    blocks = max(1, -(-known.count() // block))
    part = F.pmod(F.xxhash64("window"), F.lit(blocks))
    lengths = items.where((F.col("place") == 0) & (F.col("length") == F.col("n_words"))).select("length").distinct().toPandas()["length"].to_numpy(np.int64)
    found = []
    for b in range(blocks):
        hashes = np.sort(known.where(part == b).toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
        if len(hashes):
            found.append(document_windows(docs, hashes, lengths))
    return reduce(DataFrame.unionByName, found) if found else item_windows(docs.limit(0))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, coverage, longest_run, n_items) of every contaminated document and its items.

    ``docs`` has ``doc_id, text``; ``benchmark`` has ``item_id, text``.
    """
    found = _contaminated(docs, benchmark, similarity, run).groupBy("doc_id", "item_id")
    return found.agg(F.max("coverage").alias("coverage"), F.max("longest_run").alias("longest_run"), F.max("n_items").alias("n_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with all their columns."""
    bad = _contaminated(docs, benchmark, SIMILARITY, RUN).select(F.col("doc_id").alias("\x00id"), F.col("content").alias("\x00content")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("\x00id")) & (F.xxhash64("text") == F.col("\x00content"))
    return docs.join(bad, same, "left_anti")


def _contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float, run: int) -> DataFrame:
    """(doc_id, content, item_id, coverage, longest_run, n_items), by the text of a document too."""
    classes = durable(item_classes(benchmark), "items")
    items = durable(item_windows(classes), "item-windows")
    found = durable(hits(docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("content"), "text"), items), "hits")
    left = found.select(F.col("id").alias("doc_id"), "content", F.col("place").alias("doc_place"), "window", F.col("slots").alias("doc_slots"))
    right = items.select(
        F.col("id").alias("item_id"), F.col("content").alias("item_content"), F.col("n_words").alias("item_words"),
        "place", "length", "window", F.col("slots").alias("item_slots"),
    )
    key = ["doc_id", "content", "item_id", "item_content", "shift"]
    met = left.join(right, "window").withColumn("shift", F.col("doc_place") - F.col("place"))
    met = met.select(*key, "item_words", "place", "length", "item_slots", "doc_slots").distinct()
    met = met.select("*", F.explode(_bands()).alias("band"))
    key = [*key, "band"]
    consistent = _consistent(met, key)
    item = [k for k in key if k != "shift"]
    # words covered, once for a band as a whole and once along each shift
    reached = lambda keys: F.coalesce(
        F.max("end").over(Window.partitionBy(*keys).orderBy("place", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)
    )
    ends = consistent.select(*key, "item_words", "place", (F.col("place") + F.col("length")).alias("end"))
    cover = (
        ends.select(*item, "item_words", "place", "end").distinct()
        .select(*item, "item_words", F.greatest(F.col("end") - F.greatest("place", reached(item)), F.lit(0)).alias("new"))
        .groupBy(*item, "item_words").agg(F.sum("new").alias("covered"))
    )
    runs = (
        ends.distinct().withColumn("opens", (F.col("place") > reached(key)).cast("int"))
        .withColumn("island", F.sum("opens").over(Window.partitionBy(*key).orderBy("place", "end").rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "island").agg((F.max("end") - F.min("place")).alias("length"))
        .groupBy(*item).agg(F.max("length").alias("longest_run"))
    )
    same = reduce(lambda a, b: a & b, [cover[k].eqNullSafe(runs[k]) for k in item])
    pairs = (
        cover.join(runs, same)
        .select(cover["doc_id"], cover["content"], cover["item_id"], cover["item_content"], (F.col("covered") / F.col("item_words")).alias("coverage"), "longest_run")
        .where((F.col("coverage") >= similarity) | (F.col("longest_run") >= run))
    )
    size = classes.select(F.col("id").alias("class_id"), F.col("content").alias("class_content"), "n_items")
    of = F.col("item_id").eqNullSafe(F.col("class_id")) & (F.col("item_content") == F.col("class_content"))
    return pairs.join(size, of).select("doc_id", "content", "item_id", "coverage", "longest_run", "n_items")


def _bands() -> Column:
    """The bands of an occurrence's shift: null for the whole document, and two half overlapping ones.

    A band spans half the item at most, so copies one after another are never in one;
    shifts within a quarter of the item, as words put in or left out make them, share one.
    """
    band = F.floor(F.col("shift") / F.greatest(F.floor(F.col("item_words") / 4), F.lit(1)))
    return F.array(F.lit(None).cast("long"), band, band - 1)


def _consistent(met: DataFrame, key: list[str]) -> DataFrame:
    """Windows whose slots equal the item's or all fit the one-to-one mapping that most slots of the band follow.

    One mapping holds for all shifts of a band, so a template that repeats itself can't
    be covered piecemeal by values that fit a different mapping in each place.
    """
    item = [k for k in key if k != "shift"]
    changed = (F.col("item_slots") != F.col("doc_slots")).alias("changed")
    slot = met.where(F.size("item_slots") > 0).select(*key, "place", "length", changed, F.explode(F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))).alias("s"))
    slot = slot.select(*key, "place", "length", "changed", F.col("s.i").alias("item_value"), F.col("s.d").alias("doc_value"))
    votes = slot.groupBy(*item, "item_value", "doc_value").agg(F.count("*").alias("n"))
    best = lambda of, by: F.max(F.struct("n", of)).over(Window.partitionBy(*item, by))[of]
    odd = votes.select(
        *item, "item_value", "doc_value",
        ((best("doc_value", "item_value") != F.col("doc_value")) | (best("item_value", "doc_value") != F.col("item_value"))).alias("odd"),
    ).where("odd").drop("odd")
    join = lambda a, b, names: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in names])
    changed = slot.where("changed")
    bad = changed.join(odd, join(changed, odd, [*item, "item_value", "doc_value"]), "left_semi").select(*key, "place", "length").distinct()
    return met.join(bad, join(met, bad, [*key, "place", "length"]), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against all benchmark items."""
    return contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
