"""Language identification by interpolated Kneser-Ney character models.

For each language a character n-gram model over blank-padded words is held in
sorted arrays of 64-bit n-gram hashes.  A text gets the language of the lowest
cross-entropy in bits a character, so length plays no part.  A text is rejected
if it fits even its best language worse than all but one in 1,000 calibration
texts of its length do, and by half as much again: the excess over the language's
usual cross-entropy may be ``a + b / sqrt(letters)``, with a and b from the
calibration texts of all languages, so that a language with few of them has the
same limit, and short texts a wider one.

Learning reads a bounded sample: about ``TRAIN_DOCS`` + ``CALIBRATION_DOCS``
rows of each learned language (fewer if there are more than ``ALL_DOCS`` over all
languages), picked by a hash of id and text; of a language's words in it the
``WORDS`` most frequent are learned.  Prediction reads every row, whole, and only
its text.

Cases: a null text or one without a letter (``\\p{L}``) gets ``und``, score 0 and is
rejected; rows with a null ``lang`` or id are predicted but not learned from;
identical rows are learned from once; ties go to the alphabetically first
language; repeated rows give repeated rows; an empty table (or one with nothing to
learn from) gives ``und`` throughout; other columns are not carried, so their
names can't clash.  Long texts and long unspaced words are scored whole, the
latter in stretches that know the letters before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Numbering, letter_free, read_table, slices

#: Rows of each language that the models are fitted on, about.
TRAIN_DOCS = 600
#: Further rows of each language that the rejection is calibrated on, about.
CALIBRATION_DOCS = 1_000
#: Rows of all languages together, about; of very many languages fewer each.
ALL_DOCS = 100_000
#: Distinct words learned of a language at most, the most frequent ones.
WORDS = 200_000
#: Longest n-gram.
ORDER = 4
#: Share of the calibration texts that may lie beyond the limit before it is widened by the margin.
REJECT_RATE, REJECT_MARGIN = 0.001, 1.5
#: Letters from which a text counts as long when the limit is set.
LONG_TEXT = 256

_RUN = regex.compile(r"\p{L}+")
#: Letters scored at once.
_STRETCH = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def ngrams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of blank-padded words: word of each character, its place, and n-gram hashes.

    The k-th array holds, for every character, the hash of the k characters
    that end there (of no meaning where the word begins later than that).
    """
    padded = [f" {w} " for w in words]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    word = np.repeat(np.arange(len(padded)), size)
    return word, np.arange(len(word)) - (np.cumsum(size) - size)[word], _hashes("".join(padded), order)


def _hashes(text: str, order: int) -> list[np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    unit, rolled, out = _mix(codes + np.uint64(1)), np.zeros(len(codes), np.uint64), [np.zeros(len(codes), np.uint64)]
    for _ in range(order):
        rolled = np.concatenate([[np.uint64(0)], rolled[:-1]]) * _P + unit if len(codes) else rolled
        out.append(rolled)
    return out


@dataclass
class CharModel:
    """One language: per order, sorted n-gram hashes with log2 probabilities, and
    sorted context hashes with log2 back-off weights."""

    order: int
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = -20.0

    @classmethod
    def fit(cls, words: list[str], counts: np.ndarray, order: int = ORDER) -> CharModel:
        """Interpolated Kneser-Ney over words with their counts.

        Below the longest order an n-gram counts as often as there are distinct
        characters before it; one that opens a word has none before it and
        keeps its own count.
        """
        model = cls(order)
        word, place, hashed = ngrams(words, order)
        weight = np.asarray(counts, np.float64)[word]
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(1, order + 1):
            ends = place >= max(k - 1, 1)
            here = np.flatnonzero(ends)
            gram, first, inverse = np.unique(hashed[k][here], return_index=True, return_inverse=True)
            at = here[first]
            opens = place[at] == k - 1
            count = np.bincount(inverse, weight[here], len(gram))
            if k < order:
                longer = np.flatnonzero(place >= max(k, 1))
                _, one = np.unique(hashed[k + 1][longer], return_index=True)
                spread = np.bincount(np.searchsorted(gram, hashed[k][longer[one]]), minlength=len(gram))
                count = np.where(opens, count, np.maximum(spread, 1))
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            before = hashed[k - 1][at - 1] if k > 1 else np.zeros(len(gram), np.uint64)
            context, which = np.unique(before, return_inverse=True)
            total = np.bincount(which, count, len(context))
            kinds = np.bincount(which, minlength=len(context))
            spare = discount * kinds / total
            if lower is None:
                model.floor = float(np.log2(spare[0] / (len(gram) + 1)))
                below = np.full(len(gram), 1 / (len(gram) + 1))
            else:
                below = 2 ** lower[1][np.searchsorted(lower[0], hashed[k - 1][at])]
            logp = np.log2(np.maximum(count - discount, 0) / total[which] + spare[which] * below)
            lower = (gram, logp)
            model.grams.append(gram)
            model.logp.append(logp.astype(np.float32))
            model.contexts.append(context)
            model.backoff.append(np.log2(spare).astype(np.float32))
        return model

    def score(self, place: np.ndarray, hashed: list[np.ndarray]) -> np.ndarray:
        """log2 probability of every character; 0 for the blank that opens a word."""
        out = np.zeros(len(place))
        todo = np.flatnonzero(place > 0)
        for k in range(self.order, 0, -1):
            if not len(todo):
                break
            fits = place[todo] >= k - 1
            rest, now = todo[~fits], todo[fits]
            at, hit = _find(self.grams[k - 1], hashed[k][now])
            out[now[hit]] += self.logp[k - 1][at[hit]]
            now = now[~hit]
            if k == 1:
                out[now] += self.floor
            else:
                at, hit = _find(self.contexts[k - 1], hashed[k - 1][now - 1])
                out[now[hit]] += self.backoff[k - 1][at[hit]]
            todo = np.concatenate([rest, now])
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class LanguageModels:
    """The models of all languages and what rejection needs: usual cross-entropies, and a and b of the limit."""

    languages: list[str]
    models: list[CharModel]
    mean: np.ndarray | None = None
    limit: tuple[float, float] = (np.inf, 0.0)


class Identifier:
    """Scores texts with a table of the white-space separated pieces met so far."""

    def __init__(self, fitted: LanguageModels):
        self.fitted = fitted
        self._clear()

    def _clear(self) -> None:
        self._row, self._known = Numbering(), 0
        self._bits = np.zeros((1 << 16, len(self.fitted.languages) + 1), np.float32)

    def _learn(self, pieces: list[str]) -> None:
        """Put the bits of new pieces under each language, and their letters, into the table."""
        new = np.zeros((len(pieces), self._bits.shape[1]))
        found = [(i, w) for i, p in enumerate(pieces) for w in _RUN.findall(p.lower())]
        for at in range(0, len(found), 20_000):
            part = [(i, w) for i, w in found[at : at + 20_000] if len(w) <= _STRETCH]
            if part:
                word, place, hashed = ngrams([w for _, w in part], ORDER)
                self._add(new, np.array([i for i, _ in part])[word], place, hashed)
        for i, w in found:
            for start in range(0, len(w) + 2 if len(w) > _STRETCH else 0, _STRETCH):
                before = min(start, ORDER)  # known letters that aren't counted again
                hashed = _hashes(f" {w} "[start - before : start + _STRETCH], ORDER)
                place = np.arange(len(hashed[0])) + start - before
                self._add(new, np.full(len(place), i), place, hashed, before)
        at, self._known = self._known, self._known + len(pieces)
        if self._known > len(self._bits):
            self._bits = np.pad(self._bits, ((0, max(len(self._bits), len(pieces))), (0, 0)))
        self._bits[at : at + len(pieces)] = new

    def _add(self, total: np.ndarray, row: np.ndarray, place: np.ndarray, hashed: list[np.ndarray], skip: int = 0) -> None:
        row = row[skip:]
        total[:, -1] += np.bincount(row, (place > 0)[skip:], len(total))
        for i, m in enumerate(self.fitted.models):
            total[:, i] += np.bincount(row, m.score(place, hashed)[skip:], len(total))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character under every language, and the characters scored."""
        if self._row.full:
            self._clear()
        split = [(t or "").split() for t in texts]
        row = np.fromiter(map(self._row.__getitem__, chain.from_iterable(split)), np.int64)
        new, self._row.new = self._row.new, []
        if new:
            self._learn(new)
        ends = np.cumsum([len(s) for s in split])
        sums = np.concatenate([np.zeros((1, self._bits.shape[1])), np.cumsum(self._bits[row], 0, dtype=np.float64)])
        total = sums[ends] - sums[ends - [len(s) for s in split]]
        n = total[:, -1]
        return -total[:, :-1] / np.maximum(n, 1)[:, None], n

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of every text."""
        f = self.fitted
        bits, n = self.entropies(texts)
        if not f.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        best = bits.argmin(1)
        low = bits[np.arange(len(texts)), best]
        worse = (bits - low[:, None]) * np.minimum(n, 64)[:, None]
        score = np.where(n > 0, 1 / np.exp2(-worse).sum(1), 0.0)
        a, b = f.limit
        off = low - f.mean[best] if f.mean is not None else np.zeros(len(texts))
        lang = [f.languages[i] if k else "und" for i, k in zip(best, n > 0)]
        return lang, score, np.where(n > 0, low, np.nan), (n == 0) | (off > a + b / np.sqrt(np.maximum(n, 1)))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, *, order: int = ORDER, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> LanguageModels:
    """Fit models on the rows of ``docs`` (``doc_id, text, lang``) that may be learned from.

    Rows of each language are sampled down to the documented bounds by a hash of
    id and text, words are counted on the cluster, and only the counted words of the
    sample reach the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~letter_free(F.col("text"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModels([], [])
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    both = train_docs + calibration_docs
    wanted = min(both, ALL_DOCS / len(sizes))
    # of a small language all rows, parted between the two as the bounds are
    take = lambda part: F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(wanted / n, 1.0) * part)])[F.col("lang")]
    sample = rows.withColumn("share", share).where(F.col("share") < take(1.0)).distinct()
    fit_on, checked = sample.where(F.col("share") < take(train_docs / both)), sample.where(F.col("share") >= take(train_docs / both))
    counted = (
        fit_on.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
        .where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    )
    most = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    words = counted.withColumn("most", most).where(F.col("most") <= WORDS).drop("most").toPandas()
    languages, models = [], []
    for lang, part in words.sort_values(["lang", "word"]).groupby("lang"):
        languages.append(lang)
        models.append(CharModel.fit(part["word"].tolist(), part["n"].to_numpy(), order))
    fitted = LanguageModels(languages, models)
    _calibrate(fitted, identify_rows(checked, fitted, keep=("lang",)))
    return fitted


def _calibrate(fitted: LanguageModels, scored: DataFrame) -> None:
    """Set the usual cross-entropy of each language and the limit of the excess over it."""
    rows = scored.where(F.col("lang") == F.col("lang_pred")).select("lang", "cross_entropy", "n_scored").toPandas()
    if len(rows) < 5:  # nothing to judge by: only texts without a letter are rejected
        return
    usual = lambda r: float(np.average(r["cross_entropy"], weights=r["n_scored"]))
    parts = {lang: part for lang, part in rows.groupby("lang") if len(part) >= 5}
    fitted.mean = np.array([usual(parts.get(lang, rows)) for lang in fitted.languages])
    at = rows["lang"].map({lang: i for i, lang in enumerate(fitted.languages)}).to_numpy()
    off, n = rows["cross_entropy"].to_numpy() - fitted.mean[at], rows["n_scored"].to_numpy()
    high = lambda x: max(float(np.quantile(x, 1 - REJECT_RATE, method="higher")), 0.0) if len(x) else 0.0
    a = high(off[n >= LONG_TEXT])
    b = high((off - a)[n < LONG_TEXT] * np.sqrt(n[n < LONG_TEXT]))
    fitted.limit = (max(a, 0.25) * REJECT_MARGIN, max(b, 2.0) * REJECT_MARGIN)


def identify_rows(docs: DataFrame, fitted: LanguageModels, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict every row from its text alone: one narrow map with the models broadcast.

    The models' size is bounded by the sample they were fitted on.
    """
    models = docs.sparkSession.sparkContext.broadcast(fitted)
    names = ["doc_id", *keep, "lang_pred", "score", "cross_entropy", "n_scored", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(models.value)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                texts = part.column(part.num_columns - 1).to_pylist()
                lang, score, bits, rejected = identifier.identify(texts)
                n = [sum(map(len, _RUN.findall((t or "").lower()))) for t in texts] if keep else [0] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(bits), pa.array(n, pa.int64()), pa.array(rejected)], names
                )

    kinds = "".join(f", {c} string" for c in keep)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    return slim.mapInArrow(run, f"doc_id long{kinds}, lang_pred string, score double, cross_entropy double, n_scored long, rejected boolean")


def keep_identified(docs: DataFrame, fitted: LanguageModels) -> DataFrame:
    """The rows of ``docs`` whose text isn't rejected, with all their columns: no shuffle."""
    models = docs.sparkSession.sparkContext.broadcast(fitted)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(models.value)
        for batch in batches:
            for part in slices(batch, at_text):
                rejected = identifier.identify(part.column(at_text).to_pylist())[3]
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document; learned only from rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    fitted = fit(docs.where(~out))
    return identify_rows(docs, fitted).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )
