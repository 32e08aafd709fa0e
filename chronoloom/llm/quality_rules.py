"""Quality rules with cross-document line frequency, in DataFrame functions alone.

A document first meets within-document rules (too few words, too much repeated
in eight-word windows).  Then normalised lines are hashed and, for each host
(``source``), the distinct documents that hold a line are counted; lines in one of
``LINE_PART`` of a host's documents or more (and in ``LINE_FLOOR`` at least, so that a small host has
boilerplate too but chance doesn't make it) are taken away, and a document that
keeps too small a share of its words is rejected.  Byte-identical copies count
as one document: a copied document isn't boilerplate of itself.  Lines are
normalised once and written, as their hashes, for the two uses.

Cases: a null text has no words and fails; a null source is a host of its own;
rows with one doc_id repeated are judged each; lines without a word are not
counted; an empty table gives an empty table; other columns are not carried, so
their names can't clash.  Long texts are handled whole: the window hashes are one
array a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read_table

#: What parts words; every other character belongs to one.
BLANKS = r"[\x20\x09-\x0D]+"
#: Words in a repetition window.
WINDOW = 8
#: A line in one of so many of a host's distinct documents ...
LINE_PART = 10
#: ... and in so many of them at least is taken away.
LINE_FLOOR = 10
#: A document that keeps a smaller share of its words is rejected.
LEAST_KEPT = 0.3


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once for a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text (none for null)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more; ``words`` is an array column.

    Words are hashed once, windows by the hashes of their words; only where those
    aren't all distinct are they sorted, and the union of the repeated windows is
    summed from their starts.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"]))
            marked = F.transform(s, lambda x, j: F.when(F.coalesce(same(x, j), F.lit(False)), x["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        total = lambda at: F.aggregate(
            at,
            F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum")),
            lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(i - acc["last"], F.lit(window))).alias("sum")),
            lambda acc: acc["sum"],
        )
        return F.when(
            F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)
        ).otherwise(_let(_let(placed, starts), total))

    def over(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(
            F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(F.slice(w, i, window)),
        )
        return _let(hashes, covered)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), over)


def base_rules(docs: DataFrame) -> DataFrame:
    """Within-document figures of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeated")),
    )
    row = docs.select(
        "doc_id", "doc", "row_key", of_words.alias("w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(
        "doc_id", "doc", "row_key", F.col("w.n").cast("long").alias("n_words"), F.col("w.chars").cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", F.col("w.repeated").cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return row.withColumn("base_failed", failed)


def line_rows(docs: DataFrame) -> DataFrame:
    """One row for each normalised line of a document, with its place and its words.

    Texts are lower-cased, digits become 0, white space is single; only the hashes
    of their lines leave the map.
    """
    blank = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+"  # lone blanks are left as they are
    norm = F.lower(F.regexp_replace(F.regexp_replace("text", blank, " "), r"[0-9]+", "0"))
    return (
        docs.select("doc", "row_key", "source", "content", F.posexplode(F.split(norm, "\n")).alias("place", "line"))
        .select("doc", "row_key", "source", "content", "place", F.trim("line").alias("line")).where("line <> ''")
        .select(
            "doc", "row_key", "source", "content", "place", F.xxhash64("line").alias("line_hash"),
            (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("words"),
        )
    )


def frequent_lines(lines: DataFrame, docs: DataFrame, part: int, floor: int) -> DataFrame:
    """(source, line_hash) in one of ``part`` of a source's distinct documents or more, and in ``floor`` at least.

    Grouped counts, combined before they are shuffled, so that a very common line
    or a large host costs a row a task.
    """
    hosts = docs.groupBy("source", "content").agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("*").alias("host_documents"))
    counts = (
        lines.groupBy("source", "line_hash", "content").agg(F.lit(1).alias("one"))
        .groupBy("source", "line_hash").agg(F.count("*").alias("documents")).where(F.col("documents") >= floor)
    )
    met = counts.join(hosts.withColumnRenamed("source", "host"), F.col("source").eqNullSafe(F.col("host")))
    return met.where(F.col("documents") * part >= F.col("host_documents")).select("source", "line_hash")


def quality(docs: DataFrame, *, line_part: int = LINE_PART, line_floor: int = LINE_FLOOR, least_kept: float = LEAST_KEPT) -> DataFrame:
    """Figures and verdict of every row of ``docs`` (``doc_id, text, source``).

    A row is told by its id and a hash of the rest.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), "source").select(
        "doc_id", "text", "source", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64("text").alias("content"),
        F.xxhash64(F.col("doc_id").isNull(), F.col("source").isNull(), "source", "text").alias("row_key"),
    )
    lines = durable(line_rows(keyed), "lines")
    common = frequent_lines(lines, keyed.select("source", "content"), line_part, line_floor)
    removed = (
        lines.join(common, lines["line_hash"].eqNullSafe(common["line_hash"]) & lines["source"].eqNullSafe(common["source"]), "left_semi")
        .groupBy("doc", "row_key", "place").agg(F.first("words").alias("words"))  # a repeated row counts once
        .groupBy("doc", "row_key").agg(F.sum("words").alias("words_removed"))
    )
    base = base_rules(keyed)
    gone = F.coalesce("words_removed", F.lit(0))
    return base.join(removed, ["doc", "row_key"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_words") - gone >= least_kept * F.col("n_words"))).alias("kept"),
        gone.cast("long").alias("words_removed"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdict of every whole document."""
    return quality(read_table(spark, sf_dir, "documents"))


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT k, doc_id, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
),
g AS (SELECT k, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT k, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
m AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM g) WHERE n > 1),
r AS (SELECT k, sum(least({WINDOW}, coalesce(step, {WINDOW}))) AS n FROM (SELECT k, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS step FROM m) GROUP BY k),
l AS (
  SELECT k, source, text, len(line) - len(replace(line, ' ', '')) + 1 AS words, line FROM (
    SELECT k, source, text, lower(regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')) AS line
    FROM (SELECT k, source, text, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE line <> ''
),
h AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
f0 AS (SELECT source, line, count(DISTINCT text) AS n FROM l GROUP BY source, line),
c AS (SELECT f0.source, line FROM f0 JOIN h ON f0.source IS NOT DISTINCT FROM h.source WHERE f0.n >= {LINE_FLOOR} AND {LINE_PART} * f0.n >= h.n),
x AS (SELECT k, sum(words) AS n FROM l SEMI JOIN c ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line GROUP BY k),
b AS (
  SELECT k, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS words_removed
  FROM w LEFT JOIN r USING (k) LEFT JOIN x USING (k)
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - words_removed >= {LEAST_KEPT} * n_words AS kept, words_removed
FROM f
"""
