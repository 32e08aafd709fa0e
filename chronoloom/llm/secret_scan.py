"""Secret scans over a trigram inverted index, in DataFrame functions alone.

For each rule a Boolean query over trigrams is derived from its regular
expression.  The index is a table of postings, (trigram, text), of the trigrams that
some query asks for; it is written once.  The postings of each text meet in one
grouping, which intersects and unites them as the queries say (by text, so that a
trigram that a third of all texts hold is in no one task); what is left are the
candidates, (text, rules), and only those are verified with the expressions
themselves.  A rule whose expression has no mandatory trigram scans every text.

Cases: a null text counts as empty (no spans); overlapping spans of different
kinds are all reported; repeated rows give repeated rows; an empty table gives an
empty table; other columns are kept by :func:`with_spans`, but for one that bears
the name ``spans``, which is replaced.  Positions are in code points.  Matching never
recurses with the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read_table


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  A match counts if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base kinds; the rest are published token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("chat_host", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,250}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = 3

#: Query nodes: a trigram, ("and", nodes), ("or", nodes); None holds for every text.
_MOST_STRINGS = 32


def _and(nodes):
    nodes = list(dict.fromkeys(n for n in nodes if n is not None))
    return None if not nodes else nodes[0] if len(nodes) == 1 else ("and", tuple(nodes))


def _or(nodes):
    """Any of the nodes; one that asks for all that another asks for, and more, is left out."""
    nodes = list(dict.fromkeys(nodes))
    if None in nodes or not nodes:
        return None
    plain = {n: frozenset(n[1]) if n[0] == "and" else frozenset([n]) for n in nodes}
    nodes = [n for n in nodes if not any(plain[m] < plain[n] for m in nodes)]
    return nodes[0] if len(nodes) == 1 else ("or", tuple(nodes))


def _of_strings(strings: set[str]):
    """Some one of these strings occurs."""
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings_of(op, arg) -> set[str] | None:
    """All strings a small node can match, lower-cased; None if too many."""
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(a).lower() for _, a in arg}
    if op is rc.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is rc.BRANCH:
        parts = [_sequence(x)[0] for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence(arg[2])[0]
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _query_of(op, arg):
    if op is rc.SUBPATTERN:
        return _sequence(arg[3])[1]
    if op is rc.BRANCH:
        return _or([_sequence(x)[1] for x in arg[1]])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
        return _sequence(arg[2])[1]
    return None


def _sequence(nodes) -> tuple[set[str] | None, object]:
    """(every string the nodes match, or None; the trigrams a match must have)."""
    whole, run, found = True, {""}, []
    for op, arg in nodes:
        strings = _strings_of(op, arg)
        if strings is not None and len(strings) * len(run) <= _MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        whole = False
        found += [_of_strings(run), _query_of(op, arg) if strings is None else _of_strings(strings)]
        run = {""}
    found.append(_of_strings(run))
    return (run if whole else None), _and(found)


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; None if nothing is mandatory."""
    return _sequence(rp.parse(pattern))[1]


def _trigrams(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _holds(query, index: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(index, query)
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_holds(q, index) for q in query[1]])


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once for a row."""
    return F.transform(F.array(value), body)[0]


def _places(lengths: Column) -> Column:
    """[start, end) of every match from (gap, length) pairs, by sums of sums of blocks.

    Blocks keep the cost of a text with very many matches far below the square.
    """
    block = 256
    size = lambda x: x["gap"] + x["len"]
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def placed(pairs: Column) -> Column:
        sizes = F.transform(pairs, size)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / block).cast("int")), lambda b: add(F.slice(sizes, b * block + 1, block)))
        before = lambda bs: F.transform(
            pairs,
            lambda x, i: _let(
                add(F.slice(bs, F.lit(1), F.floor(i / block).cast("int")))
                + add(F.transform(F.slice(pairs, (F.floor(i / block) * block + 1).cast("int"), i % block), size)) + x["gap"],
                lambda start: F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["ok"].alias("ok")),
            ),
        )
        return _let(blocks, before)

    return _let(lengths, placed)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    r"""Spans of a rule in a text: each match follows the end of the one before (\G)."""
    pattern = rf"\G(?s:(.*?))({rule.pattern})"
    found = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.arrays_zip(found(1).alias("before"), found(2).alias("match"), found(2 + rule.group).alias("value"))
    lengths = F.transform(
        pairs,
        lambda x: F.struct(
            F.length(x["before"]).alias("gap"), F.length(x["match"]).alias("len"), (F.length(x["value"]) >= rule.least).alias("ok")
        ),
    )
    return F.transform(
        F.filter(_places(lengths), lambda x: x["ok"]),
        lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")),
    )


_NONE = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: A text is told by its row's id and two hashes.
_TEXT = ["\x00id", "\x00a", "\x00b"]


def _told(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``docs`` with the columns ``_TEXT``."""
    hashes = (F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text), F.xxhash64(F.lit("b"), text))
    return docs.withColumns(dict(zip(_TEXT, hashes)))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(trigram, text): the inverted index of ``docs``, of the trigrams that the rules' queries ask for; letters count in either case."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    grams = F.array(*[F.lit(g) for g in sorted(set().union(*(_trigrams(trigram_query(r.pattern)) for r in rules)))]).cast("array<string>")
    held = _let(F.lower(text), lambda t: F.filter(grams, lambda g: F.contains(t, g)))
    return _told(docs, id_col, text).select(F.explode(held).alias("trigram"), *_TEXT)


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text, rules): the texts whose postings satisfy some rule's query, and the places of those rules."""
    held = index.groupBy(*_TEXT).agg(F.collect_set("trigram").alias("held"))
    queries = [trigram_query(r.pattern) for r in rules]
    fits = [F.when(_holds(q, F.col("held")), F.lit(k)) for k, q in enumerate(queries) if q is not None]
    found = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<int>")
    return held.select(*_TEXT, found.alias("\x00rules")).where(F.size("\x00rules") > 0)


def with_spans(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``spans``: all matches of all rules by start, then rule order.

    The candidates are written, so their size is known when they are joined.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = durable(candidates(postings(docs, rules, text_col=text_col, id_col=id_col), rules), "candidates")
    met = _told(docs.drop("spans"), id_col, text).join(found, _TEXT, "left")
    parts = []
    for rank, rule in enumerate(rules):
        mandatory = trigram_query(rule.pattern) is not None
        candidate = F.coalesce(F.array_contains("\x00rules", rank), F.lit(False)) if mandatory else text.rlike(rule.pattern)
        parts.append(F.when(candidate, _spans(text, rule, rank)).otherwise(F.array().cast(_NONE)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "spans"]
    return met.select(*kept, F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of covered characters replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                F.when((s["start"] < acc["at"]) & (acc["at"] > 0), F.lit("")).otherwise(F.lit(mark)),
            ).alias("out"),
        )
    )
    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and ``n_chars`` counted anew; every row stays."""
    if "spans" in docs.columns:  # set aside meanwhile
        return redact_secrets(docs.withColumnRenamed("spans", "__set_aside")).withColumnRenamed("__set_aside", "spans")
    clean = with_spans(docs).withColumn("text", redacted(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row."""
    of = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return with_spans(docs.select("doc_id", "text")).select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["rank"] < BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    return secret_report(read_table(spark, sf_dir, "documents"))
