"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

Loggers that store a conversation after every turn leave many conversations
that are prefixes of longer ones.  A rolling hash of every turn prefix names
each prefix; conversations whose whole hash is a proper prefix of another are
taken out by an anti-join, identical ones keep the smallest id, and the turns of
those that remain are rendered.

The rolling hash is the exclusive-or of 64-bit hashes of (turn, role, text),
twice with different seeds, along with the number of turns.  Rows are sorted by
range over all tasks; hashes are summed for each task's part of a conversation
first, so one conversation of very many turns, or of very many rows under one
turn number, is spread over tasks.

Cases: repeated rows count once; turns with one number are ordered by role, then
text, nulls first, and each row of them ends a prefix; a null turn comes first; a
null role renders as ``user`` and a null text as empty, but neither equals its
stand-in when conversations are compared; the marks of the template inside a role
or text get a blank (``< |``), so that a text can't forge a turn; rows with a null
conv_id form one conversation; an empty table gives an empty table; other columns
are not carried, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read_table

_KEY = ["n", "a", "b"]


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, a, b, last): the rolling hash of every prefix of every conversation.

    Distinct rows are sorted by range, so a block is what one task holds of a
    conversation; running values go over blocks first, then within a block.
    """
    order = ["conv_id", "turn", "role", "text"]
    whole = F.concat_ws(",", *[F.col(c).isNull().cast("string") for c in order[1:]])
    rows = _turns(conversations).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    each = durable(
        rows.select(
            "conv_id", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("place"),
            F.xxhash64(F.lit("a"), whole, "turn", "role", "text").alias("a"), F.xxhash64(F.lit("b"), "text", whole, "role", "turn").alias("b"),
        ),
        "turns",
    )
    blocks = each.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole_of = Window.partitionBy("conv_id")
    offsets = blocks.select(
        F.col("conv_id").alias("of"), F.col("block").alias("of_block"),
        *[F.coalesce(f(c).over(before), F.lit(0)).alias(f"{c}0") for c, f in (("n", F.sum), ("a", F.bit_xor), ("b", F.bit_xor))],
        F.sum("n").over(whole_of).alias("total"),
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = each.select("conv_id", "block", F.count("*").over(upto).alias("n"), F.bit_xor("a").over(upto).alias("a"), F.bit_xor("b").over(upto).alias("b"))
    same = running["conv_id"].eqNullSafe(offsets["of"]) & (running["block"] == offsets["of_block"])
    return running.join(offsets, same).select(
        "conv_id", (F.col("n") + F.col("n0")).alias("n"),
        F.col("a").bitwiseXOR(F.col("a0")).alias("a"), F.col("b").bitwiseXOR(F.col("b0")).alias("b"),
        (F.col("n") + F.col("n0") == F.col("total")).alias("last"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same): one id for each conversation that prefixes no longer one.

    Whole and proper prefixes are grouped by their hash before they meet, so a
    first turn or a conversation that a third of the log shares is one row.
    """
    prefixes = turn_prefixes(conversations)
    whole = prefixes.where("last").groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    proper = prefixes.where("not last").select(*_KEY).distinct()
    return whole.join(proper, _KEY, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_same")


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template; marks inside it are parted by a blank."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), plain(F.coalesce(role, F.lit("user"))), F.lit("|>\n"), plain(F.coalesce(text, F.lit(""))), F.lit("\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, rendered, n_turns, n_same): the rendered turns of maximal conversations.

    A conversation is its rendered turns in order of turn; they stay rows, so
    that none has to fit into one task.
    """
    kept = maximal_conversations(conversations)
    turns = _turns(conversations).groupBy("conv_id", "turn", "role", "text").agg(F.lit(1).alias("one"))
    return turns.join(kept.withColumnRenamed("conv_id", "kept_id"), turns["conv_id"].eqNullSafe(F.col("kept_id"))).select(
        "conv_id", "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), "n_turns", "n_same"
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of every maximal conversation of the log."""
    return format_chats(read_table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM t GROUP BY conv_id
),
u AS (SELECT l, len(l) AS n, min(conv_id) AS conv_id, count(*) AS n_same FROM c GROUP BY l),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
m AS (SELECT conv_id, n, n_same FROM u ANTI JOIN p USING (l))
SELECT t.conv_id, t.turn, t.role,
  '<|' || replace(coalesce(t.role, 'user'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') || chr(10) AS rendered,
  CAST(m.n AS BIGINT) AS n_turns, CAST(m.n_same AS BIGINT) AS n_same
FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id
"""
