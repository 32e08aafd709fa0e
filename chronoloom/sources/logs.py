"""Raw system logs: three line grammars to one event table.

Lines that break their grammar are kept aside with ``malformed`` set, so that
they can be counted.  Line numbers come with the scan when it reads text files,
and fix the order of equal time stamps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` sees it.
_BLANK = r"(?U)[\s\x1C-\x1F]+"
#: Fields of a line before its content, which is the rest as it stands.
#: label, epoch, date, node, precise time, node, type, component, level
BGL = 9
#: label, epoch, date, node, month, day, time, user
THUNDERBIRD = 8
#: date, time, process, level
HDFS = 4
_BLOCK, _TO = r"(blk_-?\d+)", r"dest: /([\d.]+)"


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(row_id, line): UTF-8 text with bad bytes replaced, numbered file by file in order of path.

    Numbers are dense and made without a global sort: a split (a stretch of a file)
    begins at the number of lines in those before it, by path and then by offset, whatever
    task reads it; a row for each split is summed and broadcast.
    """
    at = F.monotonically_increasing_id().alias("at")
    raw = spark.read.text(path).select(F.col("value").alias("line"), at, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # a task may read several splits, each in one piece
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift"))
    numbered = raw.join(F.broadcast(offsets), ["file", "block"]).select((F.col("at") + F.col("shift")).alias("row_id"), "line")
    return numbered if limit is None else numbered.where(F.col("row_id") < limit)


def read_block_labels(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, BlockId, Label) of a label file in order of its lines; the header and lines of other than two fields go."""
    parts = F.split("line", ",")
    found = read_lines(spark, path).select("row_id", parts.alias("f")).where(F.size("f") == 2)
    return found.select("row_id", F.trim(F.col("f")[0]).alias("BlockId"), F.trim(F.col("f")[1]).alias("Label")).where("BlockId <> 'BlockId'")


def _fields(lines: DataFrame, n: int, least: int) -> DataFrame:
    """(row_id, f, malformed): each line split once into ``n`` fields and the rest; fewer than ``least`` parts break the grammar."""
    parts = F.split(F.regexp_replace("line", "^" + _BLANK, ""), _BLANK, n + 1)
    rows = lines.select("row_id", parts.alias("f"))
    return rows.withColumn("malformed", F.coalesce(F.get("f", F.lit(least - 1)), F.lit("")) == "")


def _field(k: int) -> Column:
    """The k-th part, from 1; empty if there are fewer."""
    return F.coalesce(F.get("f", F.lit(k - 1)), F.lit(""))


def parse_bgl(lines: DataFrame) -> DataFrame:
    """A log with microsecond time stamps: label first, ``-`` for normal; a line may have no content."""
    return _events(_fields(lines, BGL, BGL), F.try_to_timestamp(_field(5), F.lit("yyyy-MM-dd-HH.mm.ss.SSSSSS")), _field(10))


def parse_thunderbird(lines: DataFrame) -> DataFrame:
    """A log whose clock is the epoch second in its second field."""
    return _events(_fields(lines, THUNDERBIRD, THUNDERBIRD), F.timestamp_seconds(_field(2).try_cast("bigint")), _field(9))


def _events(rows: DataFrame, time: Column, content: Column) -> DataFrame:
    label = _field(1)
    return rows.select(
        "row_id", time.alias("timestamp"), _field(4).alias("node"), label.alias("label"), (label != "-").alias("anomaly"), content.alias("raw_message"), "malformed"
    )


def parse_hdfs(lines: DataFrame) -> DataFrame:
    """A session-keyed log: the first block id of a line is its session, ``dest:`` its node."""
    content = _field(5)
    return _fields(lines, HDFS, HDFS + 1).select(
        "row_id",
        F.try_to_timestamp(F.concat_ws(" ", _field(1), _field(2)), F.lit("yyMMdd HHmmss")).alias("timestamp"),
        F.nullif(F.regexp_extract(content, _TO, 1), F.lit("")).alias("node"),
        F.nullif(F.regexp_extract(content, _BLOCK, 1), F.lit("")).alias("block_id"),
        content.alias("raw_message"), (F.col("malformed") | ~content.rlike(_BLOCK)).alias("malformed"),
    )


def well_formed(parsed: DataFrame) -> DataFrame:
    """The rows that fit their grammar."""
    return parsed.where("not malformed").drop("malformed")


def join_block_labels(events: DataFrame, labels: DataFrame, *, order: str | None = None) -> DataFrame:
    """Block labels (BlockId, Label) onto lines; unmatched lines are unlabelled and normal.

    Of several labels of one block the last by ``order`` stands; without it each
    block has one label.
    """
    last = F.max_by("Label", order) if order else F.max("Label")
    one = labels.groupBy(F.col("BlockId").alias("block_id")).agg(last.alias("label"))
    return events.join(one, "block_id", "left").withColumn("anomaly", F.coalesce(F.col("label") == "Anomaly", F.lit(False)))


def log_summary(events: DataFrame) -> DataFrame:
    """One row: lines, share anomalous, exact numbers of nodes and templates, time range."""
    return events.agg(
        F.count("*").alias("n_rows"), F.avg(F.col("anomaly").cast("double")).alias("anomalous_fraction"),
        F.countDistinct("node").alias("n_nodes"), F.countDistinct("event_template").alias("n_templates"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
    )
