"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder used where the session names none (tests on one machine).
_LOCAL_FOLDER: list[str] = []
#: Folders written by :func:`durable` and not deleted yet.
_WRITTEN: set[str] = set()
#: Narrow rows in a file, where their number is known.
FILE_ROWS = 50_000
#: Rows of 64 bits in a table of :func:`marks`.
SLOTS = 1 << 18


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session sets none, a temporary folder serves a session on one
    machine; on a cluster that is an error, as executors would each write to
    their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="chronoloom-"))
    return "file://" + _LOCAL_FOLDER[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; :func:`forget_all` deletes what is written there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def durable(df: DataFrame, name: str, *, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor.  ``rows``: about how many narrow
    rows it has at most, where that is known, so that few rows aren't strewn over many files.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if rows is not None:
        df = df.coalesce(-(-rows // FILE_ROWS) or 1)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`durable` once it has been used."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def forget_all(spark: SparkSession) -> None:
    """Delete whatever :func:`durable` has written and nobody has deleted yet.

    For the end of a job: results are lazy and read such files, so only their
    user knows when they have been used.
    """
    for folder in list(_WRITTEN):
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.difference_update({w for w in _WRITTEN if w.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]})


def marks(rows: DataFrame, key: str) -> DataFrame:
    """(slot, bits): one bit for each hash ``key`` of ``rows``, in a table of at most ``SLOTS`` rows.

    For :func:`marked`, so that most rows of a wide table needn't be moved to a join that would drop them.
    """
    bit = F.pmod(F.shiftrightunsigned(key, 32), F.lit(64)).cast("int").alias("bit")
    found = rows.select(F.pmod(key, F.lit(SLOTS)).alias("slot"), bit)
    return durable(found.groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")), "marks", rows=SLOTS)


def marked(rows: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """``rows`` whose hash ``key`` has its bit in ``of``: all whose key was marked, and a few others."""
    named = of.select(F.col("slot").alias("\x00slot"), F.col("bits").alias("\x00bits"))
    bit = F.expr(f"shiftright(`\x00bits`, cast(pmod(shiftrightunsigned(`{key}`, 32), 64) as int)) & 1")
    met = rows.join(F.broadcast(named), F.pmod(key, F.lit(SLOTS)) == F.col("\x00slot"))
    return met.where(bit == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def letter_free(text: Column) -> Column:
    """True where a text is null or has no letter."""
    return ~F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def slices(batch: pa.RecordBatch, text_column: int, *, rows: int = 256, size: int = 400_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``size`` bytes of text (a longer text stands alone)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_column)), 0), np.int64)
    at, n = 0, len(lengths)
    ends = np.cumsum(lengths)
    while at < n:
        limit = (ends[at - 1] if at else 0) + size
        end = min(max(int(np.searchsorted(ends, limit, side="right")), at + 1), at + rows, n)
        yield batch.slice(at, end - at)
        at = end


class Numbering(dict):
    """Numbers words in order of first use; ``new`` lists those not numbered before it was last emptied.

    ``full`` once the words are many or long together, so that unspaced scripts,
    whose "words" are paragraphs, don't fill the memory.
    """

    def __init__(self, entries: int = 400_000, characters: int = 8_000_000):
        super().__init__()
        self.new: list[str] = []
        self._entries, self._left = entries, characters

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        self._left -= len(word)
        return at

    @property
    def full(self) -> bool:
        return len(self) > self._entries or self._left < 0
