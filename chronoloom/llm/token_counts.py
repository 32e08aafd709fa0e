"""Token counts by heap-and-linked-list byte-pair merging.

Cases: a null text counts as empty (0 bytes, 0 tokens); a text of white space
has 0 tokens; repeated rows give repeated rows; an empty table gives an empty
table; other columns of the input are not carried, so their names can't clash.
Texts of any length are counted whole, chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TokenCounter, default_vocabulary, file_bytes, on_worker
from .common import read_table


def token_counts(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; no identifiers are made.

    A narrow map: no shuffle, one batch of texts in memory at a time.
    """
    raw = docs.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = on_worker(TokenCounter, raw.value)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return slim.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document under the public word-level vocabulary."""
    return token_counts(read_table(spark, sf_dir, "documents"), default_vocabulary())
