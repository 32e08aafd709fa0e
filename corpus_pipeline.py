"""A training-corpus pipeline over ``documents``: five stages, each written before the next.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it
kept and returns the columns of ``documents``; the last returns ids in place of
texts.  Rows are told apart by id and text, so that ids which occur twice, or
are null, do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import bpe, bpe_codec, decontaminate, langid, near_copies, secret_scan, simhash
from chronoloom.llm.common import durable, read_table

#: SQL can express neither the language models nor the byte-pair merges.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in none of the learned languages go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more; candidates by SimHash and Golay keys, and by minimum hashes)."""
    return simhash.keep_one(docs, near_copies.near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secret_scan.redact_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids."""
    return bpe_codec.encoded_documents(docs, bpe.default_vocabulary())


STAGES = [
    ("language id", language_id),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name.replace(" ", "-"))
    return docs
