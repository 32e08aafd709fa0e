"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, chat_format, decontaminate, importance, langid, lexical_search, quality_rules, secret_scan, simhash, suffix_dedup, token_counts, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, over its whole table."""
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_simhash": simhash.op2_simhash,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_bpe_codec": bpe_codec.op8_bpe_codec,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_token_files": token_files.op11_token_files,
        "op12_importance_resampling": importance.op12_importance_resampling,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op6_quality_rules": quality_rules.OP6_SQL, "op9_chat_format": chat_format.OP9_SQL, "op13_lexical_search": lexical_search.OP13_SQL}
