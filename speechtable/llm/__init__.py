"""Operators for large training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprint, merkle, mixing, periodic, pii, quality, recompress, secrets, simhash, tokens, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": urls.query,
        "op2_benchmark_decontamination": decontaminate.query,
        "op3_personal_data": pii.query,
        "op4_token_counts": tokens.query,
        "op5_secret_scans": secrets.query,
        "op6_simhash_near_dedup": simhash.query,
        "op7_source_mixing": mixing.query,
        "op8_quality_classifier": quality.query,
        "op9_substring_dedup": recompress.query,
        "op10_document_fingerprints": fingerprint.query,
        "op11_merkle_manifest": merkle.query,
        "op12_periodic_runs": periodic.query,
        "op13_chat_formatting": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": decontaminate.SQL, "op7_source_mixing": mixing.SQL, "op11_merkle_manifest": merkle.SQL, "op13_chat_formatting": chat.SQL}
