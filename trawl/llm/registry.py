"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontam, divergence, exact_dedup, hard_negatives, language_id, license_scan, lm_score, minhash, quality, sp_sampling, substring_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_quality": quality.op2_quality,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_minhash": minhash.op4_minhash,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_sp_sampling": sp_sampling.op7_sp_sampling,
        "op8_decontam": decontam.op8_decontam,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_lm_score": lm_score.op10_lm_score,
        "op11_divergence": divergence.op11_divergence,
        "op12_language_id": language_id.op12_language_id,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op3_license_scan": license_scan.OP3_SQL,
        "op5_chat_format": chat_format.OP5_SQL,
        "op8_decontam": decontam.OP8_SQL,
        "op11_divergence": divergence.OP11_SQL,
        "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
