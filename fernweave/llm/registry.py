"""Queries of the corpus operators and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licence_scan, lm_score, mixing, near_dup, quality, secret_scan, span_dedup, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_scan": licence_scan.op1_licence_scan,
    "op2_substring_dedup": span_dedup.op2_substring_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_near_duplicates": near_dup.op4_near_duplicates,
    "op5_resolve_revisits": warc.op5_resolve_revisits,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_token_counts": token_counts.op10_token_counts,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": span_dedup.OP2_SQL,
    "op5_resolve_revisits": warc.OP5_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
}
