"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, decontaminate, hard_negatives, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_sharding": sharding.op12_sharding,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op2_decontamination": decontaminate.SQL,
        "op3_substring_dedup": substring_dedup.SQL,
        "op7_line_dedup": line_dedup.SQL,
        "op8_quality_rules": quality_rules.SQL,
        "op11_hard_negatives": hard_negatives.SQL,
        "op12_sharding": sharding.SQL,
    }
