"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, exact_dedup, html_extract, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": near_dedup.query,
    "op2_byte_bpe": bpe.query,
    "op3_source_mixing": mixing.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_line_dedup": line_dedup.query,
    "op6_html_extraction": html_extract.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_quality_rules": quality_rules.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_language_id": language_id.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_source_mixing": mixing.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
