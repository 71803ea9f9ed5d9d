"""The queries of the corpus operators and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratacut.llm import collocations, decontaminate, filter_audit, html_text, line_dedup, lm_score, media, near_dedup, packing, pii, quality, repeats, toxicity

MODULES = (html_text, lm_score, quality, toxicity, near_dedup, packing, decontaminate, media, line_dedup, pii, collocations, repeats, filter_audit)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
