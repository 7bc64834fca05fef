"""All registered queries of the engine's own operators, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analytic_queries, document_queries, privacy_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect, arbitrate, decide and redact over all documents."""
    return QUERIES["deidentify_documents"](spark, sf_dir)
