"""Queries of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.personal import find_personal, redact
from folioflow.tables import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind and found_text of the personal data in every document."""
    return find_personal(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the document's text with placeholders."""
    return redact(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "redacted")


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
ORACLE: dict[str, str] = {}
