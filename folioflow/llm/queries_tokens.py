"""Queries of the operators on tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.tokens import encode_corpus
from folioflow.tables import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict[str, str] = {}
