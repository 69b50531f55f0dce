"""Queries of matching two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.matching import match
from folioflow.tables import table


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_id, paper_id and confidence of the rows that are the same work."""
    library = table(spark, sf_dir, "corpus_papers").select(F.col("corpus_id").alias("id"), "title", F.col("abstract").alias("text"))
    papers = table(spark, sf_dir, "papers").select(F.col("paper_id").alias("id"), "title", F.col("abstract").alias("text"))
    return match(library, papers).select(F.col("a").alias("corpus_id"), F.col("b").alias("paper_id"), "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("corpus_id", "paper_id")


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches}
ORACLE: dict[str, str] = {}
