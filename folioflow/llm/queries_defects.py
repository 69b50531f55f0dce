"""Query of the classifier of broken pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.defects import find_defects
from folioflow.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id and defect of the papers with a defective summary."""
    papers = table(spark, sf_dir, "papers")
    pairs = papers.select(F.col("paper_id").alias("id"), "title", F.col("abstract").alias("prompt"), F.col("tldr").alias("response"))
    return find_defects(pairs).select(F.col("id").alias("paper_id"), "defect")


QUERIES = {"p1_found": p1_found}
ORACLE: dict[str, str] = {}
