"""Query of the index of accepted works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.lineage import scratch
from folioflow.llm.history import WorkIndex
from folioflow.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_paper_id and paper_id of each row whose work was accepted before; each arrival batch is handed in on its own."""
    papers = table(spark, sf_dir, "papers").select("paper_id", "batch_no", "title", "url")
    batches = sorted(r[0] for r in papers.where("batch_no is not null").select("batch_no").distinct().collect())  # one number a batch
    index = WorkIndex(spark, scratch(spark, "works"))
    index.ingest_all(((str(at), papers.where(F.col("batch_no") == at)) for at in batches), "paper_id", "title", "url")
    return index.repeats().select(F.col("first").alias("first_paper_id"), F.col("id").alias("paper_id"))


QUERIES = {"p4_found": p4_found}
ORACLE: dict[str, str] = {}
