"""Queries of mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.mixing import distinct_texts, mix
from folioflow.llm.tokens import token_count, vocabulary_path
from folioflow.tables import table


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    targets = table(spark, sf_dir, "mix_targets")
    listed = documents.join(targets.select("source").distinct(), "source", "left_semi")
    texts = distinct_texts(listed, "doc_id", "text", "source", token_count(F.col("text"), vocabulary_path()))
    return mix(texts, targets)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, doc_id, tokens and uses of each text that is in the mix."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by each source of mix_targets."""
    return _mixed(spark, sf_dir)[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}
