"""Queries of cutting oversized texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.chunks import chunk
from folioflow.tables import table


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every full text over its source's limit."""
    papers = table(spark, sf_dir, "papers").select("paper_id", "full_text", "source")
    return chunk(papers, table(spark, sf_dir, "chunk_limits"), "paper_id", "full_text", "source").withColumnRenamed("id", "paper_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id of each text that was cut, and whether its cuts could all be natural."""
    return p5_chunks(spark, sf_dir).where("piece_no = 1").select("paper_id", "cut")


QUERIES = {"p5_found": p5_found, "p5_chunks": p5_chunks}
ORACLE = {
    "p5_found": r"""
        SELECT p.paper_id, CASE WHEN list_max(list_transform(regexp_split_to_array(p.full_text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.!?;。！？；]'), lambda x: length(x))) > l.max_chars THEN 'forced' ELSE 'natural' END AS cut
        FROM papers p JOIN chunk_limits l ON p.source = l.source WHERE length(p.full_text) > l.max_chars""",
}
