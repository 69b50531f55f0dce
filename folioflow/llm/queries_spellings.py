"""Queries of linking spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.spellings import link_organisations, link_persons, spelling_pairs
from folioflow.tables import table


def _entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, sf_dir, "papers")
    people = link_persons(papers.select(F.explode("authors").alias("name")), "name")
    organisations = link_organisations(papers.select(F.explode("affiliations").alias("name")), "name")
    return people, organisations


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, name_a and name_b of all pairs of spellings of one entity."""
    people, organisations = _entities(spark, sf_dir)
    one = spelling_pairs(people).select(F.lit("person").alias("kind"), "name_a", "name_b")
    return one.unionByName(spelling_pairs(organisations).select(F.lit("organisation").alias("kind"), "name_a", "name_b"))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, name and the number of its entity, one row for each distinct spelling."""
    people, organisations = _entities(spark, sf_dir)
    return people.select(F.lit("person").alias("kind"), "name", "entity").unionByName(organisations.select(F.lit("organisation").alias("kind"), "name", "entity"))


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
ORACLE: dict[str, str] = {}
