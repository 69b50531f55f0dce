"""Query of the operator for packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.packed import explode_packed
from folioflow.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "preprint_items").select("item_id", "authors")
    return explode_packed(items, "authors", "author", "author_no").select("item_id", "author_no", "author")


QUERIES = {"p6_found": p6_found}
ORACLE: dict[str, str] = {}
