"""Filters, projections and unions of announced records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import pdf_url, split_names


def announced(df: DataFrame, column: str, cross_listed: bool = False) -> DataFrame:
    """New records, and cross-listed ones if asked; without a type a record is new."""
    return df.where(F.coalesce(F.col(column), F.lit("new")).isin(["new", "cross"] if cross_listed else ["new"]))


def latest(df: DataFrame, date: str) -> DataFrame:
    """Rows of the latest date, which is compared as it stands; null dates never count.

    The maximum is one value, found by partial maxima.
    """
    newest = df.agg(F.max(date).alias("__newest"))
    return df.join(F.broadcast(newest), df[date] == F.col("__newest")).drop("__newest")  # one row on the right


def in_categories(df: DataFrame, column: str, categories: list[str] | None) -> DataFrame:
    """Rows of the categories, which are put in lower case (the column is not); None is a mistake, no categories give no rows."""
    if categories is None:
        raise ValueError("a source needs its list of categories")
    return df.where(F.col(column).isin([c.lower() for c in categories]))


def preprint_papers(df: DataFrame) -> DataFrame:
    """Preprint records as candidate papers."""
    where = pdf_url(F.col("server"), F.col("doi"), F.col("item_version"))
    return df.select(F.col("item_id").alias("ord"), F.col("server").alias("source"), "title", split_names(F.col("authors")).alias("authors"), "abstract", where.alias("url"), where.alias("pdf_url"), F.lit(None).cast("string").alias("full_text"))


def united(*sources: tuple[str, DataFrame]) -> DataFrame:
    """All sources one after the other, not freed of repetitions: source_no and ord give the order."""
    out = None
    for no, (_, df) in enumerate(sources):
        tagged = df.withColumn("source_no", F.lit(no))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no sources")
    return out


def looked_up(ids: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Metadata of the ids; ids without any vanish."""
    return ids.join(metadata, key, "inner")
