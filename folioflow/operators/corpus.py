"""The reader's library: collection paths, memberships and path filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.globs import any_path_matches, checked_patterns


def collection_paths(collections: DataFrame) -> DataFrame:
    """collection_key and path, the names from the root to the collection joined by slashes.

    collections: collection_key (unique), collection_name, parent_collection
    (null or `false` at the root). A collection whose parent is not there begins a
    path of its own. A cycle has no root and gives no rows. Null names are empty.
    """
    session = collections.sparkSession
    tidy = collections.select("collection_key", F.coalesce("collection_name", F.lit("")).alias("name"), F.nullif("parent_collection", F.lit("false")).alias("parent")).where("collection_key is not null")
    known = tidy.select(F.col("collection_key").alias("parent"), F.lit(True).alias("there"))
    tidy.join(known, "parent", "left").select("collection_key", "name", F.when(F.col("there"), F.col("parent")).alias("parent")).createOrReplaceTempView("__folioflow_collections")
    return session.sql("""
        WITH RECURSIVE walked(collection_key, path) AS (
            SELECT collection_key, name FROM __folioflow_collections WHERE parent IS NULL
            UNION ALL
            SELECT c.collection_key, concat(w.path, '/', c.name) FROM walked w JOIN __folioflow_collections c ON c.parent = w.collection_key
        )
        SELECT collection_key, path FROM walked""")


def with_paths(items: DataFrame, memberships: str, paths: DataFrame, id_col: str) -> DataFrame:
    """items with `paths`, one for each collection in the array `memberships`, in its order.

    A membership in no known collection is left out; items without any get an
    empty array. The paths are as many as there are collections, not items, and
    are joined as their size allows.
    """
    spread = items.select(F.col(id_col).alias("__id"), F.posexplode(memberships).alias("__at", "collection_key"))
    told = spread.join(paths, "collection_key").groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("__at", "path"))).alias("__paths"))
    joined = items.join(told, items[id_col] == F.col("__id"), "left").drop("__id")
    return joined.withColumn("paths", F.coalesce(F.transform("__paths", lambda x: x["path"]), F.array().cast("array<string>"))).drop("__paths")


def filter_paths(corpus: DataFrame, include: list[str] | None = None, ignore: list[str] | None = None, paths: str = "paths") -> DataFrame:
    """Rows with a path that matches a pattern of `include`, less those with one of `ignore`.

    None or an empty list is no filter. Rows without paths are dropped by an
    include filter and kept by an ignore filter.
    """
    include, ignore = checked_patterns(include, "include_path"), checked_patterns(ignore, "ignore_path")
    if include:
        corpus = corpus.where(any_path_matches(F.col(paths), include))
    if ignore:
        corpus = corpus.where(~any_path_matches(F.col(paths), ignore))
    return corpus


def with_abstract(corpus: DataFrame, abstract: str = "abstract") -> DataFrame:
    """Rows whose abstract is not empty; one of blanks stays, null goes."""
    return corpus.where(F.col(abstract) != "")
