"""Queries of the nearest vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.neighbours import nearest
from folioflow.tables import table


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, vec_id and similarity: the 10 most similar vectors of each query vector."""
    return nearest(table(spark, sf_dir, "abstract_vectors").select("vec_id", "vec"), table(spark, sf_dir, "knn_queries"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id_a, vec_id_b: the distinct pairs of a query and its neighbours, the smaller id first."""
    pairs = p7_neighbours(spark, sf_dir)
    return pairs.select(F.least("query", "vec_id").alias("vec_id_a"), F.greatest("query", "vec_id").alias("vec_id_b")).distinct()


QUERIES = {"p7_found": p7_found, "p7_neighbours": p7_neighbours}
ORACLE = {
    "p7_found": """
        WITH v AS (SELECT vec_id, list_transform(vec, lambda x: x::DOUBLE) AS v FROM abstract_vectors WHERE vec_id IS NOT NULL AND len(vec) = 64 AND NOT coalesce(list_bool_or(list_transform(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))), false)),
        g AS (SELECT vec_id, v FROM v WHERE list_inner_product(v, v) > 0), q AS (SELECT DISTINCT g.* FROM g JOIN knn_queries USING (vec_id)),
        s AS (SELECT q.vec_id AS a, g.vec_id AS b, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, g.v) DESC, g.vec_id) AS r FROM q JOIN g ON q.vec_id <> g.vec_id)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM s WHERE r <= 10""",
}
