"""BM25 over texts, by groups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import tokens

# Fixed values of the formula.
K1, B = 1.5, 0.75


def bm25(docs: DataFrame, group: str, id_col: str, text: str, query: str) -> DataFrame:
    """group, id and score of every text for a query, each group being a collection of its own.

    A repeated query token counts as often as it occurs. An empty query scores 0
    everywhere. Texts without tokens score 0. Only query tokens are exploded, and
    the statistics are sums with partial results ahead of the shuffle.
    """
    asked = [t.lower() for t in re.findall("[a-zA-Z0-9]+", query)]
    told = docs.select(F.col(group).alias("group"), F.col(id_col).alias("id"), tokens(F.col(text)).alias("words"))
    terms = sorted(set(asked))

    def times(term: str) -> Column:
        return F.size(F.filter("words", lambda w: w == F.lit(term)))

    counts = [times(t).alias(f"f{i}") for i, t in enumerate(terms)]
    told = told.select("group", "id", F.size("words").alias("len"), *counts)
    stats = told.groupBy("group").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        f, n, df = F.col(f"f{i}").cast("double"), F.col("n").cast("double"), F.col(f"n{i}").cast("double")
        idf = F.ln((n - df + 0.5) / (df + 0.5) + 1.0)
        norm = K1 * (1.0 - B + B * F.col("len") / F.greatest("avg_len", F.lit(1.0)))
        score = score + asked.count(t) * idf * f * (K1 + 1.0) / (f + norm)
    joined = told.join(stats, told["group"].eqNullSafe(stats["group"])).drop(stats["group"])
    return joined.select("group", "id", score.alias("score"))


def best_of(scores: DataFrame) -> DataFrame:
    """The best text of each group; of equal ones the smallest id. Minima only, no sorting of groups."""
    best = scores.groupBy("group").agg(F.max(F.struct("score", (-F.col("id")).alias("back"))).alias("m"))
    return best.select("group", (-F.col("m.back")).alias("id"), F.col("m.score").alias("score"))
