"""Connected components of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.lineage import cut


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and those have none."""
    ends = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.lit(None).cast(edges.schema["v"].dataType).alias("m")))
    seen = ends.groupBy("n").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count_if(F.col("m").isNull()).alias("roots"))
    return seen.where("lo <> hi or (lo is not null and roots > 0)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """node and root, the smallest node of its component, for every node of the links.

    Links are two columns of one type, in any direction, repeated or not; null
    ends and links of a node to itself are ignored. Each round links the
    neighbours of a node to the smallest one (larger ones first, then smaller
    ones), which keeps every component connected and turns it into a star in a
    number of rounds that grows with the logarithm of its size. A hub's
    neighbours are never gathered: only minima are, with partial sums ahead of
    the shuffle. Every round is written to the checkpoint folder. It ends when
    all components are stars; should they not be after most_rounds, far more than
    any graph needs, it raises an error rather than return a part.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        if _stars(edges):
            break
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
    else:
        if not _stars(edges):
            raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
