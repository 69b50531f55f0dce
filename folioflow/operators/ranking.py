"""Scoring candidates by their likeness to a library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Library rows of one block; a block's matrix is held by a task.
BLOCK_ROWS = 20_000
DEFAULT_TOPK = 10
#: Lists of bests that are merged into one at a time.
FAN_IN = 64


def resolve_topk(value: object) -> int:
    """The number of neighbours a score is made of: at least 1, and the default for what is no number."""
    try:
        return max(1, int(value))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return DEFAULT_TOPK


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit rows of the vectors that have a direction."""
    rows = column.to_pylist()
    dim = max((len(r) for r in rows if r), default=0)
    at = [i for i, r in enumerate(rows) if r and len(r) == dim and None not in r]
    m = np.array([rows[i] for i in at], np.float64).reshape(len(at), dim)
    n = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(n) & (n > 0)
    return np.array(at, int)[good], m[good] / n[good, None]


def valid_vectors(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector has `dim` finite numbers that are not all zero."""
    square = F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.where(F.size(vec) == dim).withColumn("__sq", square).where(F.col("__sq").isNotNull() & ~F.isnan("__sq") & (F.col("__sq") > 0) & (F.col("__sq") < float("inf"))).drop("__sq")


def _mean_of_all(good: DataFrame, base: DataFrame, n: int, dim: int, scale: float) -> DataFrame:
    """id and score where all n library rows count: a mean of cosines is the product with the mean of the unit rows, so no cosine is listed."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for batch in batches:
            total += _unit_rows(batch.column(0))[1].reshape(-1, dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = base.mapInArrow(sums, "s array<double>")
    mean = np.array(parts.agg(*[F.sum(F.col("s")[i]) for i in range(dim)]).first()) / n  # one row of `dim` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, x = _unit_rows(batch.column(2))
            chosen = pa.array(pos)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(x.reshape(-1, dim) @ mean * scale)], names=["id", "told", "score"])

    scores = good.select("id", "told", "vec").mapInArrow(run, "id long, told long, score double")
    return scores.groupBy("id", "told").agg(F.min("score").alias("score")).select("id", "score")


def topk_mean(candidates: DataFrame, library: DataFrame, k: int = DEFAULT_TOPK, dim: int = 64, scale: float = 10.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id and score of every candidate: the mean of its k largest cosines to the library, times `scale`.

    candidates: id, vec; library: vec. The library is cut into blocks; every
    candidate meets every block in one matrix product, of which its k best are
    kept, and the blocks' bests are merged. With k library rows or fewer all count,
    by their mean direction. An empty library gives the score 0. Candidates or library rows without
    a direction (null, zero, NaN, another length) are left out. Rows with one id
    and different vectors are different candidates, each with its score; rows
    equal in both are one.
    """
    good = valid_vectors(candidates.select("id", "vec"), "vec", dim).withColumn("told", F.xxhash64("vec"))
    base = valid_vectors(library.select("vec"), "vec", dim)
    n = base.count()
    if n == 0:
        return good.select("id", "told").distinct().select("id", F.lit(0.0).alias("score"))
    if n <= k:
        return _mean_of_all(good, base, n, dim, scale)
    blocks = -(-n // block_rows)
    # Blocks are dealt out by row number, so that many copies of a vector don't meet in one block.
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")
    held = base.select(dealt.alias("block"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("id"), "vec", F.lit(None).cast("long").alias("told"))
    # Candidates are spread over tasks; a task has one block and a share of the candidates.
    shares = max(1, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    asked = good.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("role"), "id", "vec", "told")
    sent = held.select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "role", "id", "vec", "told").unionByName(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, matrix = None, [], None
        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            role = batch.column(2).to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]).any(1) | (role[1:] != role[:-1])) + 1
            for lo, hi in zip(np.r_[0, change], np.r_[change, len(role)]):
                part = batch.slice(int(lo), int(hi - lo))
                here = tuple(key[lo])
                if here != at:
                    at, rows, matrix = here, [], None
                if role[lo] == 0:
                    rows.append(_unit_rows(part.column(4))[1])
                    matrix = None
                    continue
                if matrix is None:
                    matrix = np.concatenate(rows) if rows else np.zeros((0, dim))
                if not len(matrix):
                    continue
                pos, x = _unit_rows(part.column(4))
                for start in range(0, len(pos), 256):
                    sims = x[start : start + 256] @ matrix.T
                    m = min(k, sims.shape[1])
                    top = np.sort(np.partition(sims, sims.shape[1] - m, axis=1)[:, -m:], axis=1)[:, ::-1]
                    chosen = pa.array(pos[start : start + 256])
                    ids, told = part.column(3).take(chosen), part.column(5).take(chosen)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * m, pa.int32()), pa.array(top.ravel()))
                    yield pa.RecordBatch.from_arrays([ids, told, pa.array(np.full(len(ids), here[0]), pa.int32()), lists], names=["id", "told", "block", "best"])

    best = sent.repartition(blocks * shares, "block", "share").sortWithinPartitions("block", "share", "role").select("block", "share", "role", "id", "vec", "told").mapInArrow(run, "id long, told long, block int, best array<double>")
    # The blocks' bests are merged in a tree of FAN_IN lists a step; a list never has more than FAN_IN * k numbers.
    keep = F.slice(F.sort_array("best", False), 1, k)
    groups = blocks
    while True:
        groups = -(-groups // FAN_IN)
        merged = best.withColumn("block", F.pmod("block", F.lit(groups))).groupBy("id", "told", "block")
        best = merged.agg(F.flatten(F.collect_list("best")).alias("best")).withColumn("best", keep)
        if groups == 1:
            break
    total = F.aggregate("best", F.lit(0.0), lambda a, x: a + x)
    return best.select("id", (total / F.size("best") * scale).alias("score"))


def top_n(scores: DataFrame, n: int) -> DataFrame:
    """The first n by score and then id, with their rank: a report of n rows."""
    first = scores.orderBy(F.desc("score"), "id").limit(n)
    return first.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
