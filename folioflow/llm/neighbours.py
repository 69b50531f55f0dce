"""The most similar vectors of each query, by an adaptive scan over dimensions.

Vectors are scaled to length one and rotated at random, so that any few of their
dimensions are a fair sample of the whole distance. They are put into lists
around centroids that are fitted on a bounded sample; every vector is in a list.
A query probes its nearest lists. In each the dimensions are read in column
blocks: after a block, a hypothesis test on the partial distance abandons the
candidates that can't be among the k nearest any more, and the next block is
read for the others only. The bound it tests against comes from a first pass
over the query's very nearest lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.lineage import cut

#: Bound of the sample that centroids are fitted on and probes are measured on, and of the lists; each list has 16 rows of the sample at least.
FIT_ROWS, MOST_LISTS = 65_536, 4_096
#: Dimensions of a column block, and the width of the test in standard deviations.
BLOCK, WIDTH = 16, 2.4
#: Lists of the first pass, and the share of true neighbours that the probed lists of a sample hold.
FIRST_LISTS, SHARE = 2, 0.985
#: Vectors of one task; larger lists are split.
TASK_ROWS = 50_000


class Lists(NamedTuple):
    """A fitted index: rotation, centroids (rotated), and how many lists to probe."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def unit(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit rows of the vectors that take part: not null, of `dim` finite numbers, not all zero."""
    at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim and None not in v]
    if not at:
        return np.zeros(0, int), np.zeros((0, dim))
    m = np.array([vectors[i] for i in at], np.float64)
    length = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return np.array(at)[good], m[good] / length[good, None]


def k_means(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Centroids of unit length; an emptied one starts anew at a row drawn at random."""
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        home = nearest_lists(x, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        empty = np.bincount(home, minlength=lists) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = sums / np.where(length > 0, length, 1)
    return centroids


def fit(sample: np.ndarray, k: int, seed: int = 5, n_lists: int | None = None, n_rows: int | None = None) -> Lists:
    """Centroids by k-means on a sample of unit vectors; the probes that 400 rows of it need for SHARE.

    There are as many lists as the root of n_rows, all the rows that will be put
    into them, so a list and the number of lists grow alike. They are fitted at
    two levels: a few groups, and in each as many lists as its share of the rows.
    """
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    if n == 0:
        return Lists(rotation, np.zeros((1, dim)), 1)
    x = (sample @ rotation).astype(np.float32)
    lists = n_lists or max(1, min(MOST_LISTS, n // 16, int(np.sqrt(n_rows or n))))
    groups = k_means(x, max(1, int(np.sqrt(lists))), rng)
    home = nearest_lists(x, groups, 1)[:, 0]
    inner = [k_means(x[home == g], max(1, round(lists * float((home == g).mean()))), rng) for g in range(len(groups)) if (home == g).any()]
    centroids = np.concatenate(inner)
    lists = len(centroids)
    home = nearest_lists(x, centroids, 1)[:, 0]
    tried = rng.choice(n, min(n, 400), replace=False)
    top = np.zeros((len(tried), min(k, max(1, n - 1))), np.int64)
    for at in range(0, len(tried) if n > 1 else 0, 32):  # few rows at a time, so that the driver's memory stays small
        near = x[tried[at : at + 32]] @ x.T
        near[np.arange(len(near)), tried[at : at + 32]] = -2
        top[at : at + 32] = np.argpartition(near, n - top.shape[1], axis=1)[:, n - top.shape[1] :]
    order = nearest_lists(x[tried], centroids, lists)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(lists)[None, :].repeat(len(tried), 0), axis=1)
    needed = np.sort(np.take_along_axis(rank, home[top], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(SHARE * len(needed))))]) + 1
    return Lists(rotation, centroids, min(lists, max(FIRST_LISTS, probes)))


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int, rows: int = 8_192) -> np.ndarray:
    """The n nearest centroids of each row, the nearest first; so many rows at a time are held against all centroids."""
    out = np.empty((len(x), n), np.int64)
    for at in range(0, len(x), rows):
        sims = x[at : at + rows] @ centroids.T
        out[at : at + rows] = sims.argmax(axis=1)[:, None] if n == 1 else np.argsort(-sims, axis=1, kind="stable")[:, :n]
    return out


def scan(queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query position, vector position and squared distance of the k best of each query in one list.

    bounds: the squared distance that a candidate must not exceed. A query's own
    vector is no candidate.
    """
    dim = vectors.shape[1]
    out_q, out_v, out_d = [], [], []
    step = max(1, 4_000_000 // max(1, len(vectors)))
    for lo in range(0, len(queries), step):
        q, own, bound = queries[lo : lo + step], query_ids[lo : lo + step], bounds[lo : lo + step]
        first = min(BLOCK, dim)
        a, b = q[:, :first], vectors[:, :first]
        part = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
        limit = bound * (first / dim) * (1 + WIDTH / np.sqrt(first)) ** 2 if first < dim else bound
        qi, vi = np.nonzero(part <= limit[:, None] + 1e-9)
        d = part[qi, vi]
        at = first
        while at < dim and len(qi):
            to = min(dim, at + BLOCK)
            gap = q[qi, at:to] - vectors[vi, at:to]
            d = d + np.einsum("ij,ij->i", gap, gap)
            limit = bound * (to / dim) * (1 + WIDTH / np.sqrt(to)) ** 2 if to < dim else bound
            keep = d <= limit[qi] + 1e-9
            qi, vi, d, at = qi[keep], vi[keep], d[keep], to
        keep = own[qi] != ids[vi]
        qi, vi, d = qi[keep], vi[keep], d[keep]
        order = np.lexsort((ids[vi], d, qi))
        qi, vi, d = qi[order], vi[order], d[order]
        starts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, int)
        place = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
        keep = place < k
        out_q.append(qi[keep] + lo)
        out_v.append(vi[keep])
        out_d.append(d[keep])
    return np.concatenate(out_q or [np.zeros(0, int)]), np.concatenate(out_v or [np.zeros(0, int)]), np.concatenate(out_d or [np.zeros(0)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scanned(rows: DataFrame, k: int, dim: int) -> DataFrame:
    """query, vec_id, d: the k best of each query in each part of a list. rows: part, role (0 query, 1 vector), id, bound, vec."""

    def work(t: pa.Table) -> pa.RecordBatch:
        role = t.column("role").to_numpy()
        ids = t.column("id").to_numpy()
        v = _matrix(t.column("vec").combine_chunks(), dim)
        asks, has = role == 0, role == 1
        bound = t.column("bound").to_numpy()[asks]
        q, x, d = scan(v[asks], ids[asks], bound, v[has], ids[has], k) if asks.any() and has.any() else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(ids[asks][q], pa.int64()), pa.array(ids[has][x], pa.int64()), pa.array(d, pa.float64())], names=["query", "vec_id", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            part = held.column("part").to_numpy()
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            last = 0
            for c in cuts:
                yield work(held.slice(last, c - last))
                last = int(c)
            held = held.slice(last)
        if held is not None and held.num_rows:
            yield work(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.select("part", "role", "id", "bound", "vec").repartition(parts, "part").sortWithinPartitions("part", "role", "id")
    return ready.mapInArrow(run, "query long, vec_id long, d double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64, id_col: str = "vec_id", vec_col: str = "vec", task_rows: int = TASK_ROWS) -> DataFrame:
    """query, vec_id and similarity of the k vectors most similar to each query by cosine, itself left out.

    queries: a column id_col of ids of vectors; ids that are no vector's, null or
    repeated add nothing. Vectors that are null, all zero, hold NaN or null or
    have not `dim` numbers take no part. Equal similarities go by id. Fewer than k
    other vectors: all of them.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    n = rows.count()
    kept = rows
    if n > 2 * FIT_ROWS:
        kept = rows.where(F.xxhash64("id") < int((1 << 63) * (2 * 1.1 * FIT_ROWS / n) - (1 << 63)))
    drawn = kept.select(F.xxhash64("id").alias("h"), "id", "vec").orderBy("h", "id").limit(FIT_ROWS)
    told = drawn.select("vec").toArrow().column(0)  # at most FIT_ROWS rows
    parts = [unit(told.slice(at, 4_096).to_pylist(), dim)[1].astype(np.float32) for at in range(0, len(told), 4_096)]
    index = fit(np.concatenate(parts) if parts else np.zeros((0, dim), np.float32), k, n_rows=n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m = unit(batch.column(1).to_pylist(), dim)
            x = (m @ index.rotation).astype(np.float32)
            home = nearest_lists(x, index.centroids, 1)[:, 0] if len(at) else np.zeros(0, int)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * dim, pa.int32()), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(home, pa.int32()), vec], names=["id", "list", "vec"])

    placed = cut(rows.mapInArrow(place, "id long, list int, vec array<float>"))
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # one row a list
    splits = {c: -(-m // task_rows) for c, m in sizes.items()}
    most = max(splits.values(), default=1)
    split = F.create_map(*[F.lit(x) for c, s in sorted(splits.items()) for x in (c, s)]) if splits else F.create_map(F.lit(0), F.lit(1))

    def part(c, salt):
        return (c.cast("long") * most + salt).alias("part")

    held = placed.select(part(F.col("list"), F.pmod(F.xxhash64("id"), split[F.col("list")])), F.lit(1).alias("role"), "id", F.lit(0.0).alias("bound"), "vec")
    asked = placed.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id").select("id", "vec")

    def probes(batches: Iterator[pa.RecordBatch], first: int, last: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = nearest_lists(_matrix(batch.column(1), dim), index.centroids, last)[:, first:last]
            at = np.repeat(np.arange(batch.num_rows), order.shape[1])
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(order.ravel(), pa.int32())], names=[*batch.schema.names, "list"])

    def pass_over(ask: DataFrame, first: int, last: int) -> DataFrame:
        spread = ask.mapInArrow(lambda b: probes(b, first, last), "id long, vec array<float>, bound double, list int")
        salts = F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(split[F.col("list")], F.lit(1)) - 1, F.lit(0))))
        sent = spread.select("id", "vec", "bound", "list", salts.alias("salt")).select(part(F.col("list"), F.col("salt")), F.lit(0).alias("role"), "id", "bound", "vec")
        return _scanned(sent.unionByName(held), k, dim)

    best = W.partitionBy("query").orderBy("d", "vec_id")
    near = cut(pass_over(asked.withColumn("bound", F.lit(5.0)), 0, min(FIRST_LISTS, index.probes)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"))
    found = near
    if index.probes > FIRST_LISTS:
        kth = near.groupBy(F.col("query").alias("id")).agg(F.count("*").alias("n"), F.max("d").alias("d")).where(F.col("n") >= k).select("id", F.col("d").alias("known"))
        ask = asked.join(kth, "id", "left").select("id", "vec", F.coalesce("known", F.lit(5.0)).alias("bound"))
        found = near.unionByName(pass_over(ask, FIRST_LISTS, index.probes))
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    return top.select("query", "vec_id", (1 - F.col("d") / 2).alias("similarity"))
