"""Mixing sources to target shares of the tokens, by pivotal dependent rounding.

Each text of a source is to be used c times on average, with c the same for the
whole source; c may have a fraction. The fractions are rounded in pairs: of two
texts one gives a part of its probability to the other, measured in tokens,
until one of both probabilities is 0 or 1; which one gives is drawn so that no
text's probability changes on average. So the tokens of a source stay what they
should be up to a single text. Every task rounds its own texts and leaves one;
the ones left are combined by a tree of further rounds, with a bounded number of
texts in each task, until each source has one left, which is drawn on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.lineage import cut

#: Texts that one task rounds at a time.
FAN_IN = 20_000


def _uniform(seed: int, *parts: int) -> float:
    """A number in [0, 1) that depends on its arguments only, so that a task run again does the same."""
    h = seed & 0xFFFFFFFFFFFFFFFF
    for p in parts:
        h = (h ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
        h = h * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 32
    return h / 2.0**64


def pair(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """One pivotal step: probabilities p, q of texts of sizes a, b; p * a + q * b stays. u: uniform in [0, 1)."""
    up = min((1 - p) * a, q * b)  # tokens that may go to the first text
    down = min(p * a, (1 - q) * b)  # ... and to the second
    if up + down <= 0:
        return p, q
    moved = up if u * (up + down) < down else -down
    p, q = p + moved / a, q - moved / b
    snap = lambda x: 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
    return snap(p), snap(q)


def round_all(ids: list[int], sizes: list[float], chances: list[float], seed: int) -> list[float]:
    """The chances after pairing each text with the one left over so far; at most one is left between 0 and 1."""
    out, left = list(chances), None
    for i, p in enumerate(out):
        if p <= 0.0 or p >= 1.0:
            continue
        if left is None:
            left = i
            continue
        out[left], out[i] = pair(out[left], sizes[left], p, sizes[i], _uniform(seed, ids[left], ids[i]))
        if 0.0 < out[i] < 1.0:
            left = i
        elif not 0.0 < out[left] < 1.0:
            left = None
    return out


def _rounded(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """rows (source, bucket, id, tokens, chance) after rounding within each source and bucket."""

    def work(t: pa.Table) -> pa.RecordBatch:
        ids = t.column("id").to_pylist()
        chances = round_all(ids, t.column("tokens").to_pylist(), t.column("chance").to_pylist(), seed)
        if last:
            chances = [p if p in (0.0, 1.0) else float(_uniform(seed, i, 1) < p) for i, p in zip(ids, chances)]
        flat = t.combine_chunks()
        return pa.RecordBatch.from_arrays([flat.column("source").combine_chunks(), flat.column("id").combine_chunks(), flat.column("tokens").combine_chunks(), pa.array(chances, pa.float64())], names=["source", "id", "tokens", "chance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            group = list(zip(held.column("source").to_pylist(), held.column("bucket").to_pylist()))
            start = 0
            for i in range(1, len(group)):
                if group[i] != group[i - 1]:
                    yield work(held.slice(start, i - start))
                    start = i
            held = held.slice(start)
        if held is not None and held.num_rows:
            yield work(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Texts of like size meet, the largest first, so that the one left over is small; the id settles ties.
    ready = rows.select("source", "bucket", "id", "tokens", "chance").repartition(parts, "source", "bucket").sortWithinPartitions("source", "bucket", F.desc("tokens"), "id")
    return ready.mapInArrow(run, "source string, id long, tokens long, chance double")


def draw(rows: DataFrame, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """id and drawn (0 or 1) of rows (source, id, tokens, chance); tokens > 0, 0 <= chance <= 1."""
    settled, open_rows, level = [], rows, 0
    while True:
        most = open_rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        buckets = -(-most // fan_in)
        bucketed = open_rows.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(max(1, buckets))).cast("int"))
        done = cut(_rounded(bucketed, seed + level, last=buckets <= 1))
        settled.append(done.where("chance in (0.0, 1.0)"))
        if buckets <= 1:
            break
        open_rows, level = done.where("chance not in (0.0, 1.0)"), level + 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("source", "id", F.col("chance").cast("int").alias("drawn"))


def plan(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a listed source: share (of those that can have one), size, most_repeats, goal (tokens) and uses a text.

    Without total_tokens the mix is as large as it can be with every source at
    its share. Sources without tokens can't have a share: their goal is 0, and the
    other shares are taken of what is left. With a total_tokens that a source
    can't fill, it is used as often as it may be.
    """
    sizes = texts.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("n_texts"))
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    rows = rows.where("source is not null").join(sizes, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    usable = (F.col("size") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    totals = rows.agg(F.sum(F.when(usable, F.col("target_share"))).alias("shares"))
    rows = rows.crossJoin(F.broadcast(totals)).withColumn("share", F.when(usable, F.col("target_share") / F.col("shares")).otherwise(0.0)).drop("shares")  # one row on the right
    fits = rows.agg(F.min(F.when(usable, F.col("size") * F.col("max_repeats") / F.col("share"))).alias("fits"))
    total = F.coalesce("fits", F.lit(0.0)) if total_tokens is None else F.lit(float(total_tokens))
    goal = F.least(F.col("share") * total, F.col("size") * F.col("max_repeats") * F.lit(1.0))
    return rows.crossJoin(F.broadcast(fits)).withColumn("goal", goal).drop("fits").withColumn("uses", F.when(F.col("size") > 0, F.col("goal") / F.col("size")).otherwise(0.0))


def distinct_texts(df: DataFrame, id_col: str, text_col: str, source_col: str, tokens: Column) -> DataFrame:
    """source, id, tokens: one row for each text that has tokens, copies folded into the one with the smallest id.

    A text that several sources have belongs to the source of that row, so that
    it is not used more often than this source allows. Copies are told by a
    256-bit hash of the text.
    """
    told = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), tokens.cast("long").alias("tokens"), F.sha2(F.col(text_col), 256).alias("h"))
    first = told.groupBy("h").agg(F.min(F.struct("id", "source", "tokens")).alias("x"))
    return first.select("x.id", "x.source", "x.tokens").where("tokens > 0 and source is not null")


def mix(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """The mix (source, id, tokens, uses) and the report of its shares.

    texts: source, id (unique), tokens (over 0). targets: source, target_share,
    max_repeats. Texts of sources that are not listed are left out. The report
    has each listed source with its target and reached share; an empty table of
    texts gives an empty mix and shares of 0.
    """
    texts = cut(texts.select("source", "id", "tokens"))
    planned = cut(plan(texts, targets, total_tokens))
    # A row a source, as many as there are targets: joined as Spark sees fit.
    wanted = texts.join(planned.where("uses > 0").select("source", F.col("uses").alias("want"), "max_repeats"), "source")
    whole = F.least(F.floor(F.col("want") + 1e-9), F.col("max_repeats"))
    wanted = wanted.withColumn("whole", whole.cast("int")).withColumn("chance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("want") - F.col("whole"))))
    wanted = wanted.withColumn("chance", F.when(F.col("chance") < 1e-9, 0.0).when(F.col("whole") >= F.col("max_repeats"), 0.0).otherwise(F.col("chance")))
    drawn = draw(wanted.where("chance > 0").select("source", "id", "tokens", "chance"), seed, fan_in).select("id", "drawn")
    used = wanted.join(drawn, "id", "left").withColumn("uses", F.col("whole") + F.coalesce("drawn", F.lit(0)))
    mixed = cut(used.where("uses > 0").select("source", "id", "tokens", "uses"))
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"))
    all_tokens = mixed.agg(F.coalesce(F.sum(F.col("tokens") * F.col("uses")), F.lit(0)).alias("all_tokens"))
    report = planned.join(reached, "source", "left").crossJoin(F.broadcast(all_tokens)).select(  # one row on the right
        "source", "target_share", "max_repeats", F.col("n_texts"), F.col("size").alias("source_tokens"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.when(F.col("all_tokens") > 0, F.coalesce("mixed_tokens", F.lit(0)) / F.col("all_tokens")).otherwise(0.0).alias("reached_share"),
    )
    return mixed, report
