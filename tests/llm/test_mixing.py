import random

import pytest
from pyspark.sql import functions as F

from folioflow.llm.mixing import distinct_texts, draw, mix, pair, round_all


def test_pair_keeps_tokens_and_settles_one():
    rng = random.Random(1)
    for _ in range(2000):
        p, q, a, b = rng.random(), rng.random(), rng.randint(1, 500), rng.randint(1, 500)
        x, y = pair(p, a, q, b, rng.random())
        assert x * a + y * b == pytest.approx(p * a + q * b, abs=1e-5)
        assert x in (0.0, 1.0) or y in (0.0, 1.0)


def test_chances_are_kept_on_average():
    sizes, chances = [30, 500, 70, 20, 200, 90], [0.3, 0.5, 0.8, 0.25, 0.6, 0.1]
    n, sums = 4000, [0.0] * 6
    for seed in range(n):
        for i, p in enumerate(round_all(list(range(6)), sizes, chances, seed * 7919)):
            sums[i] += p
    assert all(s / n == pytest.approx(c, abs=0.04) for s, c in zip(sums, chances))


def test_tree_keeps_the_tokens_of_a_source(spark):
    rng = random.Random(4)
    rows = [("hot", i, rng.randint(5, 60), 0.37) for i in range(3000)] + [("small", 10_000 + i, 7, 0.5) for i in range(3)]
    df = spark.createDataFrame(rows, "source string, id long, tokens long, chance double")
    got = draw(df, fan_in=50).join(df.drop("source"), "id").groupBy("source").agg(F.sum(F.col("drawn") * F.col("tokens")).alias("t"), F.count("*").alias("n"))
    by = {r.source: r for r in got.collect()}
    assert by["hot"].n == 3000 and abs(by["hot"].t - 0.37 * sum(r[2] for r in rows[:3000])) <= 60
    assert by["small"].n == 3 and by["small"].t in (7, 14)


def test_shares_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, "text %d" % i, s, rng.randint(1, 40)) for s, n in (("a", 900), ("b", 150), ("c", 40), ("unlisted", 50)) for i in range(n) for i in [hash((s, i)) % 10**12]]
    texts = spark.createDataFrame([(s, i, t) for i, _, s, t in rows], "source string, id long, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 3), (None, 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed, report = mix(texts, targets)
    by = {r.source: r for r in report.collect()}
    assert set(by) == {"a", "b", "c", "none"} and by["none"].reached_share == 0
    for s, share, most in (("a", 5 / 9, 1), ("b", 3 / 9, 2), ("c", 1 / 9, 4)):
        assert by[s].reached_share == pytest.approx(share, abs=0.02) and by[s].most_uses <= most
    assert max(r.reached_share / s for r, s in ((by["a"], 5 / 9), (by["b"], 3 / 9))) < 1.05
    assert mixed.where("uses < 1").count() == 0
    forced, _ = mix(texts, targets, total_tokens=10**9)
    assert {(r.source, r.u) for r in forced.groupBy("source").agg(F.min("uses").alias("u")).collect()} == {("a", 1), ("b", 2), ("c", 4)}


def test_copies_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x y", "a", 9), (2, "x y", "b", 9), (3, None, "a", 9), (4, "", "a", 9), (5, "z", None, 9), (None, "q", "a", 9)], "id long, text string, source string, tokens int")
    rows = distinct_texts(df, "id", "text", "source", F.length("text")).collect()
    assert [(r.id, r.source, r.tokens) for r in rows] == [(1, "a", 3)]
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    texts = spark.createDataFrame([], "source string, id long, tokens long")
    mixed, report = mix(texts, targets)
    assert mixed.count() == 0 and [r.reached_share for r in report.collect()] == [0.0]
    assert mix(texts, targets.limit(0))[1].count() == 0


def test_very_uneven_sizes_stay_within_one_text():
    """Whatever the sizes, the tokens drawn differ from the goal by less than the text that is left over, and chances hold on average."""
    import random

    from folioflow.llm.mixing import round_all

    rng = random.Random(8)
    for trial in range(60):
        sizes = sorted((float(int(rng.paretovariate(0.9))) for _ in range(200)), reverse=True)
        chances = [rng.choice((0.1, 0.37, 0.9))] * 200
        out = round_all(list(range(200)), sizes, chances, seed=trial)
        left = [i for i, p in enumerate(out) if 0 < p < 1]
        assert len(left) <= 1
        settled = sum(s * p for s, p in zip(sizes, out))
        assert abs(settled - sum(s * p for s, p in zip(sizes, chances))) < 1e-6 * sum(sizes)
    drawn = [round_all([0, 1, 2], [5.0, 50.0, 1000.0], [0.3, 0.3, 0.3], seed=s) for s in range(6000)]
    for k in range(3):
        assert abs(sum(d[k] for d in drawn) / len(drawn) - 0.3) < 0.03
