import glob
import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions.globs import any_path_matches, checked_patterns, glob_match
from folioflow.operators.tex import cleaned

PATTERNS = ["2026/survey", "2026/*", "2026/s?rvey", "2026/**", "**/x", "[ab]*", "[!a]b", "**", "*.txt", "a.b", "archive/**/notes"]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_globs_against_the_standard_library(spark):
    rng = random.Random(1)
    paths = ["", "2026/survey", "2026/survey/", "2026/survey/x", "2026/.x", ".x/x", "x", "file.txt\n", "archive/notes", "archive/a/b/notes"]
    paths += ["".join(rng.choice("ab./2x*\n[") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    for p in PATTERNS:
        rx = re.compile(glob.translate(p, recursive=True, seps="/"))
        assert column(spark, paths, lambda c, p=p: glob_match(c, p)) == [bool(rx.match(x)) for x in paths], p


def test_patterns_are_checked_and_paths_may_be_missing(spark):
    assert checked_patterns(None, "x") is None and checked_patterns(["a"], "x") == ["a"]
    for wrong in ("a", 3, [1], {"a": 1}):
        with pytest.raises(TypeError):
            checked_patterns(wrong, "x")
    df = spark.createDataFrame([(["a/b"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in df.select(any_path_matches(F.col("p"), ["a/*"])).collect()] == [True, False, False]


def test_tex_clean_as_in_python(spark):
    rng = random.Random(2)
    bits = ["%x", "\n", "\\begin{comment}", "\\end{comment}", "\\iffalse", "\\fi", "\\\\", "   ", "\t", "\r", "a", " ", "\x85"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(500)]
    assert column(spark, texts, T.tex_clean) == [cleaned(t) for t in texts]


def test_strip_as_in_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \t\n\xa0 a​") for _ in range(rng.randint(0, 8))) for _ in range(300)] + [None]
    assert column(spark, texts, T.strip) == [None if t is None else t.strip() for t in texts]


def test_display(spark):
    df = spark.createDataFrame([(["a", "b"], 7.04), (list("abcdefg"), None), ([], 6.0), (None, 9.9), (list("abcde"), 6.3)], "n array<string>, s double")
    rows = df.select(T.shown_authors(F.col("n")).alias("a"), T.shown_affiliations(F.col("n")).alias("o"), T.shown_score(F.col("s")).alias("s"), T.stars(F.col("s")).alias("t")).collect()
    assert [r.a for r in rows] == ["a, b", "a, b, c, ..., f, g", "", "", "a, b, c, d, e"]
    assert [r.o for r in rows] == ["a, b", "a, b, c, d, e, ...", "", "Unknown Affiliation", "a, b, c, d, e"]
    assert [r.s for r in rows] == ["7.0", "Unknown", "6.0", "9.9", "6.3"] and [r.t for r in rows] == ["★★★", "", "", "★★★★★", "★"]


def test_names_lists_and_prompts(spark):
    assert column(spark, ["", "a; b;", None], T.split_names) == [[""], ["a", "b", ""], None]
    assert column(spark, ['x ["A", "B", "A"] y', "['A']", "none", '["A"', None], T.listed) == [["A", "B"], None, None, None, None]
    assert column(spark, [None, ""], lambda c: T.summary_prompt(c, c, c)) == ["No text to summarise."] * 2
    assert column(spark, [None, "x"], T.affiliation_prompt)[0] is None
    assert column(spark, ["oai:arXiv.org:1", "1"], T.feed_id) == ["1", "1"]
    assert column(spark, ["Straße A1", None], T.tokens) == [["stra", "e", "a1"], []]
