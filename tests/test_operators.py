import io
import math
import random
import tarfile

import numpy as np
import pytest

from folioflow.operators import corpus, feeds
from folioflow.operators.bm25 import best_of, bm25
from folioflow.operators.pages import page_text
from folioflow.operators.pinning import pin, resolve_cap, resolve_keywords
from folioflow.operators.ranking import resolve_topk, top_n, topk_mean
from folioflow.operators.tex import best_match, main_text


def vectors(spark, rows, kind="id long, vec array<float>"):
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize("k, block", [(1, 1000), (3, 7), (50, 7)])
def test_topk_mean_against_numpy(spark, k, block):
    rng = np.random.default_rng(k)
    a, b = rng.standard_normal((40, 8)).astype(np.float32), rng.standard_normal((23, 8)).astype(np.float32)
    got = {r.id: r.score for r in topk_mean(vectors(spark, [(i, v.tolist()) for i, v in enumerate(a)]), vectors(spark, [(v.tolist(),) for v in b], "vec array<float>"), k, dim=8, block_rows=block).collect()}
    u, w = a.astype(float), b.astype(float)
    sims = np.sort(u @ w.T / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(w, axis=1)[None], axis=1)[:, ::-1][:, :k]
    assert got == pytest.approx(dict(enumerate(sims.mean(axis=1) * 10)))


def test_topk_mean_edge_cases(spark):
    some = vectors(spark, [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0])])
    assert [(r.id, r.score) for r in topk_mean(some, some.select("vec").where("false"), dim=2).collect()] == [(1, 0.0)]
    assert [(r.id, r.score) for r in topk_mean(some, some.select("vec"), dim=2).collect()] == [(1, 10.0)]
    assert topk_mean(some.where("false"), some.select("vec"), dim=2).count() == 0
    scores = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 3.0)], "id long, score double")
    assert [(r.id, r["rank"]) for r in top_n(scores, 2).collect()] == [(2, 1), (3, 2)]
    assert [resolve_topk(x) for x in (None, "7", "x", 0, -3, 2.9)] == [10, 7, 10, 1, 1, 2]


def sequential(rows, cap, n, overflow):
    """The digest's order, said step by step."""
    best = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    hits = [r for r in best if r[2]]
    pinned, over = hits[:cap], hits[cap:]
    rest = over + [r for r in best if not r[2]] if overflow == "compat" else [r for r in best if r not in pinned]
    rest = rest[:n]
    top = [r for r in best if r in pinned or (overflow == "compat" and r[2] and r in rest)]
    return [r[0] for r in top + [r for r in best if r in rest and r not in top]]


@pytest.mark.parametrize("overflow", ["compat", "by_score"])
@pytest.mark.parametrize("cap, n", [(5, 12), (0, 8), (30, 0)])
def test_pinning_step_by_step(spark, overflow, cap, n):
    rng = random.Random(cap)
    rows = [(i, rng.choice([None, round(rng.random(), 1), 3.0]), rng.random() < 0.4) for i in range(60)]
    got = pin(spark.createDataFrame(rows, "id long, score double, m boolean"), "m", cap, n, overflow).orderBy("position")
    assert [r.id for r in got.collect()] == sequential(rows, cap, n, overflow)


def test_keywords_and_caps():
    assert resolve_keywords([" A ", "", "  ", "b"]) == ["a", "b"]
    assert resolve_keywords(None) == [] and [resolve_cap(x) for x in (None, "x", -2, "3", 0)] == [20, 20, 0, 3, 0]


def test_collections(spark):
    rows = [("a", "A", "false"), ("b", "B", "a"), ("c", None, "b"), ("d", "D", "gone"), ("x", "X", "y"), ("y", "Y", "x"), (None, "N", "a")]
    paths = corpus.collection_paths(spark.createDataFrame(rows, "collection_key string, collection_name string, parent_collection string"))
    assert {r.collection_key: r.path for r in paths.collect()} == {"a": "A", "b": "A/B", "c": "A/B/", "d": "D"}
    items = spark.createDataFrame([(1, ["b", "a", "zz"], "k"), (2, [], "k"), (3, None, "k")], "id long, c array<string>, collection_key string")
    assert {r.id: r.paths for r in corpus.with_paths(items, "c", paths, "id").collect()} == {1: ["A/B", "A"], 2: [], 3: []}
    library = spark.createDataFrame([(1, ["a/b"], "x"), (2, [], ""), (3, None, " "), (4, ["a/b", "c"], None)], "id long, paths array<string>, abstract string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(corpus.filter_paths(library, ["a/*"])) == [1, 4] and ids(corpus.filter_paths(library, None, ["c"])) == [1, 2, 3]
    assert ids(corpus.filter_paths(library, ["a/*"], ["c"])) == [1] and ids(corpus.filter_paths(library, [], [])) == [1, 2, 3, 4]
    assert ids(corpus.with_abstract(library)) == [1, 3]


def test_feeds(spark):
    df = spark.createDataFrame([(1, "new", "2026-01-01", "a"), (2, "cross", "2026-01-02", "b"), (3, None, "2026-01-02", "A"), (4, "replace", None, "a")], "id long, t string, d string, c string")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(feeds.announced(df, "t")) == [1, 3] and ids(feeds.announced(df, "t", True)) == [1, 2, 3]
    assert ids(feeds.latest(df, "d")) == [2, 3] and ids(feeds.latest(df.where("false"), "d")) == []
    assert ids(feeds.in_categories(df, "c", ["A", "b"])) == [1, 2, 4] and ids(feeds.in_categories(df, "c", [])) == []
    with pytest.raises(ValueError):
        feeds.in_categories(df, "c", None)
    with pytest.raises(ValueError):
        feeds.united()
    assert [(r.source_no, r.id) for r in feeds.united(("x", df.limit(1)), ("y", df.limit(1))).orderBy("source_no").collect()] == [(0, 1), (1, 1)]


def test_bm25_against_a_scalar_version(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(0, 12))) for i in range(30)}
    df = spark.createDataFrame([(i, "g" if i % 2 else None, t) for i, t in texts.items()], "id long, grp string, t string")
    query = "Alpha beta, alpha"
    got = {r.id: r.score for r in bm25(df, "grp", "id", "t", query).collect()}
    for part in (0, 1):
        own = {i: t.split() for i, t in texts.items() if i % 2 == part}
        mean = max(1, sum(map(len, own.values())) / len(own))
        for i, ws in own.items():
            want = 0.0
            for q in ("alpha", "beta", "alpha"):
                n, f = sum(q in w for w in own.values()), ws.count(q)
                want += math.log((len(own) - n + 0.5) / (n + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ws) / mean))
            assert got[i] == pytest.approx(want)
    assert {r.score for r in bm25(df, "grp", "id", "t", "").collect()} == {0.0}
    assert {r.group: r.id for r in best_of(bm25(df, "grp", "id", "t", "")).collect()} == {None: 0, "g": 1}


def packed(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_tex_archives():
    doc = rb"\begin{document}Hello \input{part} \include{part}\end{document}"
    assert main_text(None) == (None, None) and main_text(b"no tar") == (None, None) and main_text(packed({"a.txt": b"x"})) == (None, None)
    assert main_text(packed({"only.tex": b"a % c\nb"})) == ("only.tex", "a \nb")
    path, text = main_text(packed({"main.tex": doc, "part.tex": b"PART", "main.bbl": b"", "other.tex": doc}))
    assert path == "main.tex" and "Hello PART" in text and "\\include{part}" in text
    assert main_text(packed({"sample.tex": doc, "x.tex": doc, "y.tex": b"z"}))[0] == "x.tex"
    two = packed({"a.tex": rb"\begin{document}cats\end{document}", "b.tex": rb"\begin{document}dogs bark\end{document}"})
    assert main_text(two, "Why dogs bark")[0] == "b.tex" and main_text(two)[0] == "a.tex"
    assert main_text(packed({"a.tex": b"x", "b.tex": b"y"})) == (None, None)
    assert main_text(packed({"main.tex": b"\xff\xfe" + doc}))[0] == "main.tex"
    assert best_match({"x": "a", "y": "b"}, "") == "x"


def test_pages():
    html = "<html><head><script>no</script></head><body><h1>Hi</h1><p>a <b>b</b>&amp;c</p><table><tr><td>t</td></tr></table></body>"
    assert page_text(html) == "Hi\na b&c" and page_text(None) is None and page_text("<p> </p>") is None


def test_score_is_the_same_for_any_size_of_blocks(spark):
    """Rows of one id with different vectors, repeated rows and many blocks, merged in more than one step."""
    import numpy as np

    from folioflow.operators import ranking

    rng = np.random.default_rng(4)
    rows = [(i % 9, [float(x) for x in rng.standard_normal(4)]) for i in range(12)]
    cand = spark.createDataFrame([*rows, rows[0]], "id long, vec array<double>")
    library = spark.createDataFrame([([float(x) for x in rng.standard_normal(4)],) for _ in range(70)], "vec array<double>")
    got = [sorted((r.id, round(r.score, 9)) for r in ranking.topk_mean(cand, library, 5, 4, block_rows=n).collect()) for n in (1000, 30, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 12
    assert len(ranking.topk_mean(cand, library.where("false"), 5, 4).collect()) == 12


def test_a_score_over_the_whole_library_lists_no_cosines(spark):
    """Where k reaches the library's size, lists of its length for each candidate would go through the shuffle."""
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((30, 4)), rng.standard_normal((25, 4)) * 3
    rows = [(i // 2, v.tolist()) for i, v in enumerate(a)]
    library = vectors(spark, [(v.tolist(),) for v in b] + [([0.0] * 4,), (None,)], "vec array<double>")
    want = sorted((i // 2, round(float((b @ v / np.linalg.norm(v) / np.linalg.norm(b, axis=1)).mean() * 10), 9)) for i, v in enumerate(a))
    for k, lists in ((25, False), (1000, False), (24, True)):
        scores = topk_mean(vectors(spark, [*rows, rows[0], (99, None)], "id long, vec array<double>"), library, k, dim=4, block_rows=7)
        assert ("collect_list" in scores._jdf.queryExecution().optimizedPlan().toString()) == lists
        if not lists:
            assert sorted((r.id, round(r.score, 9)) for r in scores.collect()) == want
