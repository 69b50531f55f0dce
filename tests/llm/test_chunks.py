import random

from folioflow.llm.chunks import chunk, codes, cuts, longest_run, rolling
from folioflow.llm.queries_chunks import ORACLE, p5_found

LIMITS = [("a", 100, 10), ("b", 40, 0), ("c", 50, 80)]


def text(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(("word ", "longer ", "end. ", "Aé漢 ", "x", "stop! ", "\n\n")) for _ in range(n))


def test_pieces_cover_the_text_and_overlap():
    for seed in range(60):
        t = text(400, seed)
        for most, overlap in ((100, 10), (57, 0), (200, 60), (30, 29)):
            pieces = cuts(t, most, overlap)
            assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
            for (b, e, natural), (b2, e2, _) in zip(pieces, pieces[1:]):
                assert b2 == e - overlap and e2 > e
                assert not natural or t[e - 1].isspace() or t[e - 1] in ".!?;。！？；"
            assert all(0 < e - b <= most for b, e, _ in pieces)


def test_forced_cuts_and_runs():
    assert longest_run(codes("ab cde.f")) == 3 and longest_run(codes("")) == 0
    pieces = cuts("x" * 1000, 100, 10)
    assert not any(nat for _, _, nat in pieces[:-1]) and all(e - b <= 100 for b, e, _ in pieces)
    assert cuts("", 10, 1) == [] and cuts("abc", 10, 1) == [(0, 3, True)]


def test_an_edit_leaves_far_cuts_alone():
    t = text(3000, 7)
    edited = t[:500] + "new words here " + t[500:]
    ends = {e - len(t) for _, e, _ in cuts(t, 300, 30)}
    after = {e - len(edited) for _, e, _ in cuts(edited, 300, 30)}
    assert len(ends & after) > 0.6 * len(ends)


def test_rolling_hash_depends_on_its_window_only():
    a, b = codes("q" * 50 + text(40, 1)), codes(text(40, 1))
    assert (rolling(a)[-40:] == rolling(b)[-40:]).all()


def test_chunk_edge_cases(spark):
    limits = spark.createDataFrame(LIMITS, "source string, max_chars int, overlap_chars int")
    rows = [(1, "a", None, 0), (2, "a", "", 0), (3, "a", "y" * 100, 0), (4, "a", "w " * 60, 0), (4, "a", "w " * 60, 0), (5, "zz", "w " * 600, 0), (6, None, "w " * 600, 0), (7, "b", "é" * 90, 0), (8, "c", "w. " * 40, 0)]
    df = spark.createDataFrame(rows, "id long, source string, t string, piece int")
    got = chunk(df, limits, "id", "t", "source").collect()
    assert {r.id for r in got} == {4, 7, 8} and {r.cut for r in got if r.id == 7} == {"forced"} and all(len(r.piece) == r.end - r.begin for r in got)
    assert sum(r.piece_no == 1 for r in got if r.id == 4) == 2
    assert chunk(df.limit(0), limits, "id", "t", "source").count() == 0


def test_query_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("papers", "chunk_limits"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = sorted(con.execute(ORACLE["p5_found"]).fetchall())
    assert sorted((r.paper_id, r.cut) for r in p5_found(spark, sf_dir).collect()) == want and want


def test_sizes_are_held_on_whole_texts(spark):
    """No piece is over the most; none is under the least where a boundary or landmark lies between the sizes."""
    from folioflow.llm.chunks import LEAST, cuts

    rows = spark.read.parquet("/root/testdata/sf0.01/papers.parquet").where("length(full_text) > 2000").select("full_text").collect()
    for r in rows:
        for most, overlap in ((2000, 100), (700, 0)):
            got = cuts(r.full_text, most, overlap)
            assert all(e - b <= most for b, e, _ in got) and got[-1][1] == len(r.full_text)
            own = [e - p for (_, p, _), (_, e, _) in zip(got, got[1:])]
            short = [x for x in own if x < int((most - overlap) * LEAST) - overlap]
            assert len(short) <= 0.02 * len(own) + 1


def test_cuts_after_a_common_cut_are_the_same(spark):
    """An edit changes cuts until one falls on the same place again; from there on, but for the end, all are the same."""
    from folioflow.llm.chunks import cuts

    rows = spark.read.parquet("/root/testdata/sf0.01/papers.parquet").where("length(full_text) > 6000").select("full_text").limit(40).collect()
    for r in rows:
        text = r.full_text
        edited = text[:1500] + "An inserted sentence. " + text[1500:]
        one, two = [e for _, e, _ in cuts(text, 1000, 50)], [e - 22 for _, e, _ in cuts(edited, 1000, 50)]
        common = [e for e in one if e > 1500 and e in two]
        if common:
            a, b = [e for e in one if e >= common[0]], [e for e in two if e >= common[0]]
            assert a[:-2] == b[: len(a) - 2]
