import random

import numpy as np

from folioflow.lineage import scratch
from folioflow.llm.components import components
from folioflow.llm.history import WorkIndex, address, _links_in_band
from folioflow.llm.titles import same_words, title


def rows_of(df):
    return sorted((r.id, r.first) for r in df.collect())


BASE = "Sparse Graph Routing for Weakly Fair Lesion Ranking in Urban Alpine Sensor Networks"


def test_addresses():
    same = ["https://arxive.example/abs/1501.02676821v1", "oai:arxive.example:1501.02676821v2", "http://export.arxive.example/pdf/1501.02676821.pdf?x=1"]
    assert {address(u) for u in same} == {"1501.02676821"}
    doi = ["https://www.biorxiv.example/content/10.99999/2015.01.05.048v1.full.pdf", "https://connect.biorxiv.example/content/10.99999%2F2015.01.05.048v3.full.pdf#a"]
    assert {address(u) for u in doi} == {"10.99999/2015.01.05.048"}
    assert [address(u) for u in (None, "", "  ", "https://arxive.example/abs/")] == [None] * 4


def test_titles():
    base = title(BASE)
    for other in (
        "On Weakly Fair Lesion Ranking and Sparse Graph Routing for Urban Alpine Sensor Networks", "$Sparse$ Grpah Routing for weakly fair lesion ranking in Urban Alpine Sensor Nets",
        "[v2] " + BASE.upper(), "Sparse Graph Routing for Weakly Fair Lesion Ranking in Urban Alp...", "Xoqalo: " + BASE,
    ):
        assert same_words(base, title(other)), other
    for other in ("Rethinking " + BASE, f'Comment on "{BASE}"', BASE + ", Part II", BASE + " (Second Edition)", BASE + ": Supplementary Results", BASE.replace("Lesion", "Motif"), "", None):
        assert not same_words(base, title(other)), other


def test_index_finds_repeats_of_earlier_rows_and_earlier_batches(spark):
    index = WorkIndex(spark, scratch(spark, "t"), bucket_rows=40)
    schema = "id long, title string, url string, first string"
    one = [(1, BASE, "https://arxive.example/abs/1501.00001v1", "x"), (2, None, None, "x"), (3, "", "", "x"), (4, "Editorial", None, None), (5, BASE + " ", None, None), (5, BASE + " ", None, None), (None, BASE, None, None)]
    assert set(rows_of(index.ingest(spark.createDataFrame(one, schema), "id", "title", "url"))) == {(5, 1)}
    two = [(6, "Editorial", None, None), (7, "Sparse Grraph Routing for Weakly Fair Lesion Ranknig in Urban Alpine Sensor Networks", None, None), (8, "Something else", "oai:arxive.example:1501.00001v4", None), (9, None, None, None), (10, "Rethinking " + BASE, None, None)]
    again = WorkIndex(spark, index.path, bucket_rows=40)
    assert rows_of(again.ingest(spark.createDataFrame(two, schema), "id", "title", "url")) == [(7, 1), (8, 1)]
    three = [(11, "rethinking " + BASE, None, None), (12, "x" * 100_000, None, None)]
    assert rows_of(again.ingest(spark.createDataFrame(three, schema), "id", "title", "url")) == [(11, 10)]
    assert rows_of(again.ingest(spark.createDataFrame([], schema), "id", "title", "url")) == []


def test_batches_one_by_one_and_at_once_agree(spark, sf_dir):
    papers = spark.read.parquet(f"{sf_dir}/papers.parquet").select("paper_id", "title", "url").orderBy("paper_id").toPandas()
    once = rows_of(WorkIndex(spark, scratch(spark, "t"), 200, fan=2).ingest(spark.createDataFrame(papers), "paper_id", "title", "url"))
    index, parts = WorkIndex(spark, scratch(spark, "t"), 200, fan=2), []
    for at in range(0, len(papers), 60):
        parts += rows_of(index.ingest(spark.createDataFrame(papers[at : at + 60]), "paper_id", "title", "url"))
    assert once == sorted(parts)


def test_hot_keys_are_split_without_changing_the_result(spark, sf_dir):
    rows = [(i, BASE if i % 3 else BASE.replace("Lesion", "Lesoin" if i % 2 else "Lesionn"), None) for i in range(60)] + [(100 + i, f"Other Topic Number {i} on {'x' * i} Words in a Title", None) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, title string, url string")
    plain = rows_of(WorkIndex(spark, scratch(spark, "t"), 200, fan=2).ingest(df, "id", "title", "url"))
    index = WorkIndex(spark, scratch(spark, "t"), 200, hot=1)
    assert rows_of(index.ingest(df.where("id < 30"), "id", "title", "url")) + rows_of(index.ingest(df.where("id >= 30"), "id", "title", "url")) == plain
    assert [a for a, _ in plain] == list(range(1, 60)) and {b for _, b in plain} == {0}


def test_crowds_stay_connected(monkeypatch):
    import folioflow.llm.history as h

    monkeypatch.setattr(h, "LARGE", 5)
    test_links_in_a_band_keep_alike_records_connected()


def test_links_in_a_band_keep_alike_records_connected():
    rng = random.Random(5)
    words = [[rng.randrange(6) for _ in range(4)] for _ in range(60)]
    signatures = [bytes(sorted(set(w))) + b"x" for w in words]
    got = list(_links_in_band(list(range(60)), signatures, [True] * 60))
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    for i in range(60):
        for j in range(i):
            a, b = set(words[i]), set(words[j])
            if len(a & b) / len(a | b) >= 0.5:
                assert find(i) == find(j)


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(None, 3), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_works_joined_by_a_later_row_keep_the_smallest_first(spark):
    other = "Tense Flow Pruning for Fully Blind Motif Planning in Remote Arctic Protein Grids"
    third = "Calm Tree Folding for Partly Noisy Valve Mapping in Coastal Desert Traffic Meshes"
    u, v, w = ("https://arxive.example/abs/1501.0000%d" % k for k in (1, 2, 3))
    rows = [(1, third, w), (2, BASE, u), (3, other, v), (4, BASE, v), (5, other, None), (6, third, u), (7, other, None), (8, None, v)]
    schema = "id long, title string, url string"
    want = [(i, 1) for i in range(2, 9)]
    for cuts in ([8], [3, 4, 6, 8]):
        path, found = scratch(spark, "t"), []
        for lo, hi in zip([0, *cuts], cuts):
            index = WorkIndex(spark, path, 50)
            found.append(index.ingest(spark.createDataFrame(rows[lo:hi], schema), "id", "title", "url"))
        assert rows_of(index.repeats()) == want
        if len(cuts) == 4:  # each call tells the first as it is known by then
            assert [rows_of(f) for f in found] == [[], [(4, 2)], [(5, 1), (6, 1)], [(7, 1), (8, 1)]]


def test_crowds_compare_all_their_records(monkeypatch):
    import folioflow.llm.history as h

    rng = random.Random(9)
    words = [sorted({*range(9), *rng.sample(range(20, 250), 2)}) for _ in range(80)]
    signatures = [bytes(w) for w in words]
    new = [i % 3 > 0 for i in range(80)]
    want = {(i, j) for i in range(80) for j in range(i) if (new[i] or new[j]) and len({*words[i]} & {*words[j]}) / len({*words[i]} | {*words[j]}) >= h.LIKELY}
    for large in (5, 1000):
        monkeypatch.setattr(h, "LARGE", large)
        got = list(_links_in_band(list(range(80)), signatures, new))
        assert len(got) == len(want) and set(got) == want


def test_equal_signatures_of_other_words_hide_no_repeat(spark):
    import xxhash

    from folioflow.llm.titles import code

    def short(t):  # the two bytes that once stood for a title's words beside its set of bytes
        whole = np.array(sorted({code(w) for w in title(t).words}), np.uint32)
        return bytes(sorted(set(whole.astype(np.uint8).tolist()))), xxhash.xxh32_intdigest(whole.tobytes()) & 0xFF

    seen: dict = {}
    rng = random.Random(1)
    while True:
        word = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9))
        key = short(BASE.replace("Lesion", word))
        if key in seen and code(seen[key]) != code(word):
            break
        seen[key] = word
    one, two = BASE.replace("Lesion", seen[key]), BASE.replace("Lesion", word)
    assert not same_words(title(one), title(two))
    rows = [(1, one, None), (2, two, None), (3, two.replace("Graph", "Grpah"), None), (4, two.replace("Sparse", "Spares"), None)]
    df = spark.createDataFrame(rows, "id long, title string, url string")
    assert rows_of(WorkIndex(spark, scratch(spark, "t"), 200, fan=2).ingest(df, "id", "title", "url")) == [(3, 2), (4, 2)]
    assert set(_links_in_band([1, 2, 3], [b"abcde"] * 3, [True] * 3)) == {(2, 1), (3, 1), (3, 2)}


def fresh_rows(n, begin, seed):
    """Rows whose titles share nothing but one in ten, which repeats an earlier one."""
    rng = random.Random(seed)
    out = []
    for i in range(begin, begin + n):
        words = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 8)) for _ in range(8)]
        out.append((i, " ".join(words), None))
    return out


def test_a_batch_reads_as_much_of_a_long_history_as_of_a_short_one(spark):
    """Bytes of the folders that a small batch reads, of keys and of titles, while history grows tenfold."""
    import os

    from pyspark.sql import functions as F

    from folioflow.llm.history import BitMap, profiles

    schema = "id long, title string, url string"
    index = WorkIndex(spark, scratch(spark, "t"), bucket_rows=40, fan=3)
    batch = spark.createDataFrame(fresh_rows(2, 10**6, 99), schema)
    keys = BitMap(profiles(batch, "id", "title", "url").select(F.explode("bands").alias("h")))
    few = BitMap(spark.range(2).select(F.xxhash64("id").alias("h")))

    def read(table, some):
        paths = [p.removeprefix("file:") for p in index._paths(table, some)]
        return sum(os.path.getsize(f"{p}/{f}") for p in paths for f in os.listdir(p) if f.endswith(".parquet"))

    seen = []
    for at, n in enumerate((400, 3600)):
        index.ingest(spark.createDataFrame(fresh_rows(n, at * 400, at), schema), "id", "title", "url")
        seen.append((read("keys", keys), read("keys", None), read("works", few), read("works", None)))
    (k1, all1, w1, titles1), (k2, all2, w2, titles2) = seen
    assert all2 > 6 * all1 and titles2 > 6 * titles1
    assert k2 < 2.5 * k1 and k2 < all2 / 8 and w2 < 4 * max(w1, titles1 / 8)


def test_segments_are_merged_in_tiers_and_results_stay(spark, sf_dir):
    papers = spark.read.parquet(f"{sf_dir}/papers.parquet").select("paper_id", "title", "url").orderBy("paper_id").toPandas()
    whole = WorkIndex(spark, scratch(spark, "t"))
    whole.ingest(spark.createDataFrame(papers), "paper_id", "title", "url")
    index = WorkIndex(spark, scratch(spark, "t"), bucket_rows=100, fan=2)
    for at in range(0, len(papers), 40):
        index.ingest(spark.createDataFrame(papers[at : at + 40]), "paper_id", "title", "url")
    assert len(index.state["keys"]) <= 3 and max(s["tier"] for s in index.state["keys"]) >= 1
    assert rows_of(index.repeats()) == rows_of(whole.repeats())


def test_a_broken_call_leaves_nothing_and_a_named_batch_counts_once(spark, monkeypatch):
    schema = "id long, title string, url string"
    index = WorkIndex(spark, scratch(spark, "t"))
    index.ingest(spark.createDataFrame([(1, BASE, None)], schema), "id", "title", "url", name="one")
    later = spark.createDataFrame([(2, BASE + ".", None), (3, BASE.replace("Graph", "Grpah"), None)], schema)
    with monkeypatch.context() as m:
        m.setattr(WorkIndex, "_commit", lambda *_: 1 / 0)
        try:
            WorkIndex(spark, index.path).ingest(later, "id", "title", "url", name="two")
        except ZeroDivisionError:
            pass
    again = WorkIndex(spark, index.path)
    assert again.repeats().count() == 0 and len(again.state["works"]) == 1
    for _ in range(2):
        assert rows_of(again.ingest(later, "id", "title", "url", name="two")) == [(2, 1), (3, 1)]
    assert len(WorkIndex(spark, index.path).state["works"]) == 2


def test_components_raise_when_rounds_run_out(spark):
    import pytest

    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(path, most_rounds=1)
    assert {r.root for r in components(path).collect()} == {0}


def test_a_batch_takes_few_jobs_and_opens_only_its_share_of_the_folders(spark):
    from folioflow.llm.history import BAND, Stored

    schema = "id long, title string, url string"
    index = WorkIndex(spark, scratch(spark, "t"))
    jobs = []
    for at in range(3):
        rows = fresh_rows(20, at * 20, at) + [(1000 + at, fresh_rows(1, 0, 0)[0][1], None)]
        before = max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
        assert rows_of(index.ingest(spark.createDataFrame(rows, schema), "id", "title", "url")) == [(1000 + at, 0)]
        jobs.append(max(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before)
    assert max(jobs) <= 12, jobs
    wide = WorkIndex(spark, scratch(spark, "t"), bucket_rows=40)
    wide.ingest(spark.createDataFrame(fresh_rows(40, 0, 7), schema), "id", "title", "url")
    stored, keys = Stored(wide.path, wide.state["keys"]), []
    for share in range(4):
        part = [k for t in stored.read(share, 4, ["key"], (BAND,)) for k in t.column("key").to_pylist()]
        assert part and {k & 3 for k in part} == {share}
        keys += part
    assert len(keys) >= 40 * 20
