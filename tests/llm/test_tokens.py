import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.llm.queries_tokens import QUERIES
from folioflow.llm.tokens import PATTERN, MergeAutomaton, decode_ids, encode_corpus, encoder, merged, read_ranks, rules, token_count, vocabulary_path

PATH = vocabulary_path()
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no vocabulary file")


def toy(seed: int, size: int = 60) -> dict[bytes, int]:
    """A random vocabulary over three letters, in which each token is made by a single merge."""
    rng = random.Random(seed)
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
    while len(ranks) < size:
        token = rng.choice(list(ranks)) + rng.choice(list(ranks))
        if token not in ranks and len(merged(token, ranks, 1 << 30)) == 2:
            ranks[token] = len(ranks)
    return ranks


def gadgets(ranks: dict[bytes, int]) -> dict[int, set[int]]:
    """The arcs of every state, laid out at once by the three steps of each gadget."""
    single = [i for b, i in ranks.items() if len(b) == 1]
    arcs = {s: set(single) for s in single}
    for u, v, w in rules(ranks):
        copy = set(arcs[v])
        arcs[u].discard(v)
        arcs[w] = copy
        for s in arcs:
            if u in arcs[s]:
                arcs[s].add(w)
    return arcs


@pytest.mark.parametrize("seed", range(12))
def test_table_has_the_arcs_that_the_gadgets_make(seed):
    ranks = toy(seed)
    table, arcs = MergeAutomaton(ranks), gadgets(ranks)
    assert {(s, t) for s in arcs for t in arcs if table.arc(s, t)} == {(s, t) for s, ts in arcs.items() for t in ts}


@pytest.mark.parametrize("seed", range(4))
def test_automaton_against_definition_on_a_toy_vocabulary(seed):
    rng, ranks = random.Random(seed), toy(seed, 40)
    automaton = MergeAutomaton(ranks)
    for _ in range(700):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25)))
        assert automaton.encode_bytes(word) == [ranks[p] for p in merged(word, ranks, 1 << 30)]
    with pytest.raises(ValueError):
        automaton.encode_bytes(b"abd")


def test_table_is_bounded_and_does_not_grow_with_use():
    a = encoder(PATH).automaton
    assert len(a.row) == len(a.labels) and len(set(a.row.values())) < len(a.row) and len(a.bounds) < 20 * len(a.row)
    before = (len(a.bounds), len(a.row), len(a.go))
    for t in ("zq" * 5000, "Unheard-of wordings, 1234567!"):
        encoder(PATH).encode(t)
    assert (len(a.bounds), len(a.row), len(a.go)) == before


def test_encoder_against_the_public_library():
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    e, rng = encoder(PATH), random.Random(1)
    texts = ["".join(rng.choice("abetrh  aaaoon.,1290\n\t-='éß漢😀") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    for t in [*texts, " " * 3000, "a" * 3000, "<|endoftext|>", "it's we'll  I'D"]:
        assert e.encode(t) == other.encode_ordinary(t)
        assert e.automaton.decode(e.encode(t)) == t


def test_nulls_empty_clashing_names_and_round_trip(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "Grüße, 漢字! " * 2000, "x"), (4, "again", None)], "id int, text string, ids string")
    out = encode_corpus(df, "text")
    rows = {(r.id, r.text): r for r in out.withColumn("back", decode_ids("ids", PATH)).withColumn("n", token_count(F.col("text"), PATH)).collect()}
    assert len(rows) == 5 and out.columns == ["id", "text", "ids"]
    for (_, text), r in rows.items():
        assert r.back == (text or "") and r.n == len(r.ids)
    assert encode_corpus(df.limit(0), "text").count() == 0


def test_query_has_one_row_a_document(spark, sf_dir):
    got = QUERIES["p8_ids"](spark, sf_dir)
    assert got.columns == ["doc_id", "ids"]
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.where("ids is null").count() == 0
