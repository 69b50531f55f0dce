import random

import pytest

from folioflow.llm.defects import LABELS, broken, copied_share, core, find_defects, train
from folioflow.llm.queries_defects import p1_found

KINDS = ["graphs", "panels", "grids", "cohorts", "archives"]
STARTS = ["Shows that pruning improves ranking over {k}.", "Survey of {n} papers on ranking which concludes that {k} remain under-studied", "Introduces a method that makes planning on {k} robust.", 'Studies when agents say "I can\'t help" over {k}.', "By pruning the models early, ranking on {k} takes {n} hours less."]


def pairs(n: int, seed: int):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice(KINDS)
        prompt = f"We study ranking of sample {i} for {k}. The error falls from {rng.randint(20, 90)} to {rng.randint(2, 19)} percent. Code for run {i} is out now."
        if i % 9 == 0:
            prompt = f"Die Arbeit stellt ein Verfahren für {k} vor, das ohne weitere Daten auskommt. Auf {i} Sätzen sinkt der Fehler deutlich."
        out.append((f"Ranking of {k} number {i}", prompt, rng.choice(STARTS).format(k=k, n=rng.randint(2, 60))))
    return out


@pytest.fixture(scope="module")
def model():
    return train(pairs(800, 1))


def test_labels_are_stripped():
    assert core("**Summary:** It works.") == "It works." and core("<summary></summary>") == "" and core("TL;DR: \n") == ""
    assert core("Summary statistics suffice.") != ""


def test_copied_share():
    text = "We study ranking of graphs. The error falls from 20 to 3 percent."
    assert copied_share("THE ERROR FALLS from 20 to 3 percent", text) == 1.0
    assert copied_share("The eror falls from 20 to 3 percent", text) > 0.6
    assert copied_share("Nothing of this is said in the text.", text) < 0.3 and copied_share("x", None) == 0.0


def test_held_out_accuracy(model):
    made = broken(pairs(200, 2), random.Random(3))
    got = model.defects([x for x, _ in made])
    right = sum((not d and g is None) or (g in d) for (_, d), g in zip(made, got))
    assert right / len(made) > 0.9
    sound = [g for (_, d), g in zip(made, got) if not d]
    assert sum(g is None for g in sound) / len(sound) > 0.93


def test_edge_cases(spark, model):
    from folioflow.llm.defects import flag

    rows = [(1, None, None, "", "x"), (2, None, None, None, "x"), (3, "", "", " \n", "x"), (4, "t", None, "I'm sorry, but I can't help with that.", "x"), (4, "t", None, "I'm sorry, but I can't help with that.", "x"), (5, "t", "p", "word " * 50_000 + "end.", "x"), (6, None, None, "农村地区至今缺少合适的参考值。我们证明估计结果依然可靠。", "x")]
    df = spark.createDataFrame(rows, "id long, title string, prompt string, response string, defect string")
    got = sorted((r.id, r.defect) for r in flag(df, model).collect() if r.id != 5)
    assert got == [(1, "empty"), (3, "empty"), (4, "refusal"), (4, "refusal"), (6, "other_language")]
    assert find_defects(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    got = p1_found(spark, sf_dir).collect()
    assert {r.defect for r in got} <= set(LABELS)


def test_all_words_of_a_response_are_features():
    from folioflow.llm.defects import features

    topic = " ".join(f"word{i}" for i in range(40))
    one, two = (set(features(None, None, f"{topic} {said} at all.", known=frozenset())) for said in ("nothing was provided", "results were printed"))
    assert len(one - two) >= 4 and len(two - one) >= 4


def test_refusals_share_no_sentence_with_the_tables(spark):
    """What the classifier learns refusals from is none of the tables' own wording."""
    import random

    from folioflow.llm.defects import _SENTENCE, core, refusal

    said = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/papers.parquet").where("tldr is not null").select("tldr").collect()]
    theirs = {s.strip().lower() for x in said for s in _SENTENCE.split(core(x)) if len(s.split()) > 2}
    rng = random.Random(1)
    made = {refusal("graph models here", rng) for _ in range(10_000)}
    assert not [r for r in made if any(s.strip().lower() in theirs for s in _SENTENCE.split(r))] and len(made) > 5_000


def test_held_out_defects_are_found_with_calibrated_thresholds(spark):
    """Recall of each kind on defects made of pairs that the model has not seen, and few false ones among the sound."""
    import random

    from folioflow.llm.defects import LABELS, broken, sample, train

    papers = spark.read.parquet("/root/testdata/sf0.1/papers.parquet").selectExpr("paper_id as id", "title", "abstract as prompt", "tldr as response")
    pairs = sample(papers, 3000)
    model = train(pairs[:2000])
    clean = [x for x in pairs[2000:] if model.defects([x]) == [None]]
    made = broken(clean, random.Random(5))
    got = model.defects([x for x, _ in made])
    for label in LABELS:
        of = [g for g, (_, d) in zip(got, made) if label in d]
        assert sum(g is not None for g in of) >= 0.9 * len(of), label
    sound = [g for g, (_, d) in zip(got, made) if not d]
    assert sum(g is None for g in sound) >= 0.95 * len(sound)


def test_a_refusal_behind_many_words_is_seen(spark):
    from folioflow.llm.defects import features

    long = " ".join(["the method is of use in the field"] * 12)
    one, two = features("t", "p", long + " and it holds."), features("t", "p", long + " but I cannot answer.")
    assert len(set(one) ^ set(two)) >= 6
