import pytest
from pyspark.sql import functions as F

from folioflow.llm.queries_spellings import p3_found
from folioflow.llm.spellings import link_organisations, link_persons, organisation, person, spelling_pairs


@pytest.mark.parametrize(
    "name, family, given",
    [
        ("Ann B. Moberullano", "moberullano", ("ann", "b")), ("Moberullano, Ann B.", "moberullano", ("ann", "b")), ("MOBERULLANO Ann", "moberullano", ("ann",)), ("Moberullano Ann", "moberullano", ("ann",)),
        ("A. Moberullano", "moberullano", ("a",)), ("A.Moberullano", "moberullano", ("a",)), ("Moberullano A", "moberullano", ("a",)), ("Moberullano, A., Jr.", "moberullano", ("a",)), ("Dr Ann Moberullano", "moberullano", ("ann",)),
        ("Ann de la Moberullano", "delamoberullano", ("ann",)), ("de la Moberullano, A.-L.", "delamoberullano", ("a.l",)), ("Zoë O'Moberullano", "omoberullano", ("zoe",)), ("A.-L. Moberullano", "moberullano", ("a.l",)),
    ],
)
def test_person(name, family, given):
    p = person(name, {"ann"}.__contains__)
    assert (p.family, p.given) == (family, given)


def test_organisation():
    same = ["University of Xoqaville", "Univ Xoqaville", "Universität Xoqaville", "Department of Physics, University of Xoqaville", "The University of Xoqaville (Main Campus)", "Xoqaville University"]
    assert {organisation(o) for o in same} == {frozenset({"university", "xoqaville"})}
    assert organisation("St. Univ. Xoqaville") == organisation("Xoqaville State") == frozenset({"university", "state", "xoqaville"})
    assert organisation("UH Xoqaville") == organisation("Universitätsklinikum Xoqaville")


def entities(df):
    groups: dict = {}
    for r in df.collect():
        groups.setdefault(r.entity, set()).add(r.name)
    return {frozenset(g) for g in groups.values()}


def test_persons_are_linked_by_merging(spark):
    one = ["Dorothea K. Moberullano", "Moberullano, Dorothea", "Dorothea (Thea) Moberullano", "Thea Moberullano", "Moberullano, D. K.", "MOBERULLANO Dorothea", "Dorothea Moberulalno", "dorothea moberullano"]
    other = ["Jonathan Moberullano", "Moberullano, J."]
    doubtful = ["Jana Xituqorou", "Joseph Xituqorou", "Xituqorou, J.", "Xituqorou, Jana"]
    rows = [(n, 1) for n in one + other + doubtful + one[:2] + ["", "  ", None, "123"]]
    got = entities(link_persons(spark.createDataFrame(rows, "who string, name int"), "who"))
    assert got == {frozenset(one), frozenset(other), frozenset({"Jana Xituqorou", "Xituqorou, Jana"}), frozenset({"Joseph Xituqorou"}), frozenset({"Xituqorou, J."})}
    assert link_persons(spark.createDataFrame([], "who string"), "who").count() == 0


def test_organisations_and_pairs(spark):
    names = ["National Laboratory for Marine Research, Xoqaville", "NLMR Xoqaville", "Natioanl Laboratory for Marine Research, Xoqaville", "Xoqaville Analytics GmbH", "Xoqaville-Analytics", "University of Xoqaville", "Xoqaville State University", "University of Xoqavllle", "x" * 20_000, None, ""]
    linked = link_organisations(spark.createDataFrame([(n,) for n in names], "a string"), "a")
    assert entities(linked) == {frozenset(names[:3]), frozenset(names[3:5]), frozenset([names[5], names[7]]), frozenset([names[6]]), frozenset([names[8]])}
    pairs = {(r.name_a, r.name_b) for r in spelling_pairs(linked).collect()}
    assert ("Xoqaville Analytics GmbH", "Xoqaville-Analytics") in pairs and len(pairs) == 3 + 1 + 1


def test_query(spark, sf_dir):
    got = p3_found(spark, sf_dir)
    assert got.columns == ["kind", "name_a", "name_b"] and got.where("name_a >= name_b").count() == 0
    assert got.count() == got.distinct().count() > 0


def test_initials_between_conflicting_ones_are_linked():
    from itertools import permutations

    from folioflow.llm.spellings import Person, merge_persons, person_profile

    def groups(givens):
        block = [person_profile(i, [(Person("moberullano", g, ()), 1)]) for i, g in enumerate(givens)]
        root = list(range(len(givens)))
        for a, b in merge_persons(block):
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(i for i in range(len(givens)) if root[i] == r) for r in root}

    for order in permutations([("z", "m"), ("z", "c"), ("z", "m"), ("z", "c")]):
        assert groups(order) == {frozenset(i for i, g in enumerate(order) if g[1] == m) for m in "mc"}
    for order in permutations([("z", "m"), ("z", "m"), ("z",)]):
        assert groups(order) == {frozenset(range(3))}
    for order in permutations([("z", "m"), ("z", "c"), ("z",)]):
        assert groups(order) == {frozenset([i]) for i in range(3)}


def test_many_profiles_of_one_family_take_little_time():
    """A common family name with 8,000 people, each typed in two ways: time in proportion, not with the square."""
    import random
    import time

    from folioflow.llm.spellings import Person, merge_persons, person_profile

    def seconds(n):
        rng = random.Random(3)
        firsts = {"".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(5)) for _ in range(n)}
        block = []
        for i, f in enumerate(sorted(firsts)):
            block.append(person_profile(2 * i, [(Person("okonkwo", (f,), ()), 1)]))
            block.append(person_profile(2 * i + 1, [(Person("okonkwo", (f, "k."), ()), 1)]))
        began = time.process_time()
        links = set(merge_persons(block))
        assert {(2 * i, 2 * i + 1) for i in range(len(firsts))} <= links
        return time.process_time() - began

    seconds(500)
    assert seconds(8000) < 8 * max(0.2, seconds(2000))


def test_merging_goes_on_until_nothing_merges(spark):
    """A chain in which each merge makes the next one possible, longer than six rounds."""
    from folioflow.lineage import cut
    from folioflow.llm.spellings import _rounds

    n = 9  # profile i may join the profile that holds 0 .. i - 1 only
    names = cut(spark.createDataFrame([(i, i) for i in range(n)], "id long, mark long"))

    def blocks(state):
        return state.groupBy("root").agg(F.max("mark").alias("top"), F.min("mark").alias("low")).select(F.lit(1).cast("long").alias("block"), "root", "top", "low")

    def merge(rows):
        a = rows.select(F.col("root").alias("a"), F.col("top"), F.col("low").alias("a_low")).where("a_low = 0")
        return a.join(rows.select(F.col("root").alias("b"), F.col("low")), F.col("low") == F.col("top") + 1).select("a", "b")

    assert {r.root for r in _rounds(names, blocks, merge).collect()} == {0}


def test_slips_in_short_families_and_long_words(spark):
    from folioflow.llm.spellings import link_persons, near_words

    names = ["Anna Schmidt", "Anna Schnidt", "Robert Smith", "Smyth, Robert", "Maria Kolb", "Maria Kolbe", "Peter Lang", "Petra Lang"]
    got = {r.name: r.entity for r in link_persons(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()}
    assert got["Anna Schmidt"] == got["Anna Schnidt"] and got["Robert Smith"] == got["Smyth, Robert"] and got["Peter Lang"] != got["Petra Lang"]
    long = "abcdefghij" * 5
    assert near_words([long, long[:3] + "x" + long[4:], long[:-2] + "y"])[long] == {long[:3] + "x" + long[4:], long[:-2] + "y"}
