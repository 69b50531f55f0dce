import pytest
from pyspark.sql import functions as F

from folioflow.operators.packed import explode_packed, packed_values

CASES = [
    ("Ann Boe", ["Ann Boe"]),
    ("Boe, A.; Coe, B. C.;; et al.", ["Boe, A.", "Coe, B. C."]),
    ('"Boe, Samuel ""Sam""";"Coe, B"', ['Boe, Samuel "Sam"', "Coe, B"]),
    ('["Ann Boe", "Zo\\u00eb Coe", "D \\"X\\" Eoe"]', ["Ann Boe", "Zoë Coe", 'D "X" Eoe']),
    ('"Boe, Ann", "Coe, B. & Son"', ["Boe, Ann", "Coe, B. & Son"]),
    ("Ann Boe, Ben Coe, and others", ["Ann Boe", "Ben Coe"]),
    ("Ann Boe, Ben C. Coe and Dan Eoe", ["Ann Boe", "Ben C. Coe", "Dan Eoe"]),
    ("Boe, Ann and Coe, Ben", ["Boe, Ann", "Coe, Ben"]),
    ("van Boe, Theresa S.", ["van Boe, Theresa S."]),
    ("de la Boe S, Ann Coe", ["de la Boe S", "Ann Coe"]),
    ("Boe, T., Jr.; Coe, H.", ["Boe, T., Jr.", "Coe, H."]),
    ("Ann Boe and Working Group on Sleep, Diet and Ageing", ["Ann Boe", "Working Group on Sleep, Diet and Ageing"]),
    ("Ann Boe / Ben Coe", ["Ann Boe", "Ben Coe"]),
    ("Ann Boe || Ben Coe|Dan Eoe", ["Ann Boe", "Ben Coe", "Dan Eoe"]),
    ("Ann Boe·Ben Coe；Dan Eoe、Fay Goe", ["Ann Boe", "Ben Coe", "Dan Eoe", "Fay Goe"]),
    ("Ann Boe\r\n\r\nBen Coe\tDan Eoe", ["Ann Boe", "Ben Coe", "Dan Eoe"]),
    ('Boe, Theresa "Tess"; Coe, B.', ['Boe, Theresa "Tess"', "Coe, B."]),
    ("Ann Boe; Ann Boe", ["Ann Boe", "Ann Boe"]),
    ("  Boe, I.\n", ["Boe, I."]),
    ('Prof "Roe, Ann"; "Li, Bo"', ['Prof "Roe, Ann"', "Li, Bo"]),
    ('A B;xx "Li, Bo" yy;"Ro, C"', ["A B", 'xx "Li, Bo" yy', "Ro, C"]),
    ('Ann "A; and B" Boe; Coe, B.', ['Ann "A; and B" Boe', "Coe, B."]),
    ('"Boe, Ann" & "Coe; Ben"', ["Boe, Ann", "Coe; Ben"]),
    ("Ann \ue000 Boe\ue010; Ben \ue000e Coe", ["Ann \ue000 Boe\ue010", "Ben \ue000e Coe"]),
    ('"Ann \ue000; Boe"; Coe, B.', ["Ann \ue000; Boe", "Coe, B."]),
    ('["Boe, Ann & Co; x", "Back\\\\slash Boe", "Tab\\tBoe", "\\"Al\\" Boe"]', ["Boe, Ann & Co; x", "Back\\slash Boe", "Tab\tBoe", '"Al" Boe']),
    (" ; ", []),
    ("", []),
    ("   ", []),
    (None, []),
]


def test_packed_values(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, a string")
    got = {r.i: list(r.v) for r in df.select("i", packed_values(F.col("a")).alias("v")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text


def test_positions_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "A Boe; B Coe", "old", 9), (2, None, "old", 9)], "id int, a string, author string, author_no int")
    got = explode_packed(df, "a", "author", "author_no").orderBy("author_no").collect()
    assert [(r.id, r.author_no, r.author) for r in got] == [(1, 1, "A Boe"), (1, 2, "B Coe")]
    same = explode_packed(df.select("id", "a"), "a", "a", "n")
    assert sorted((r.n, r.a) for r in same.collect()) == [(1, "A Boe"), (2, "B Coe")]


def test_empty_table_and_long_field(spark):
    df = spark.createDataFrame([], "id int, a string")
    assert explode_packed(df, "a", "v", "n").count() == 0
    long = spark.createDataFrame([(1, "; ".join(f"Boe, A{'x' * (i % 50)}" for i in range(5000)))], "id int, a string")
    assert explode_packed(long, "a", "v", "n").agg(F.max("n")).first()[0] == 5000


@pytest.mark.parametrize("text", ['"a', 'a"b', '"a";"b'])
def test_unbalanced_quotes_are_text(spark, text):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(packed_values(F.col("a")).alias("v")).count() == 1
