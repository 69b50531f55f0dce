import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.personal import find_personal, finds, normal, redact, redacted


def got(text):
    return [(f.kind, text[f.begin : f.end]) for f in finds(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to ann.roe+x@mail.example.com.", [("email", "ann.roe+x@mail.example.com")]),
        ("write to a dot roe-office at mail dot norvale dot example dot org today", [("email", "a dot roe-office at mail dot norvale dot example dot org")]),
        ("(roe_a [at] lab-x.test), roe(at)x(dot)invalid", [("email", "roe_a [at] lab-x.test"), ("email", "roe(at)x(dot)invalid")]),
        ("аnn@exаmple.org", [("email", "аnn@exаmple.org")]),  # Cyrillic letters among Latin ones
        ("Report precision@10, hits@1 and loader@2.31.1; estimator at most 10.0.9.70", []),
        ("tel. +49 (0)30 23125 101, (825) 555-0171, 0044 1632 960129.", [("phone", "+49 (0)30 23125 101"), ("phone", "(825) 555-0171"), ("phone", "0044 1632 960129")]),
        ("ring +1-690-555-0122 ext. 53 if", [("phone", "+1-690-555-0122 ext. 53")]),
        ("call ６７９-555-0154 or six seven nine five five five zero one five four", [("phone", "６７９-555-0154"), ("phone", "six seven nine five five five zero one five four")]),
        ("Runs 555-26 to 555-97; ISBN 000-0-11913-12-0; doi:10.99999/2019.90.27980; node 10.0.19.80; 2019-05-14", []),
        ("passport no. X00615331, tax ID 00 567 425 859, NINO: QQ484313A; Sensor ID 014250; Grant no. AB-17059/45", [("id_number", "X00615331"), ("id_number", "00 567 425 859"), ("id_number", "QQ484313A")]),
        ("sent to 12 Elm Lane, Apt 3B, Roeville 00123.", [("address", "12 Elm Lane, Apt 3B, Roeville 00123")]),
        ("home address Elmstraße 84, D-00503 Roestadt came", [("address", "Elmstraße 84, D-00503 Roestadt")]),
        ("P.O. Box 12, Roeville 00123; Calle Olmo 38, 3º B, 00184 Roeburgo; 45 bis, avenue Orme, 00584 Roeville", [("address", "P.O. Box 12, Roeville 00123"), ("address", "Calle Olmo 38, 3º B, 00184 Roeburgo"), ("address", "45 bis, avenue Orme, 00584 Roeville")]),
        ("The Broad Street dataset holds 46157 images of 12 kinds.", []),
        ("Dear Dr. Roe, Jane, thank you. As Teodor ROE noted, J. K. Roe met Zoë\xa0de la Roe.", [("name", "Roe, Jane"), ("name", "Teodor ROE"), ("name", "J. K. Roe"), ("name", "Zoë\xa0de la Roe")]),
        ("The Roe inequality bounds Dr. Roe's loss on the Remote Insect Panels.", []),
    ],
)
def test_finds(text, want):
    assert got(text) == want


def test_redaction_leaves_the_rest():
    text = "Hi  Jane Roe \n<roe(at)x(dot)test>\t– tel. +15715550104!"
    assert redacted(text) == "Hi  [NAME] \n<[EMAIL]>\t– tel. [PHONE]!"
    assert redacted(None) is None and redacted("") == "" and finds("  \n") == [] and finds(None) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab @.(at)dot１２3​а\xa0-+zero five", max_size=80))
def test_offsets_map_back(text):
    x = normal(text)
    for i in range(len(x.text)):
        b, e = x.source(i, i + 1)
        assert 0 <= b <= e <= len(text)
        if x.text[i] == text[b:e]:
            continue
    if x.text:
        b, e = x.source(0, len(x.text))
        assert b == 0 or text[:b].strip("​") == ""
    spans = sorted((f.begin, f.end) for f in finds(text))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_long_runs_are_no_trouble():
    for run in ("x" * 50_000, "1" * 50_000, "a.b" * 20_000, "A. " * 20_000, "zero " * 5_000, "a at b dot " * 4_000):
        finds(run)


def test_operators(spark):
    df = spark.createDataFrame([(1, "ring 825-555-0171 or 825-555-0171", "k", "x"), (2, None, "k", "x"), (3, "", "k", "x"), (1, "ring 825-555-0171", "k", "x")], "id long, text string, kind string, redacted string")
    assert sorted((r.id, r.kind, r.found_text) for r in find_personal(df, "id", "text").collect()) == [(1, "phone", "825-555-0171")] * 2
    rows = redact(df, "text").orderBy("id").collect()
    assert [r.redacted for r in rows if r.id != 1] == [None, ""] and rows[0].kind == "k" and len(rows) == 4
    assert find_personal(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("at", [o + b + w + b + c for o, c in ("[]", "()", "{}", "<>") for b in ("", " ", "\t", "\n") for w in ("at", "AT", "ät", "arroba", "@")])
def test_every_written_at_is_found(at):
    assert [k for k, _ in got(f"jane{at}site.org")] == ["email"]


@pytest.mark.parametrize("dot", [o + b + w + b + c for o, c in ("[]", "()", "{}") for b in ("", " ", "\t", "\n") for w in ("dot", "Punto", "punkt", ".")] + [" dot ", " PUNKT "])
def test_every_written_dot_is_found(dot):
    assert got(f"jane@site{dot}org") == [("email", f"jane@site{dot}org")]


@pytest.mark.parametrize("label", ["SIN", "TIN", "ITIN", "NIE", "NIF", "tin", "Sin"])
@pytest.mark.parametrize("between", [" ", "\n", "\t", "-", "", ":", ": ", "#", "=", " is ", "  no. ", " nr. "])
def test_every_short_label_is_found(label, between):
    assert got(f"kept {label}{between}046454286.") in ([("id_number", "046454286")], [("id_number", "-046454286")])


def invented(n: int) -> list[tuple[str, str]]:
    """Given and family names that are in no list, of many sounds."""
    import random

    from folioflow.llm.personal import _GIVEN

    rng = random.Random(20)
    heads, tails = "Hiro Pri Arj Oluw Mei Tak Ngoz Sver Yael Dmit Kwab Anj Thab Luci Zor Eir".split(), "shi ya un aseun lin umi i re itri ena ali mila iana ana ik wen".split()
    family = "Tan Ram Meh Aday Okon Lind Vasq Ferr Nak Petr Gold Mbe Sing Osm Kov Haug".split()
    ends = "aka an ta emi kwo strom uez ari amura ov berg ki hu an acs en".split()
    out = []
    while len(out) < n:
        given, fam = rng.choice(heads) + rng.choice(tails), rng.choice(family) + rng.choice(ends)
        if given.lower() not in _GIVEN:
            out.append((given, fam))
    return out


def test_invented_names_are_found_by_what_stands_around_them():
    from folioflow.llm.personal import finds

    frames = [
        "Contact is {n}.", "Signed, {n}", "The patient {n} was seen twice.", "As noted by {n}, it holds.", "Dear {n}, thank you.", "From: {n} <x@site.example>", "We thank {n} for help.", "Regards,\n{n}\n", "Prof. {n} spoke.",
        "{n} can be reached on +1 212 555 0100.", "Reviewer: {n}", "I met {n} at the seminar.", "The form was completed by {n} today.", "Please write to {n} about it.", "{n} noted in an e-mail that it holds.",
    ]
    hit, shapes = 0, ("{g} {f}", "{f}, {g}", "{g} K. {f}", "{g} {F}")
    names = invented(200)
    for i, (g, f) in enumerate(names):
        name = shapes[i % 4].format(g=g, f=f, F=f.upper())
        text = frames[i % len(frames)].format(n=name)
        hit += ("name", name) in {(x.kind, text[x.begin : x.end]) for x in finds(text)}
    assert hit >= 0.9 * len(names), hit
    for g, f in names[:50]:  # two capital words alone are no name
        assert not finds(f"The {g} {f} benchmark has more rows than {g} {f} of last year.")


def test_finds_take_time_in_proportion_to_the_text():
    import time

    from folioflow.llm.personal import finds

    line = "Write to jane@site.example or to joe (at) other.example today.\n"

    def seconds(n):
        began = time.process_time()
        assert len(finds(line * n)) == 2 * n
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 20 * max(0.02, seconds(2_000))


def test_edits_after_edits_map_back_to_the_source():
    from folioflow.llm.personal import Normal

    x = Normal("abcdefghij")
    x.edit([(2, 4, "XYZ"), (6, 7, "")])
    assert x.text == "abXYZefhij" and [x.source(i, i + 1) for i in (0, 2, 5, 7)] == [(0, 1), (2, 4), (4, 5), (7, 8)]
    x.edit([(1, 3, "-"), (8, 10, "Q")])
    assert x.text == "a-YZefhQ" and x.source(1, 2) == (1, 4) and x.source(7, 8) == (8, 10) and x.source(0, 8) == (0, 10)
