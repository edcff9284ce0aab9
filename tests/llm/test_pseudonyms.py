from __future__ import annotations

import random

import pytest

from terravane.llm import pseudonyms as P

KEY = b"a key of the tests"


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000])
def test_a_permutation_and_its_inverse(size):
    p = P.Permutation(KEY, "t", size)
    images = [p(x) for x in range(size)]
    assert sorted(images) == list(range(size))
    assert [p(y, back=True) for y in images] == list(range(size))


@pytest.mark.parametrize(
    ("kind", "value"),
    [("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("phone", "+1 (743) 555-3824"), ("phone", "212-555-0100"), ("social", "123-45-6789"), ("address", "152.143.123.131"), ("day", "1999-12-31"), ("day", "31.12.1999"), ("day", "31/12/1999"), ("day", "12/31/1999"), ("mail", "ada.19@mail5.example.com"), ("account", "DE89 3704 0044 0532 0130 00"), ("token", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")],
)
def test_keeps_the_format_and_can_be_undone(kind, value):
    text, spans = P.Pseudonyms(KEY).rewrite(f"x {value}. y")
    other = text[2:-3]
    assert [(s["kind"], s["start"], s["length"]) for s in spans] == [(kind, 2, len(value))]
    assert other != value and P.restore(other, kind, KEY) == value
    if kind not in ("address", "day"):
        assert [c if not c.isalnum() else "x" for c in other] == [c if not c.isalnum() else "x" for c in value]
    again, spans = P.Pseudonyms(KEY).rewrite(f"x {other}. y")
    assert [s["kind"] for s in spans] == [kind]


@pytest.mark.parametrize("text", ["4111111111111112", "256.1.1.1", "1.2.3", "30.02.2001", "version 2.0.", "000-12-3456", "2123465659789241 of", "1234567", "", "no numbers"])
def test_leaves_what_is_not_valid(text):
    assert P.Pseudonyms(KEY).rewrite(text) == (text, [])


def test_upper_case_tokens():
    value = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"
    text, spans = P.Pseudonyms(KEY).rewrite(f"X {value}. Y")
    assert [(s["kind"], s["start"], s["length"]) for s in spans] == [("token", 2, 40)]
    assert text[2:-3] != value and text[2:-3].isupper() and P.restore(text[2:-3], "token", KEY) == value
    assert text[2:-3].lower() == P.token(value.lower(), KEY)


def test_neighbours():
    text, spans = P.Pseudonyms(KEY).rewrite("4465758382889437 4465758382889437 +1 (826) 555-4081 190.137.223.204###")
    assert [s["kind"] for s in spans] == ["card", "card", "phone", "address"]
    assert text.split()[0] == text.split()[1] != "4465758382889437"


def test_days_are_linked_across_formats():
    of = P.Pseudonyms(KEY)
    y, m, d = of["day", "1999-12-31"].split("-")
    assert of["day", "31.12.1999"] == f"{d}.{m}.{y}"


def test_random_days_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        value = f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1900, 2099)}"
        assert P.restore(P.day(value, KEY), "day", KEY) == value


def test_table(spark):
    long = "word " * 50_000 + "4111111111111111"
    rows = [(1, "call +1 (743) 555-3824", "a"), (2, None, "b"), (3, "", None), (None, "call +1 (743) 555-3824", "a"), (1, "call +1 (743) 555-3824", "a"), (4, long, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = P.pseudonymise(df, KEY)
    assert out.columns == ["doc_id", "text", "spans"]
    got = out.collect()
    assert len(got) == 6 and len({r.text for r in got if r.text and r.text.startswith("call")}) == 1
    assert [r.text for r in got if r.doc_id in (2, 3)] == [None, ""]
    assert [len(r.spans) for r in got if r.doc_id == 4] == [1]
    assert P.pseudonymise(df.where("false"), KEY).count() == 0


def test_query_is_undone_and_keeps_links(spark):
    """Every text of the query with its pseudonyms put back is the old text; equal values have equal pseudonyms, different ones different."""
    from terravane.llm import pseudonyms as P
    from terravane.llm.queries import DEMONSTRATION_KEY, op5_pseudonyms

    folder = "/root/testdata/sf0.01"
    old = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    met, back = {}, {}
    for r in op5_pseudonyms(spark, folder).collect():
        text, new, shift, end, parts = old[r["doc_id"]], r["text"], 0, 0, []
        assert r["n_values"] == len(r["spans"])
        for s in r["spans"]:
            value = text[s["start"] : s["start"] + s["length"]]
            other = P.KINDS[s["kind"]](value, DEMONSTRATION_KEY)
            at = s["start"] + shift
            assert new[at : at + len(other)] == other and P.restore(other, s["kind"], DEMONSTRATION_KEY) == value
            assert met.setdefault((s["kind"], value), other) == other and back.setdefault((s["kind"], other), value) == value
            parts += [new[end:at], value]
            shift, end = shift + len(other) - len(value), at + len(other)
        assert text is None if new is None else "".join([*parts, new[end:]]) == text
    assert len(met) > 50
