"""Records of zipped members, with chunks that cut records and their ends anywhere."""

from __future__ import annotations

import zipfile

import pytest

from terravane.sources import archive, registers
from tests.test_sources import place


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 64, 10_000])
@pytest.mark.parametrize("text", [b"", b"</r>", b"a</r>bb</r></r>ccc", b"<</r></</r>></r>" * 9, b"no end at all" * 5])
def test_parts(text, size):
    chunks = (text[i : i + size] for i in range(0, len(text), size))
    assert list(archive.parts(chunks, b"</r>")) == text.split(b"</r>")


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_members_are_tasks(spark, tmp_path):
    members = {"a.xml": "".join(f"rec é {i};" for i in range(500)), "d/b.xml": "x;y z;;tail", "c.txt": "left out;"}
    zipped(tmp_path / "one.zip", members)
    zipped(tmp_path / "two.zip", {"e.xml": "", "f.xml": "only"})
    df = archive.zip_records(spark, str(tmp_path), ";", ".xml", chunk=13)
    assert df.rdd.getNumPartitions() == 4
    got = {}
    for r in df.collect():
        got.setdefault(r["member"], {})[r["number"]] = r["value"]
    want = {m: {k: v for k, v in enumerate(data.split(";")) if v} for m, data in (members | {"f.xml": "only"}).items() if m.endswith(".xml")}
    assert got == want
    some = archive.zip_records(spark, str(tmp_path / "one.zip"), ";", ".xml", ("é 49", "tail"), 13)
    assert sorted(r["value"] for r in some.collect()) == sorted([f"rec é {i}" for i in (49, *range(490, 500))] + ["tail"])
    assert archive.zip_records(spark, str(tmp_path), ";", ".none").count() == 0


def test_places_from_an_archive(spark, tmp_path):
    names = [("Nordberg", "swe", "1", "0"), ("Pohjanmäki", "fin", "1", "1")]
    text = "<x>" + "".join(place(i, (1010210, 999, 1010205)[i % 3], f"{i} 6700000", names) for i in range(300)) + "</x>"
    (tmp_path / "p.xml").write_text(text, encoding="utf-8")
    zipped(tmp_path / "p.zip", {"places.xml": text})
    rows = lambda path: sorted(map(str, registers.places(spark, str(tmp_path / path)).collect()))
    assert rows("p.zip") == rows("p.xml") and len(rows("p.zip")) == 200
