from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from terravane.llm import substrings as S


def brute(rows):
    """{(key, text): (removed, spans, kept)} by a dictionary of all windows in order."""
    order = lambda r: (r[0] is None, r[0] or 0)
    seen, out = set(), {}
    for key, text in sorted(dict.fromkeys(rows), key=order):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - S.WIDTH + 1):
            w = data[i : i + S.WIDTH]
            if w in seen:
                gone[i : i + S.WIDTH] = b"\x01" * S.WIDTH
            seen.add(w)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out[key, text] = (sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def compare(spark, rows):
    got = S.remove_repeats(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, place string")).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept_bytes), len(r.removed_spans), bytes(r.kept_bytes)) for r in got), key=str) == sorted(
        ((k, len((t or "").encode()), *want[k, t]) for k, t in rows), key=str
    )


def test_random_against_all_windows(spark, monkeypatch):
    rng = random.Random(6)
    alphabet = "abé \n"
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(60, 400))) for _ in range(12)]
    rows = []
    for key in range(150):
        text = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            i = rng.randint(0, len(p) // 2)
            text += p[i : rng.randint(i, len(p))] + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        rows.append((key, text))
    rows += [(200, "a" * 1000), (201, "ab" * 300), (202, "a" * 99), (203, "a" * 100), (204, None), (205, ""), (206, rows[5][1]), (207, rows[5][1]), rows[7], rows[7]]
    compare(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_short_texts_side_by_side(spark, seed):
    """Texts little longer than a string, cut out of a few passages at all offsets: matches of 100 to 180 bytes."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefgh ij") for _ in range(260)) for _ in range(4)]
    rows = []
    for key in range(220):
        p, n = rng.choice(passages), rng.randint(100, 180)
        i = rng.randint(0, len(p) - n)
        rows.append((key, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))) + p[i : i + n] + rng.choice(["", "q", "qr" * 20])))
    compare(spark, rows)


def test_null_key_and_small_blocks(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(None, text[100:500]), (3, text), (4, text[:250] + "zz" + text[250:]), (9, "y" * 150)]
    compare(spark, rows)


def test_many_chunks_and_buckets(spark, monkeypatch):
    """Copies, shifted copies and one passage everywhere, over some dozen chunks and buckets."""
    monkeypatch.setattr(S, "CHUNK_BYTES", (1500, 1500))
    monkeypatch.setattr(S, "BUCKET_STRINGS", (300, 300))
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghij klmnop\n") for _ in range(n))
    common, rows = letters(230), []
    for key in range(0, 160, 2):
        text = letters(rng.randint(0, 60)) + common[rng.randint(0, 40) : rng.randint(120, 230)] + letters(rng.randint(50, 500))
        rows.append((key, text))
        rows.append((key + 1, letters(rng.randint(0, 9)) + text[rng.randint(0, 30) :] if rng.random() < 0.5 else letters(200)))
    rows += [(1000 + i, common[:28] + letters(172)) for i in range(40)] + [(2000 + i, rows[0][1]) for i in range(20)] + [(None, rows[4][1]), (3000, "x" * 5000)]
    compare(spark, rows)


def test_cover():
    """Every distance modulo the period is that of two residues, once."""
    distances = sorted((a - b) % S.PERIOD for a in S.COVER for b in S.COVER if a != b)
    assert distances == list(range(1, S.PERIOD))


def test_hashes_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    starts = np.arange(0, 2800)
    whole = S.hashes(data, starts, starts + S.WIDTH, 0)
    assert (whole[2000:2201] == whole[100:301]).all() and len(set(whole.tolist())) == len({data[i : i + S.WIDTH].tobytes() for i in starts})
    monkeypatch.setattr(S, "BLOCK", 256)
    assert (S.hashes(data, starts, starts + S.WIDTH, 0) == whole).all()


def test_planes():
    values = np.array([0, 1, 255, 256, 1 << 39, (1 << 40) - 1], np.uint64)
    assert (S._numbers(S._planes(values, 5), 5) == values).all() and len(S._numbers(S._planes(values[:0]))) == 0


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    from terravane.llm.queries import op10_substrings

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_substrings(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: (len((t or "").encode()), want[k, t][0], want[k, t][1], hashlib.sha256(want[k, t][2]).hexdigest()) for k, t in rows}
