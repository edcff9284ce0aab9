from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from terravane.llm import periodic as P
from terravane.llm import queries

SCHEMA = "doc_id long, text string, runs string, n_runs string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, least_length=6, least_exponent=4):
    """Stretches of every period, by comparing word by word; of a stretch's periods the smallest."""
    found = {}
    for p in range(1, len(words) // least_exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least_length, least_exponent * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed):
    rng = random.Random(seed)
    out = []
    for k in range(120):
        w = [rng.choice("ab" if k % 3 else "abcdefgh") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (unit * rng.randrange(3, 9))[: rng.randrange(1, 50)]
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return out


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_as_compared_word_by_word(spark, exponent):
    rows = [(i, t, None, None) for i, t in enumerate(texts(exponent))]
    rows += [(900, None, "x", "y"), (901, "", None, None), (902, " \n ", None, None), (None, "a a a a a a a", None, None), (None, "a a a a a a a", None, None), (903, "na na na na " * 9, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = P.find_runs(df, least_exponent=exponent).collect()
    assert len(got) == len(rows)
    for r in got:
        runs = brute(words_of(r["text"]), 6, exponent)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs
        assert r["collapsed"] == collapsed(words_of(r["text"]), runs)
    assert P.find_runs(df.limit(0)).count() == 0


def test_long_texts():
    """Many blocks of the grid's pairs, one word over and over, and hashes that agree for different words."""
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 50, 30_000)
    unit = rng.integers(0, 9, 700)
    long = np.concatenate([noise, np.tile(unit, 6)[:4000], noise[:5000], np.zeros(1000, np.int64), noise[::-1]])
    rows = P.runs_of(long)
    assert [30_000, 4000, 700] in rows.tolist() or any(s <= 30_000 and s + m >= 34_000 and p == 700 for s, m, p in rows.tolist())
    for s, m, p in rows.tolist():
        assert (long[s : s + m - p] == long[s + p : s + m]).all() and m >= max(6, 4 * p)
        assert s == 0 or long[s - 1] != long[s - 1 + p]
        assert s + m == len(long) or long[s + m] != long[s + m - p]
    same = np.zeros(20_000, np.int64)
    assert P.runs_of(same).tolist() == [[0, 20_000, 1]]


def test_hashes_that_agree(monkeypatch):
    """With equal hashes for all words the comparison word by word still finds what there is."""
    monkeypatch.setattr(P, "mixed", lambda h: np.ones_like(h))
    for t in texts(7)[:60]:
        words = words_of(t)
        assert [tuple(r) for r in P.runs_of(P.word_numbers([w.encode() for w in words])).tolist()] == brute(words)


def test_query_by_the_contract(spark, tmp_path):
    rows = [(i * 3, t, "en") for i, t in enumerate(texts(11))] + [(7001, None, "en"), (7002, "", "en"), (None, "w x " * 8, None)]
    rows += [(i, " ".join(str((i * k * k) % 101) for k in range(80)), "en") for i in range(8000, 8060)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_periodic(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, text, _ in rows:
        w = words_of(text)
        h = zlib.crc32(str("" if i is None else i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = 1000 * top[1] // top[2] if runs else None
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *top, exponent)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 5
