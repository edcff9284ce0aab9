from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from terravane.llm import queries
from terravane.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n string"


def near(a, b):
    """Whether a is b with one code point inserted, deleted or replaced: by trying all."""
    cuts = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return a in cuts(b) if len(a) + 1 == len(b) else b in cuts(a) if len(b) + 1 == len(a) else False


def brute(counts, ratio=5):
    """word: (form, root, n, n_near, form_n), from all pairs."""
    form, out = {}, {}
    for w, n in counts.items():
        found = sorted(((-m, x.encode(), x) for x, m in counts.items() if near(w, x)))
        best = found[0] if found and -found[0][0] >= ratio * n else None
        form[w] = best[2] if best else None
        out[w] = (len(found), -best[0] if best else None)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], *out[w])
    return out


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(rng, n, letters, lengths):
    counts = {}
    while len(counts) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        counts[w] = rng.choice([5, 5, 6, 30, 200, 1000, 5000])
        if rng.random() < 0.5:
            i = rng.randrange(len(w))
            counts[w[:i] + rng.choice(["", rng.choice(letters), w[i] + rng.choice(letters)]) + w[i + 1 :]] = rng.choice([5, 25, 25, 125])
    return {w: n for w, n in counts.items() if w}


@pytest.mark.parametrize(("seed", "letters", "lengths", "rows"), [(0, "ab", range(6, 9), 4), (1, "abcdé", range(6, 14), 3), (2, "ÿaà", (1, 2, 3, 6, 25), 2), (3, "abcdefgh", range(6, 9), 512)])
def test_as_all_pairs(spark, seed, letters, lengths, rows):
    """Groups of two to four words are halved until one code point is left."""
    counts = vocabulary(random.Random(seed), 160, letters, lengths)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(S.variants(df, group_rows=rows)) == brute(counts)


def test_a_third_of_the_words_share_a_half(spark):
    rng = random.Random(5)
    tails = {"".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(900)}
    counts = {"prefix" + t: rng.choice([5, 50, 500]) for t in tails} | {t + "suffix": rng.choice([5, 50, 500]) for t in tails}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    few, many = (got(S.variants(df, group_rows=k)) for k in (16, 10**6))
    assert few == many
    some = set(rng.sample(sorted(counts), 40))
    for w in some:
        assert few[w][3] == sum(near(w, x) for x in counts)


def test_near_of_group_counts_bigrams():
    found = set()
    for most in (6, 7):
        words = [w for w in ("abcdef", "abcxef", "abcdf", "abcdeff", "zbcdef", "abcfed") if len(w) in (most, most - 1)]
        found |= {frozenset((words[i], words[j])) for i, j in S.near_of_group(words, most, 0, 0)}
    assert found == {frozenset(p) for p in (("abcdef", "abcxef"), ("abcdef", "abcdf"), ("abcdef", "abcdeff"), ("abcdef", "zbcdef"))}


def test_words_of_texts(spark):
    rows = [(1, "Haus-HAUS haus ÉTÉS étés " + "x" * 5 + " straßen", None, None), (None, None, "w", "1"), (3, "", None, None), (4, "1234 ____", None, None), (1, "haus", None, None), (5, "abc " * 3, None, None), (6, "a" * 100_000 + " haus", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = {r["word"]: r["n"] for r in S.word_counts(df, least_length=4, least_count=1).collect()}
    want = Counter()
    for _, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.encode().lower().decode()
            if len(w) >= 4:
                want[w] += 1
    assert counts == want and counts["haus"] == 5 and "ÉtÉs" in counts
    assert S.word_counts(df.limit(0)).count() == 0
    assert S.variants(S.word_counts(df.limit(0))).count() == 0


def test_query_by_the_contract(spark, tmp_path):
    rng = random.Random(9)
    words = ["einheit", "eenheit", "einheiten", "lichkeit", "Lichkeit", "tionnelle", "tionelle", "abcdef"]
    rows = [(i if i % 7 else None, " ".join(rng.choices(words, [50, 3, 20, 9, 1, 30, 2, 1], k=30)), "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.lower()
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    found = got(queries.op11_spelling(spark, str(tmp_path)))
    assert found == want and any(f[0] for f in want.values())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(S.ORACLE)
    at = [rel.columns.index(c) for c in ("word", "form", "root", "n", "n_near", "form_n")]
    assert {r[at[0]]: tuple(r[i] for i in at[1:]) for r in rel.fetchall()} == want
