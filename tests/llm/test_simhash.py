from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from terravane.llm import simhash as S
from terravane.llm.graph import components


def plain_fingerprint(text, words=4):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    width = min(words, len(found))
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + width]), 42) for i in range(len(found) - width + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_classes(values, keys, bits):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    members = {}
    for i in range(len(values)):
        members.setdefault(find(i), []).append(keys[i])
    return {i: min((k for k in members[find(i)] if k is not None), default=None) for i in range(len(values))}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO three", "a b c d", "É à b c d E f", "x " * 70_000, "a\xa0b c\x0bd e f g"])
def test_fingerprint(text):
    assert S.fingerprint(text or "", 4) == plain_fingerprint(text)


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 5])
def test_links_against_all_pairs(spark, bits):
    rng = random.Random(bits)
    values = {0, (1 << 64) - 1}
    for _ in range(60):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(3):
            w = v
            for b in rng.sample(range(64), rng.randint(1, 7)):
                w ^= 1 << b
            values.add(w)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = sorted((r.low, r.high) for r in S.links(df, bits).collect())
    want = sorted(tuple(sorted((a, b))) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and (values[i] ^ values[j]).bit_count() <= bits)
    assert got == want


def test_links_are_not_broadcast(spark):
    """3,000 fingerprints are far below the bound of a broadcast, which their 192,000 variants are sized by as well."""
    prints = spark.range(3000).select(S.F.xxhash64("id").alias("fingerprint"))
    found = S.links(prints, 4)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_table_against_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = []
    for i in range(80):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        rows += [(i, text, "x"), (200 + i, text if i % 2 else text + " tail", None)]
    rows += [(900, None, "n"), (901, "", "n"), (None, rows[0][1], "n"), (None, "lonely and without an id of its own", "n"), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    values = [plain_fingerprint(r[1]) for r in rows]
    classes = plain_classes(values, [r[0] for r in rows], 4)
    assert got == sorted(((r[0], values[i], classes[i]) for i, r in enumerate(rows)), key=str)


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    chain = list(range(300))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (None, 1), (1001, 1000)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(1, 300)} | {i: 1000 for i in range(1001, 1200)}
    assert got == want


def test_parities_prove_no_similar_pair_away():
    """Sets of many sizes and similarities: they differ in at least as many elements as parities."""
    rng = np.random.default_rng(2)
    for size in (0, 1, 5, 60, 300, 2000):
        for shared in (0.0, 0.5, 0.9, 1.0):
            a, b = (rng.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(2))
            both = int(size * shared)
            b[:both] = a[:both]
            differ = len(set(a.tolist()) ^ set(b.tolist()))
            odd = sum(int(x).bit_count() for x in (S._parities(a) ^ S._parities(b)).view(np.uint64))
            assert odd <= differ and (shared < 1 or odd == 0) and (not 0 < differ < 40 or odd > differ / 2)


def near_prints(slots, seed):
    """(slot, id, root, value) rows: clouds of fingerprints up to 13 bits apart, some clouds with one root."""
    rng, rows = random.Random(seed), []
    for slot in range(slots):
        number = 0
        for cloud in range(25):
            centre = rng.getrandbits(64)
            for _ in range(rng.choice([1, 4, 12])):
                value = centre
                for b in rng.sample(range(64), rng.randint(0, 7)):
                    value ^= 1 << b
                rows.append((slot, number, -1 - cloud if cloud % 3 == 0 else number // 2, value))
                number += 1
    return rows


def test_candidates_against_all_pairs(spark):
    """Texts meet if in a fingerprint one segment lacks at most one equal bit; no 16 bits in a row need be equal."""
    rows = near_prints(2, 3)
    every = sum(1 << b for b in (4, 12, 24, 36, 50, 60))
    rows += [(0, 9000, 9000, 5 << 40), (0, 9001, 9001, (5 << 40) ^ every ^ (1 << 60)), (1, 9000, 9000, 0), (1, 9001, 9001, (1 << 64) - 1)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(s, i, r, signed(v), 40, 0, 0, 0, 0) for s, i, r, v in rows], "slot int, id long, root long, value long, size int, " + ", ".join(f"{c} long" for c in S.PARITIES))
    got = {tuple(sorted((r.a, r.b))) for r in S._candidates(df, 11, 0.8).collect()}
    shares = lambda d: d.bit_count() <= 11 and any((d >> a & (1 << n) - 1).bit_count() <= 1 for a, n in S.segments(5))
    want = {(min(i, j), max(i, j)) for k, (s, i, r, v) in enumerate(rows) for t, j, q, w in rows[:k] if s == t and r != q and shares(v ^ w)}
    assert got == want and (9000, 9001) in want and len(want) > 100


def test_pairs_of_a_large_bucket_in_blocks(monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 7)
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 90):
        key, root = rng.integers(0, 6, size), rng.integers(0, 4, size)
        got = sorted((min(a, b), max(a, b)) for x, y in S._apart(key, root) for a, b in zip(x.tolist(), y.tolist(), strict=True))
        assert got == [(i, j) for i in range(size) for j in range(i + 1, size) if key[i] == key[j] and root[i] != root[j]]


def test_first_pass_grows_with_the_texts(spark):
    """400 copies of a text, each with edits of its own: at most one pair for each is compared first."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for _ in range(400):
        copy = list(words)
        for k in rng.sample(range(300), 3):
            copy[k] = f"e{rng.randrange(5000)}"
        texts.append(" ".join(copy))
    df = S.several_fingerprints(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 10)
    slots = df.selectExpr("id", "size", *S.PARITIES, "posexplode(prints) AS (slot, value)")
    pairs = S._stars(slots, 11, 0.8).collect()
    assert 300 <= len(pairs) <= 400 and len({r.a for r in pairs}) == len(pairs)
