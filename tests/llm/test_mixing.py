from __future__ import annotations

from collections import defaultdict

from terravane.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, taken string, key_ string"


def levels(sizes):
    """Targets by filling up step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_are_met(spark):
    rows = []
    for i in range(600):
        source = [None, "a", "b", "c", "d", "é", "hot", "hot", "hot", "hot"][i % 10]
        rows.append((i, " ".join("w" for _ in range(i % 37)) + (" ### 1" if i % 5 == 0 else ""), source if i > 12 else f"small{i}", None, None))
    rows += [(700, None, "a", None, None), (701, "", "b", None, None), (None, "no id", "c", None, None), (None, "no id", "c", None, None), rows[50], (702, "", "only empty", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.plan(df, bucket_rows=16).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, M.plan(df.repartition(7), bucket_rows=16).collect()))
    assert sorted(map(str, got)) == sorted(map(str, M.plan(df, bucket_rows=10**6).collect()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = levels(dict(sizes))
    for s in sizes:
        assert next(r.target for r in got if r.source == s) == __import__("pytest").approx(want[s])
        assert abs(taken[s] - want[s]) <= 1


def test_rest_follows_the_keys(spark):
    df = spark.createDataFrame([(i, "w w w w", f"s{i % 2}") for i in range(100)], "doc_id long, text string, source string")
    got = M.plan(df).collect()
    partial = [r for r in got if 0 < r.extra < r.size]
    assert len(partial) <= 2 and all(r.taken in (4 * r.epochs, 4 * r.epochs + 4) for r in got if r not in partial)


def test_heavier_documents_come_first(spark):
    rows = [(i, "word " * 10 if i % 2 else "###1 " * 10, "s0") for i in range(2000)] + [(5000 + i, "word " * 10, "s1") for i in range(2000)]
    got = M.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 's0'").collect()
    clean = sum(r.taken for r in got if r.doc_id % 2)
    assert clean > 2 * sum(r.taken for r in got if r.doc_id % 2 == 0)


def test_empty(spark):
    assert M.plan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.plan(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first().taken == 0
