from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terravane.llm import mixing, simhash

FOLDER = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_representatives_as_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for g in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append(" ".join(words))
        for _ in range(g % 4):
            copy = list(words)
            copy[rng.randrange(120)] = f"e{rng.randrange(99)}"
            rows.append(" ".join(copy))
    rows += [rows[0], rows[0].upper(), None, "", "short one", "short one"]
    rng.shuffle(rows)
    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b) > 0:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("root", F.lit("kept"))
    got = simhash.representatives(df).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i in range(len(rows)) if find(i) == i]
    assert all(r["root"] == "kept" and r["text"] == rows[r["doc_id"]] for r in got)


def test_pairs_far_in_most_fingerprints_link(spark):
    """Copies without their last 20 of 120 words: of three fingerprints of words one is near, the others far."""
    rows = []
    for seed in (4, 5, 6, 17):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows += [" ".join(words), " ".join(words[:-20])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.representatives(df).collect()) == [0, 2, 4, 6]


def block_copies(number, seed):
    """(text, copy) pairs with a block cut, appended or replaced, of Jaccard 0.8 to 0.85 on five-word shingles."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 4000}"
    pairs = []
    while len(pairs) < number:
        words = [word() for _ in range(rng.randint(80, 400))]
        n = len(words)
        part = lambda least, most: int(n * rng.uniform(least, most))  # noqa: B023, E731
        block = part(0.07, 0.11)
        copy = [words[: n - part(0.15, 0.2)], words + [word() for _ in range(part(0.17, 0.25))], [*words[: n // 2], *(word() for _ in range(block)), *words[n // 2 + block :]]][len(pairs) % 3]
        a, b = shingles(" ".join(words)), shingles(" ".join(copy))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            pairs.append((" ".join(words), " ".join(copy)))
    return pairs


def test_recall_of_block_copies(spark):
    """Every pair is similar by brute force; at least 97 % must be found."""
    pairs = block_copies(300, 5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.representatives(df).collect()}
    assert set(range(0, 600, 2)) <= left
    found = 1 - len(left - set(range(0, 600, 2))) / len(pairs)
    print(f"recall {found:.4f}")
    assert found >= 0.97


def test_first_pass_decides_no_link(spark, monkeypatch):
    """Groups are the same if no text is compared with a few of its bucket first."""
    df = spark.createDataFrame(list(enumerate(t for p in block_copies(60, 8) for t in p)), "doc_id long, text string")
    found = lambda: sorted(r["doc_id"] for r in simhash.representatives(df).collect())
    both, stars = found(), simhash._stars
    monkeypatch.setattr(simhash, "_stars", lambda *a: stars(*a).limit(0))
    assert found() == both


def test_representatives_edges(spark):
    schema = "doc_id long, text string"
    same = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (1, "other words are here")], schema)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.representatives(same).collect()) == [(1, "a b c"), (1, "other words are here")]
    assert simhash.representatives(same.limit(0)).count() == 0


def test_mixed_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("copies", F.lit(7))
    copies = {r["doc_id"]: r["n"] for r in mixing.plan(docs).select("doc_id", mixing.copies().alias("n")).collect()}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}


@pytest.mark.parametrize("empty", [False, True])
def test_run(spark, tmp_path, empty):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (None, "", "xx", "s", 0)], docs.schema)
    (docs.limit(0) if empty else docs.unionByName(odd)).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "lang", "token_ids", "n_tokens"]
    assert out.count() == 0 if empty else 0 < out.count() < 3 * docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_by_brute_force(spark):
    """Rules, pseudonyms and tokens of the stages, each text by itself; near-duplicates and mixing have tests of their own."""
    import public_tokenizers
    import tiktoken

    from terravane.llm import bpe, pseudonyms

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    kept = corpus_pipeline.quality(spark, docs, FOLDER)
    assert kept.columns == corpus_pipeline.COLUMNS
    for r in kept.collect():
        words = (r["text"] or "").split()
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)} if len(words) < 2000 else ()
        assert len(words) >= 20 and 100 * len(covered) <= 30 * len(words)
    rewritten = {r["doc_id"]: r for r in corpus_pipeline.pii(spark, docs, FOLDER).collect()}
    assert len(rewritten) == len(rows)
    plain = pseudonyms.Pseudonyms(corpus_pipeline.DEMONSTRATION_KEY)
    for r in rows:
        new = None if r["text"] is None else plain.rewrite(r["text"])[0]
        assert (rewritten[r["doc_id"]]["text"], rewritten[r["doc_id"]]["n_chars"]) == (new, None if new is None else len(new))
    path = public_tokenizers.path(corpus_pipeline.BPE)
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    ids = {r["doc_id"]: (r["token_ids"], r["n_tokens"], r["source"], r["lang"]) for r in corpus_pipeline.encode(spark, docs, FOLDER).collect()}
    assert ids == {r["doc_id"]: (t := want.encode_ordinary(r["text"] or ""), len(t), r["source"], r["lang"]) for r in rows}


def test_columns_named_as_the_helpers(spark):
    rows = spark.createDataFrame([(1, "a b c", "x", 5, 6), (2, "d e f", "y", 7, 8)], "doc_id long, text string, own_text string, own_key int, spot int")
    assert sorted(tuple(r) for r in simhash.representatives(rows).collect()) == [(1, "a b c", "x", 5, 6), (2, "d e f", "y", 7, 8)]
