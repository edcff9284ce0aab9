from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.llm import logbilinear
from terravane.llm.common import fold

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*(w.encode().lower() for w in WORDS.findall(text or "")), None]


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held_out = fold("doc_id", 7) == 2
    found, vocab = logbilinear.scored(docs, docs.where(~held_out))
    return docs.collect(), {r["doc_id"]: r for r in found.collect()}, vocab


def test_counts_and_base(scored):
    docs, got, vocab = scored
    counts = Counter(t for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for t in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    assert (vocab.n_tokens, vocab.n_distinct) == (n, v)
    for r in docs:
        own, row = tokens(r["text"]), got[r["doc_id"]]
        assert row["n_tokens"] == len(own) and row["n_known"] == sum(counts[t] > 0 for t in own)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own))


def test_beats_the_counts_on_held_out_texts(scored):
    docs, got, _ = scored
    held = [got[r["doc_id"]] for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_add_up_to_one(scored):
    """Over all known words, each at its unit or slot and with its share of the last slot, and the unknown words of each class."""
    vocab = scored[2]
    model = logbilinear.Model(vocab.log_noise, vocab.inner_noise)
    rng = np.random.default_rng(3)
    model.vectors += rng.standard_normal(model.vectors.shape).astype(np.float32)
    model.inner_vectors += rng.standard_normal(model.inner_vectors.shape).astype(np.float32)
    before = rng.integers(0, logbilinear.CONTEXTS, (1, logbilinear.CONTEXT)).astype(np.uint16)
    p = lambda place: 10 ** model.log10(np.array([place], np.uint16), before)[0]
    words = sum(p(u) for u in range(logbilinear.WORDS))
    slots, rest = 0.0, np.zeros(logbilinear.CLASSES)
    for c in range(logbilinear.CLASSES):
        slots += sum(p(logbilinear.UNITS + 1 + c * logbilinear.SLOTS + k) for k in range(logbilinear.REST))
        rest[c] = p(logbilinear.WORDS + c)
    assert words + slots + rest.sum() == pytest.approx(1, abs=1e-4)
    # The last slots' known words have the shares (c + 1) / (sum + 1), unknown ones 1 / (sum + 1).
    others = (vocab.unit < 0) & (vocab.slot < 0)
    assert (vocab.count[others] + 1).sum() == vocab.sums.sum() and len(vocab.frequent) == vocab.n_distinct
    assert ((vocab.slot >= 0).sum() > logbilinear.CLASSES) and vocab.sums.min() >= 0


def test_edges(spark):
    rows = [(1, "a b a", 0), (1, "a b a", 0), (2, None, 1), (3, "", 2), (None, "b " * 5000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rare int").withColumn("score", F.lit("old"))
    out = logbilinear.scored(docs, docs)[0].collect()
    assert len(out) == 5 and sorted(r["n_tokens"] for r in out) == [1, 1, 4, 4, 5001]
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert sorted(r["rare"] for r in out) == [0, 0, 1, 2, 3]
    empty = docs.limit(0)
    assert logbilinear.scored(empty, empty)[0].count() == 0
    assert logbilinear.scored(docs, empty)[0].where("n_known > 0").count() == 0


def test_probabilities_of_units_by_powers_of_two(monkeypatch):
    """Scores are those of a softmax in double precision, large logits too, without a power of e for each unit."""
    from terravane.llm import logbilinear as L

    rng = np.random.default_rng(5)
    noise = np.log(rng.dirichlet(np.ones(L.UNITS))).astype(np.float32)
    model = L.Model(noise, np.log(rng.dirichlet(np.ones(L.SLOTS), L.CLASSES)).astype(np.float32))
    places, before = rng.integers(0, L.WORDS, 700).astype(np.uint16), rng.integers(0, L.CONTEXTS, (700, L.CONTEXT)).astype(np.uint16)
    powers, exp = [], np.exp
    monkeypatch.setattr(L.np, "exp", lambda x, *a, **b: (powers.append(np.size(x)), exp(x, *a, **b))[1])
    for scale in (1, 40):
        model.vectors *= scale
        logits = np.clip((model.predicted(before).astype(np.float64)) @ model.vectors.T.astype(np.float64) + model.biases, -60, 60)
        want = (logits[np.arange(700), places] - np.log(exp(logits).sum(axis=1))) / np.log(10)
        assert np.allclose(model.log10(places, before), want, atol=1e-4)
    assert sum(powers) < 700
