from __future__ import annotations

import zlib

import numpy as np
import pytest

from terravane.llm import compression


def fold(i):
    return zlib.crc32(str(i).encode()) % 3


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    train = spark.createDataFrame([(i, q) for i, q in known.items() if fold(i) != 1], "doc_id long, quality int")
    model = compression.fit(docs, train)
    got = {r["doc_id"]: r["score"] for r in compression.score(docs, model).collect()}
    held = [(got[i], q) for i, q in known.items() if fold(i) == 1]
    right = np.mean([(s >= 0.5) == (q == 1) for s, q in held])
    most = max(np.mean([q for _, q in held]), 1 - np.mean([q for _, q in held]))
    assert all(0 <= s <= 1 for s in got.values())
    assert right > most + 0.02, (right, most)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good text here", 1), (1, "good text here", 1), (2, None, 1), (None, "", 1), (4, "bad " * 20000, 1)], "doc_id long, text string, score int")
    schema = "doc_id long, quality int"
    for rows in ([], [(1, 1)], [(1, 1), (2, 0)], [(1, 1), (1, 0), (4, 0)], [(None, 1), (4, None)]):
        model = compression.fit(docs, spark.createDataFrame(rows, schema))
        out = compression.score(docs, model).collect()
        assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    half = compression.fit(docs, spark.createDataFrame([], schema))
    assert all(r["score"] == pytest.approx(0.5) for r in compression.score(docs, half).collect())
    assert compression.score(docs.limit(0), half).count() == 0


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))
    assert np.allclose(compression.logistic(x, y.astype(float)), (2, -1), atol=0.25)


def test_scores_as_compressed_plainly(spark):
    """The query's scores against zstandard called on each piece with the model's two dictionaries."""
    import zstandard

    from terravane.llm.queries import op7_compression

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    known = spark.read.parquet(f"{folder}/labels.parquet").collect()
    train = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in known if fold(r["doc_id"]) != 1], "doc_id long, quality int")
    model = compression.fit(docs, train)

    def size(data, dictionary):
        pressed = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(pressed.compress(data[i : i + compression.PIECE])) for i in range(0, len(data), compression.PIECE))

    got = {r["doc_id"]: r for r in op7_compression(spark, folder).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        data = (r["text"] or "").encode()
        good, bad = size(data, model.good), size(data, model.bad)
        x = (bad - good) / max(1, bad + good)
        score = 1 / (1 + np.exp(-(model.slope * x + model.intercept)))
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=2e-3)
        assert got[r["doc_id"]]["held_out"] == (fold(r["doc_id"]) == 1) and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.5)
