from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from terravane.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


def reference(vocabulary, pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "aa", "th", "e ", " ", "\n", "\t", "é", "日本", "=", "==", "0", "12", "'s", "😀", "ing", " the", "\x85"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_same_ids_as_the_library(vocabulary):
    of, want = bpe.Encoder(vocabulary, public_tokenizers.PATTERN), reference(vocabulary)
    for text in [*texts(800), "x" * 5000, " " * 3000, "ab" * 4000]:
        assert np.frombuffer(of.packed(text), np.int32).tolist() == want.encode_ordinary(text)


def test_append_and_edit_give_the_table_of_the_whole(vocabulary):
    rng = random.Random(5)
    for text in texts(400, 7):
        data = text.encode()
        cut = len(data) // 2
        grown = bpe.Prefixes(vocabulary, data[:cut])
        grown.append(data[cut:])
        assert grown.last == bpe.Prefixes(vocabulary, data).last
        i = rng.randint(0, len(data))
        j = rng.randint(i, len(data))
        put = rng.choice([b"", b"xyz", b"the", b"a" * 40])
        grown.edit(i, j, put)
        assert grown.last == bpe.Prefixes(vocabulary, data[:i] + put + data[j:]).last


def test_edit_stays_near(vocabulary):
    long = bpe.Prefixes(vocabulary, b"some words of a long line, and more of them; " * 200)
    long.edit(100, 104, b"other")
    assert long.recomputed < 500


def test_columns_round_trip(spark):
    rows = [(1, "It's fine\n\n  ok", "x"), (2, None, None), (3, "", "y"), (None, "日本 é", "z"), (1, "It's fine\n\n  ok", "x"), (4, "w" * 200_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    back = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert back.columns == ["doc_id", "text", "token_ids", "decoded"]
    got = back.collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.token_ids == reference(bpe.Vocabulary.read(PATH)).encode_ordinary(r.text or "")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_query_against_the_library(spark):
    from terravane.llm.queries import op9_byte_bpe

    want = reference(bpe.Vocabulary.read(PATH))
    text = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op9_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = want.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
