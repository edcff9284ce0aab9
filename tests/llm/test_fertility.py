from __future__ import annotations

import math
import re

import public_tokenizers
import pytest

from terravane.llm import fertility

PATHS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def measured(spark, rows):
    return fertility.measure(spark.createDataFrame(rows, "doc_id long, lang string, text string, script int"), *PATHS)


def test_base_as_counted_plainly(spark):
    texts = ["a b c d e f g h " * 3, "x\ny\nx\n\n \nx", "#1 *2 $ é|<>", "", None, "ab " * 30, "one two\x0bthree\x1ffour", "word " * 3 + "end " * 8]
    got = measured(spark, [(i, "en", t, 0) for i, t in enumerate(texts)]).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(texts[r["doc_id"]])


def test_base_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000").select("doc_id", "lang", "text")
    for r in fertility.measure(docs, *PATHS).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(r["text"])


def test_bands_keep_prose_and_drop_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").select("doc_id", "lang", "text").collect()
    noise = " ".join(f"{i * 7919 % 99991:x}\U0001f9ff๚" for i in range(60))
    rows = [(r["doc_id"], r["lang"], r["text"], 0) for r in docs] + [(10**6, docs[0]["lang"], noise, 0)]
    found = measured(spark, rows)
    judged = fertility.judge(found, fertility.bands(found))
    got = {r["doc_id"]: r for r in judged.collect()}
    passed = [r for r in got.values() if not r["base_failed"] and r["doc_id"] < 10**6]
    assert sum(r["kept"] for r in passed) > 0.97 * len(passed)
    assert not got[10**6]["kept"] and not got[10**6]["base_failed"]


def test_edges(spark):
    rows = [(1, None, "word " * 2000, 0), (1, None, "word " * 2000, 0), (None, "zz", None, 0), (2, "zz", "", 0)]
    found = measured(spark, rows)
    out = fertility.judge(found, fertility.bands(found)).collect()
    assert len(out) == 4 and not any(r["kept"] for r in out) and dict(found.dtypes)["script"] == "string"
    none = found.limit(0)
    assert fertility.judge(none, fertility.bands(none)).count() == 0


@pytest.mark.parametrize(("text", "script"), [("abc", "Latin"), ("привет", "Cyrillic"), ("123", "Other"), ("漢字 a", "Han")])
def test_script(text, script):
    assert fertility.script_of(text) == script


def test_verdicts_as_counted_plainly(spark):
    """All figures, bands and verdicts of a table, by the libraries and plain arithmetic over sorted lists."""
    import sentencepiece
    import tiktoken

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text").collect()
    noise = " ".join(f"{i * 7919 % 99991:x}\U0001f9ff" for i in range(60))
    docs = [(r["doc_id"], r["lang"], r["text"], 0) for r in rows] + [(10**6, rows[0]["lang"], noise, 0), (10**6 + 1, "zz", None, 0)]
    bpe = tiktoken.Encoding("t", pat_str=PATHS[1], mergeable_ranks=fertility.bpe.ranks(PATHS[0]), special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    figures, passed = {}, {}
    for i, lang, text, _ in docs:
        n, *_, repeated = base(text)
        passed[i] = not (n < 20 or 100 * repeated > 30 * n)
        if n:
            ids, parts = bpe.encode_ordinary(text), pieces.encode(text)
            shares = [ids.count(t) / len(ids) for t in set(ids)]
            figures[i] = (len(text) / len(ids), len(text) / len(parts), sum(pieces.is_byte(p) for p in parts) / len(parts), -sum(p * math.log2(p) for p in shares))
    groups = {}
    for i, lang, text, _ in docs:
        if passed[i]:
            for g in (("lang", lang), ("script", fertility.script_of(text))):
                groups.setdefault(g, []).append(i)
    groups["all", ""] = [i for i in passed if passed[i]]
    rounded = lambda x: math.floor(x * 1000 + 0.5) / 1000
    quartiles = {g: [[sorted(rounded(figures[i][k]) for i in members)[max(0, math.ceil(q * len(members)) - 1)] for q in (0.25, 0.5, 0.75)] for k in range(len(fertility.BANDS))] for g, members in groups.items()}

    def drawn(g, toward):
        if g not in quartiles:
            return toward
        n, more = len(groups[g]), fertility.BORROWED
        return [[(n * x + more * y) / (n + more) for x, y in zip(own, wide, strict=True)] for own, wide in zip(quartiles[g], toward, strict=True)]

    def band(lang, text):
        out = []
        for (low, middle, high), rule in zip(drawn(("lang", lang), drawn(("script", fertility.script_of(text)), quartiles["all", ""])), fertility.BANDS.values(), strict=True):
            half = max(rule.spreads * (high - low) / 1.349, rule.least_share * abs(middle), rule.least)
            out.append((middle - half if rule.below else -math.inf, middle + half if rule.above else math.inf))
        return out

    found = measured(spark, docs)
    got = {r["doc_id"]: r for r in fertility.judge(found, fertility.bands(found)).collect()}
    for i, lang, text, _ in docs:
        if i in figures:
            assert [got[i][m] for m in fertility.BANDS] == pytest.approx(list(figures[i]))
        inside = all(a <= f <= b for f, (a, b) in zip(figures.get(i, ()), band(lang, text or ""), strict=False))
        assert (got[i]["base_failed"], got[i]["kept"]) == (not passed[i], passed[i] and inside), i


def test_columns_named_as_the_bands(spark):
    found = measured(spark, [(1, "en", "word " * 30, 0)]).selectExpr("*", "1 AS lang_band", "2 AS script_band", "3 AS lang_limits")
    row = fertility.judge(found, fertility.bands(found)).first()
    assert (row["lang_band"], row["script_band"], row["lang_limits"]) == (1, 2, 3)


def test_many_languages_and_a_rare_script(spark):
    """Six hundred languages and a script of one text more than none: each has quartiles, none is judged by chance of its rank."""
    rows = [(k, f"l{k % 600}", " ".join(f"word{(k * 31 + j) % 97}" for j in range(40)), 0) for k in range(1800)]
    rows += [(5000 + k, None, "ภาษา ไทย " * 30, 0) for k in range(3)] + [(6000, "l1", " ".join(f"{j * 7919 % 99991:x}\U0001f9ff" for j in range(60)), 0)]
    found = measured(spark, rows)
    bands = {(r["kind"], r["name"]): r["n"] for r in fertility.bands(found).collect()}
    assert sum(kind == "lang" for kind, _ in bands) == 600
    assert ("script", "Latin") in bands and ("all", "") in bands and bands["lang", "l7"] == 3
    few = {r["doc_id"]: r["kept"] for r in fertility.judge(found, fertility.bands(found)).collect()}
    assert all(few[k] for k in range(1800)) and not few[6000]
    again = {r["doc_id"]: r["kept"] for r in fertility.judge(found.repartition(7), fertility.bands(found.repartition(3))).collect()}
    assert few == again


def test_no_row_passes(spark):
    found = measured(spark, [(1, "en", "few words", 0), (2, None, None, 0)])
    assert [r["kept"] for r in fertility.judge(found, fertility.bands(found)).collect()] == [False, False]
    assert fertility.judge(found.limit(0), fertility.bands(found.limit(0))).count() == 0
