"""The queries of the package: one for each operator, over the whole of its table."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import bpe, compression, conversations, fertility, logbilinear, mixing, periodic, pseudonyms, rotated, secrets, simhash, spelling, substrings
from terravane.llm.common import WORD, checkpointed, fold, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = _tokenizer("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, without=("text",))
    digits = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_logbilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 7) == 2
    found, vocab = logbilinear.scored(docs, docs.where(~held_out))
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = fertility.measure(docs, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, _tokenizer("piece_bpe_32k.model"), without=("text",))
    measured = checkpointed(measured)
    judged = fertility.judge(measured, fertility.bands(measured))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "chars_per_piece", "fallback_share", "token_entropy",
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 3) == 1
    model = compression.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return compression.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated.links(table(spark, sf_dir, "embeddings"))


def op4_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.collapse(table(spark, sf_dir, "conversations"))


#: Of the queries alone; a user of the operator keeps a key of their own.
DEMONSTRATION_KEY = b"terravane demonstration key"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, DEMONSTRATION_KEY).withColumn("n_values", F.size("spans").cast("long"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept_bytes")).cast("long").alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def planted_typo(key, run: str) -> str:
    """The run, or in one of 199 of (document, run) the run without one code point."""
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    return run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), change=planted_typo)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def planted_period(text: Column, key: Column) -> Column:
    """The text, or in one of ten documents its words up to one, from which on they repeat with a period."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a)), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(WORD), secrets.let(words, repeated)).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.find_runs(docs, without=("text",))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.l")).alias("length"),
        F.col("top.period").alias("period"),
        F.floor(-1000 * F.col("top.l") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


QUERIES = {"op1_logbilinear": op1_logbilinear, "op2_fertility": op2_fertility, "op3_rotated_codes": op3_rotated_codes, "op4_conversations": op4_conversations, "op5_pseudonyms": op5_pseudonyms, "op6_mixing": op6_mixing, "op7_compression": op7_compression, "op8_simhash": op8_simhash, "op9_byte_bpe": op9_byte_bpe, "op10_substrings": op10_substrings, "op11_spelling": op11_spelling, "op12_periodic": op12_periodic, "op13_secrets": op13_secrets}
ORACLE_SQL = {"op3_rotated_codes": rotated.ORACLE, "op4_conversations": conversations.ORACLE, "op6_mixing": mixing.ORACLE, "op11_spelling": spelling.ORACLE, "op12_periodic": periodic.ORACLE, "op13_secrets": secrets.ORACLE}
