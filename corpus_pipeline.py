"""The corpus pipeline: quality rules, near-duplicates, pseudonyms, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes to the warehouse and
reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import bpe, fertility, mixing, pseudonyms, simhash
from terravane.llm.common import checkpointed
from terravane.session import remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BPE = "byte_bpe_50k.tiktoken"
#: Of the pipeline over test tables alone.
DEMONSTRATION_KEY = b"terravane demonstration key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's or script's fertility bands.

    Null, empty and short texts fail the base rules and go. A null language is judged by its script, a rare one nearly so.
    Repeated rows, null ids included, all stay or all go. An empty table gives an empty result.
    """
    named = docs.select(COLUMNS).withColumn("tid", F.md5(F.coalesce("text", F.lit(""))))
    parts = named.select("doc_id", "tid", "lang", "text")
    measured = checkpointed(fertility.measure(parts, public_tokenizers.path(BPE), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"), without=("text",)))
    judged = fertility.judge(measured, fertility.bands(measured)).where("kept")
    # The verdict follows from text and language; the id is in the key to part the copies of a text.
    kept = judged.select(F.col("doc_id").alias("kept_id"), F.col("tid").alias("kept_text"), F.col("lang").alias("kept_lang")).distinct()
    same = (F.col("tid") == F.col("kept_text")) & F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("lang").eqNullSafe(F.col("kept_lang"))
    return named.join(kept, same, "left_semi").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Candidates share a deletion variant of a segment of one of ten fingerprints of their sets of five-word shingles, at most
    eleven bits apart; a pair is linked if the sets are at least 0.8 alike. Null, empty and wordless texts are one group.
    A null id counts as the largest; of rows that repeat id and text one stays. An empty table gives an empty result.
    """
    return simhash.representatives(docs, bits=11, prints=10, shingle=5, similarity=0.8)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal values replaced by pseudonyms; n_chars follows the text.

    Null texts stay null, with a null n_chars. Rows are neither dropped nor merged; ids may be null or repeat.
    """
    return pseudonyms.pseudonymise(docs, DEMONSTRATION_KEY).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: complete epochs, and one more copy of those whose larger half the rest takes.

    Texts without words, null ones too, have size zero and are not taken. A null source is a source of its own.
    Repeated rows are drawn as one row each. An empty table gives an empty result.
    """
    return mixing.mixed_rows(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, token_ids and n_tokens of each row. Null and empty texts have no tokens; rows may repeat."""
    ids = bpe.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path(BPE), public_tokenizers.PATTERN, without=("text",))
    return ids.select("doc_id", "source", "lang", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("PII", pii), ("mixing", mix), ("byte-level BPE", encode)]

#: SQL can express neither the tokenisers nor the links; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; of the stages' folders only the last one's stays."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/corpus_pipeline_{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
