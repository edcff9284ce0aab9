"""Quality rules on tokeniser fertility.

Public vocabularies measure each text: characters per byte-level BPE token, characters per piece and
the share of byte-fallback pieces of a sentence-piece vocabulary, and the entropy of the BPE tokens. A
text is rejected if a figure lies outside the band of its language, or of its script where the language is
unknown; the quartiles of rare ones are drawn toward the script's. Bands are the corpus's own: median plus or minus a
multiple of the spread between its quartiles, and never narrower than a share of the median.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm import bpe
from terravane.llm.common import checkpointed, free_name, held, map_columns

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW_WORDS = 8
#: Rows of the wider group that a language's and a script's quartiles are drawn toward.
BORROWED = 50
#: Languages that are broadcast; with more the join is shuffled. The same rows come back either way.
BROADCAST_LANGUAGES = 10_000

MEASURES = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "script": "string",
    "chars_per_token": "double",
    "chars_per_piece": "double",
    "fallback_share": "double",
    "token_entropy": "double",
}


@dataclass(frozen=True)
class Band:
    """How a figure's band is drawn: spreads from the median, at least so wide, and on which sides."""

    spreads: float
    least_share: float
    least: float = 0.0
    below: bool = True
    above: bool = True


BANDS = {
    "chars_per_token": Band(8, 0.10),
    "chars_per_piece": Band(8, 0.10),
    "fallback_share": Band(8, 0.0, least=0.10, below=False),
    "token_entropy": Band(8, 0.30, above=False),
}

#: Scripts by which languages without a band are judged.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")


@lru_cache(maxsize=1)
def _script_patterns() -> tuple[tuple[str, regex.Pattern], ...]:
    return tuple((s, regex.compile(rf"\p{{Script={s}}}+")) for s in SCRIPTS)


def script_of(text: str) -> str:
    """The script of most letters of a text: plain ASCII text is Latin, text without letters Other."""
    if text.isascii():
        return "Latin" if regex.search("[A-Za-z]", text) else "Other"
    letters = regex.sub(r"\P{L}+", "", text)
    most, name = 0, "Other"
    left = len(letters)
    for script, pattern in _script_patterns():
        if left <= most:
            break
        n = sum(map(len, pattern.findall(letters)))
        left -= n
        if n > most:
            most, name = n, script
    return name


def repeated_words(words: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words that lie in a window of `width` words that occurs twice or more, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    ids = (ids ^ (ids >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    order = np.argsort(windows)
    same = np.flatnonzero(windows[order[1:]] == windows[order[:-1]])
    if not len(same):
        return 0
    twice = np.zeros(n, bool)
    twice[order[same]] = twice[order[same + 1]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(covered)[:-1]))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


class Tokenizers:
    """The two public vocabularies, each read by its own library."""

    def __init__(self, bpe_path: str, pattern: str, piece_path: str) -> None:
        import sentencepiece
        import tiktoken

        self.bpe = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=bpe.ranks(bpe_path), special_tokens={}).encode_to_numpy
        model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.pieces = model.encode
        self.fallback = np.array([model.is_byte(i) for i in range(model.vocab_size())])


def _measure(text: str, of: Tokenizers) -> tuple:
    words = text.encode("utf-8").split()
    base = (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(words),
    )
    if not words:
        return (*base, "Other", None, None, None, None)
    ids = of.bpe(text, disallowed_special=())
    pieces = np.array(of.pieces(text, num_threads=1), np.int64)
    counts = np.bincount(ids)
    counts = counts[counts > 0]
    entropy = float(np.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids))
    n = max(1, len(pieces))
    return (*base, script_of(text), len(text) / len(ids), len(text) / n, float(of.fallback[pieces].sum()) / n, entropy)


def measure(df: DataFrame, bpe_path: str, pattern: str, piece_path: str, text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns of MEASURES for each whole text.

    A null or wordless text has zero counts and null token figures. Columns of df that have the name of
    a measure are replaced, those in `without` left out; repeated rows each come back. The vocabulary files lie at their paths on every executor.
    """

    def rows(texts: pa.Array) -> dict[str, pa.Array]:
        of = held(Tokenizers, bpe_path, pattern, piece_path)
        made = [_measure(t or "", of) for t in texts.to_pylist()]
        columns = zip(*made, strict=True) if made else [()] * len(MEASURES)
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        return {c: pa.array(values, kinds[kind]) for (c, kind), values in zip(MEASURES.items(), columns, strict=True)}

    return map_columns(df, [text], MEASURES, rows, without)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _limits(quartiles: dict[str, Column]) -> Column:
    """A struct of the bounds of each figure (null: none), from its quartiles <figure>_0 to <figure>_2."""
    sides = []
    for m, rule in BANDS.items():
        low, middle, high = (quartiles[f"{m}_{k}"] for k in range(3))
        half = F.greatest(rule.spreads * (high - low) / 1.349, rule.least_share * F.abs(middle), F.lit(float(rule.least)))
        none = F.lit(None).cast("double")
        sides += [(middle - half if rule.below else none).alias(f"{m}_from"), (middle + half if rule.above else none).alias(f"{m}_to")]
    return F.struct(*sides)


def bands(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """(kind, name, n, <figure>_0, _1, _2): quartiles of each language, of each script and of all rows that pass the base rules.

    kind is lang, script or all. Figures are rounded to thousandths and counted, so that quartiles are exact and a rerun finds
    the same ones; a group has as many distinct values as the figures' range has thousandths. No group is left out. Rows with a
    null language count for their script and for all.
    """
    groups = F.explode(F.array(F.struct(F.lit("lang").alias("kind"), F.col(lang).cast("string").alias("name")), F.struct(F.lit("script").alias("kind"), F.col("script").alias("name")), F.struct(F.lit("all").alias("kind"), F.lit("").alias("name"))))
    figures = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.floor(F.col(m) * 1000 + 0.5).alias("v")) for m in BANDS)))
    rows = measured.where(~base_failed()).select(groups.alias("g"), *BANDS).where("g.name IS NOT NULL").select("g.kind", "g.name", figures.alias("f"))
    counts = rows.where("f.v IS NOT NULL").groupBy("kind", "name", F.col("f.m").alias("m"), F.col("f.v").alias("v")).agg(F.count("*").alias("c"))
    group = Window.partitionBy("kind", "name", "m")
    placed = counts.withColumn("upto", F.sum("c").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("c").over(group))
    found = placed.groupBy("kind", "name", "m").agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("v") / 1000)).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))))
    own = [F.max(F.when(F.col("m") == m, F.col(f"q{k}"))).alias(f"{m}_{k}") for m in BANDS for k in range(3)]
    return found.groupBy("kind", "name").agg(F.max("n").alias("n"), *own)


def judge(measured: DataFrame, found: DataFrame, lang: str = "lang") -> DataFrame:
    """measured with base_failed and kept, by the quartiles that bands found.

    A script's quartiles are drawn toward those of all rows, and a language's toward its row's script's, as if each had
    BORROWED rows of these: a group's own count however few its rows are, and no row more or less makes another rule
    apply. Rows with a null language are judged by their script. A figure that is null is in every band. Columns of
    measured named base_failed or kept are replaced, others stay. Repeated rows each come back; an empty table gives
    an empty result.
    """
    found = checkpointed(found)
    quartiles = [f"{m}_{k}" for m in BANDS for k in range(3)]
    all_rows = found.where("kind = 'all'").first()
    failed = base_failed()
    if all_rows is None:  # no row passes
        return measured.withColumn("base_failed", failed).withColumn("kept", F.lit(False))
    names = {kind: (free_name(measured, f"{kind}_band"), free_name(measured, f"{kind}_limits")) for kind in ("lang", "script")}
    joined = measured
    for kind, column, most in (("lang", lang, BROADCAST_LANGUAGES), ("script", "script", len(SCRIPTS) + 1)):
        band, held_ = names[kind]
        side = found.where(F.col("kind") == kind).select(F.col("name").alias(band), F.struct("n", *quartiles).alias(held_))
        side = F.broadcast(side) if side.limit(most + 1).count() <= most else side
        joined = joined.join(side, F.col(f"`{column}`").cast("string") == F.col(band), "left")

    def drawn(kind: str, toward: dict[str, Column]) -> dict[str, Column]:
        own = F.col(f"`{names[kind][1]}`")
        n = own["n"].cast("double")
        return {q: F.coalesce((n * own[q] + BORROWED * toward[q]) / (n + BORROWED), toward[q]) for q in quartiles}

    script = drawn("script", {q: F.lit(all_rows[q]).cast("double") for q in quartiles})
    limits = free_name(joined, "limits")
    inside = F.lit(True)
    for m in BANDS:
        at = F.col(f"`{limits}`")
        inside = inside & F.coalesce(F.col(m) >= at[f"{m}_from"], F.lit(True)) & F.coalesce(F.col(m) <= at[f"{m}_to"], F.lit(True))
    judged = joined.withColumn(limits, _limits(drawn("lang", script)))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & inside).drop(limits, *(c for n in names.values() for c in n))
