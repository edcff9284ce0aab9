"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Of two words one edit apart the longer has M code points, and they share their first or their last M // 2:
so every word goes into the groups of its first and last halves, for M its own length and one more, and all
its near words are met there. A group of more than `group_rows` words is halved the same way by what its words
do not share yet, until it is small or one code point is left; no group is bounded by dropping words.

In a group the rests of the words are indexed by their padded bigrams and positions. A word merges the postings of
its bigrams, one position to either side, by a heap and counts how often each earlier word comes up; one edit of a
rest of R code points leaves at least R - 1 of its R + 1 bigrams, so pairs with fewer are no candidates. The rest
are compared as whole words.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import checkpointed

#: A word of lower-cased text.
RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: How many times as frequent as a word its form must be.
RATIO = 5
#: Words of a group that are indexed together; larger groups are halved.
GROUP_ROWS = 512
#: Distinct words that a task holds before it sends their counts on.
HELD_WORDS = 200_000


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change: Callable[[int | str | None, str], str] | None = None) -> DataFrame:
    """word, n: the words of all texts, A-Z lower-cased, of at least least_length code points and least_count occurrences.

    change(key, word) gives what a text's word counts as; it is called for words of at least least_length only.
    Null and empty texts have no words; repeated rows count each time. An empty table has no words. Other columns of
    docs don't matter.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def held() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                # Of bytes only A-Z are lower-cased.
                words = Counter(RUN.findall((t.as_py() or "").encode("utf-8").lower().decode("utf-8")))
                k = k.as_py()
                for word, n in words.items():
                    if len(word) >= least_length:
                        counts[change(k, word) if change else word] += n
                if len(counts) > HELD_WORDS:
                    yield held()
        yield held()

    parts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return parts.where(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halved(rows: DataFrame) -> DataFrame:
    """Rows (word, n, most, lo, hi, key) by the first and by the last half of what is left between lo and hi."""
    half = F.expr("(most - lo - hi) div 2").cast("int")
    start = F.array(
        F.struct((F.col("lo") + half).alias("lo"), F.col("hi"), F.lit(0).alias("side"), F.substring("word", F.col("lo") + 1, half).alias("piece")),
        F.struct("lo", (F.col("hi") + half).alias("hi"), F.lit(1).alias("side"), F.substring("word", F.char_length("word") - F.col("hi") - half + 1, half).alias("piece")),
    )
    parts = rows.select("word", "n", "most", "key", F.explode(start).alias("s"))
    return parts.select("word", "n", "most", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), F.xxhash64("key", "most", "s.side", "s.piece").alias("key"))


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(long) - len(short) > 1 or a == b:
        return False
    at = next((i for i, c in enumerate(short) if c != long[i]), len(short))
    return long[at + 1 :] == short[at if len(short) < len(long) else at + 1 :]


def near_of_group(words: list[str], most: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Places of pairs one edit apart, the longer of length most, among words alike in their first lo and last hi."""
    rest, index = most - lo - hi, defaultdict(list)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for rank, i in enumerate(order):
        word = words[i]
        padded = f"\0{word[lo : len(word) - hi]}\0"
        grams = [(padded[p : p + 2], p) for p in range(len(padded) - 1)]
        if len(word) == most:
            if rest < 2:  # one edit may leave no bigram: all words of the group, an alphabet at most
                found = range(rank)
            else:
                postings = [index[g, p + d] for g, p in grams for d in (-1, 0, 1) if (g, p + d) in index]
                found = [r for r, times in groupby(heapq.merge(*postings)) if sum(1 for _ in times) >= rest - 1]
            for r in found:
                if one_edit(word, words[order[r]]):
                    yield i, order[r]
        for g in grams:
            index[g].append(rank)


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in both directions, of rows that come sorted by key."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    group: list[tuple] = []
    out: list[tuple] = []

    def close() -> None:
        if len(group) > 1:
            words, (_, _, _, most, lo, hi) = [r[1] for r in group], group[0]
            for i, j in near_of_group(words, most, lo, hi):
                out.append((words[i], words[j], group[j][2]))
                out.append((words[j], words[i], group[i][2]))
        group.clear()

    def made() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ([], [], [])
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and (row[0], *row[3:]) != (group[0][0], *group[0][3:]):
                close()
            group.append(row)
        if out:
            yield made()
    close()
    yield made()


def near_words(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """word, near, near_n: each pair of distinct words one edit apart, in both directions; near_n is the other's n.

    words has word (distinct, not null, not empty) and n. No link is lost however many words share a half.
    An empty table gives an empty result.
    """
    length = F.char_length("word").cast("int")
    zero = F.lit(0)
    rows = _halved(words.select("word", "n", F.explode(F.array(length, length + 1)).alias("most"), zero.alias("lo"), zero.alias("hi"), F.lit(0).cast("long").alias("key")))
    ready = None
    while rows is not None:
        by = ["key", "most", "lo", "hi"]
        full = checkpointed(rows.where("most - lo - hi > 1").groupBy(*by).agg(F.count("*").alias("size")).where(F.col("size") > group_rows).drop("size"))
        if full.isEmpty():
            done, rows = rows, None
        else:
            done = rows.join(full, by, "left_anti").select(rows.columns)
            rows = checkpointed(_halved(rows.join(full, by, "left_semi").select(rows.columns)))
        ready = done if ready is None else ready.unionByName(done)
    grouped = ready.select("key", "word", "n", "most", "lo", "hi").repartition("key").sortWithinPartitions("key", "most", "lo", "hi")
    return grouped.mapInArrow(_links, "word string, near string, near_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: the last that following forms leads to. Each round doubles the steps taken."""
    roots = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            return roots
        roots = checkpointed(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(words: DataFrame, ratio: int = RATIO, group_rows: int = GROUP_ROWS) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of words (word, n).

    form is the near word of largest n, the first in code-point order of several, if that n is at least ratio times
    the word's own; else null. root follows forms to the last; a word without form is its own root.
    """
    words = checkpointed(words.select("word", "n"))
    best = near_words(words, group_rows).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    enough: Column = -F.col("best.m") >= ratio * F.col("n")
    found = checkpointed(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).cast("long").alias("form_n"),
        )
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The table of crc32 in SQL, made by its rule. Text here has code points below 0x800.
CRC32_SQL = """
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"""


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an SQL text, where the table of CRC32_SQL is in reach."""
    data = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [192 + (ord(ch)::BIGINT >> 6), 128 + ord(ch)::BIGINT % 64] END))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {data}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) % 256) + 1])))"


ORACLE = f"""
WITH RECURSIVE {CRC32_SQL},
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
         FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, sum(n)::BIGINT AS n
          FROM hashed GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
links AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.part = b.word
          UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.part = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM links GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
                  CASE WHEN b.most >= {RATIO} * w.n THEN (SELECT min(encode(l.near)) FROM links l WHERE l.word = w.word AND l.near_n = b.most) END AS form,
                  CASE WHEN b.most >= {RATIO} * w.n THEN b.most END AS form_n
           FROM words w LEFT JOIN best b USING (word)),
named AS (SELECT word, n, n_near, decode(form) AS form, form_n FROM formed),
walk AS (SELECT word, word AS root FROM named UNION ALL SELECT w.word, f.form FROM walk w JOIN named f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM named f JOIN walk w USING (word) JOIN named r ON r.word = w.root WHERE r.form IS NULL
"""
