"""Periodic runs of words: a harmonic grid of (period, place) pairs, extended by binary search on prefix hashes.

A run of period p and at least e * p words has at least (e - 1) * p consecutive places whose word equals the one p
further on; so for each period places (e - 1) * p apart are looked at, a harmonic sum over the periods. Where the two
words agree, the longest common extensions to the right and to the left are found for all pairs at once, by binary
search on prefix hashes. Runs are then compared word by word, and of several periods of a stretch the smallest stays.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terravane.llm.common import map_columns
from terravane.llm.spelling import CRC32_SQL, crc32_sql
from terravane.llm.words import POWERS, mixed

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
#: Pairs of the grid that are looked at together.
PAIRS = 1 << 18


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _extended(sums: np.ndarray, up: np.ndarray, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How far the words from `at` on (or before it) equal those a period further on."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        a, b = (at - mid, at) if back else (at, at + mid)
        equal = (sums[b] - sums[a]) * up[period] == sums[b + period] - sums[a + period]
        low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
    return low


def _exact(numbers: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """Start and length of the stretch of the period around `at`, word by word."""
    ahead = np.flatnonzero(numbers[at : len(numbers) - period] != numbers[at + period :])
    behind = np.flatnonzero(numbers[:at] != numbers[period : at + period])
    start = int(behind[-1]) + 1 if len(behind) else 0
    stop = at + int(ahead[0]) if len(ahead) else len(numbers) - period
    return start, stop + period - start


def runs_of(numbers: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of the runs in a sequence of numbers, by start, then period."""
    n = len(numbers)
    none = np.zeros((0, 3), np.int64)
    if n < max(least_length, least_exponent):
        return none
    periods = np.arange(1, n // least_exponent + 1)
    steps = (least_exponent - 1) * periods
    # Pairs of period p are numbered from before[p - 1].
    before = np.concatenate([[0], np.cumsum((n - periods - 1) // steps + 1)])
    up, _ = POWERS.upto(n + 1)
    # Neither the order nor the size of the numbers matters: each gets 64 bits of its own.
    values = mixed(numbers.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:n], dtype=np.uint64)])
    found = [none]
    for first in range(0, int(before[-1]), PAIRS):
        pair = np.arange(first, min(first + PAIRS, int(before[-1])))
        k = np.searchsorted(before, pair, "right") - 1
        at, period = (pair - before[k]) * steps[k], periods[k]
        same = numbers[at] == numbers[at + period]
        at, period = at[same], period[same]
        right = _extended(sums, up, at, period, n - period - at, back=False)
        left = _extended(sums, up, at, period, at, back=True)
        start, length = at - left, left + right + period
        enough = length >= np.maximum(least_length, least_exponent * period)
        found.append(np.unique(np.stack([start, length, period], 1)[enough], axis=0))
    rows = np.concatenate(found)
    # np.unique sorts by start, length, period: of each stretch the first is its smallest period.
    rows = np.unique(rows, axis=0)
    kept = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])] if len(rows) else rows
    if not all(np.array_equal(numbers[s : s + m - p], numbers[s + p : s + m]) for s, m, p in kept):
        # Hashes that agree for different words: all pairs found again word by word.
        exact = np.array([(*_exact(numbers, int(at), int(p)), int(p)) for s, m, p in rows for at in range(s, s + m - p, (least_exponent - 1) * p) if numbers[at] == numbers[at + p]], np.int64).reshape(-1, 3)
        rows = np.unique(exact[exact[:, 1] >= np.maximum(least_length, least_exponent * exact[:, 2])], axis=0)
        kept = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])] if len(rows) else rows
    return kept[np.lexsort((kept[:, 2], kept[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period; a word that any run repeats goes."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def find_runs(df: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, runs: str = "runs", collapsed: str = "collapsed", without: tuple[str, ...] = ()) -> DataFrame:
    """df with the periodic runs of each text and the text without what they repeat.

    runs: array of (start, length, period) in words from 0, by start, then period: stretches with the smallest period
    `period`, of at least least_exponent periods (2 or more) and least_length words, that no neighbouring word extends.
    collapsed: the words that no run holds after its first period, joined by one space.

    Whole texts are looked at. Null and empty texts and those without words have no runs and an empty collapsed text.
    Rows are neither dropped nor merged, repeated ones and null ids included; other columns stay, but for those named
    as an output, which are replaced, and those in `without`. An empty table gives an empty result.
    """
    if least_exponent < 2:
        raise ValueError("a run has at least two periods")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(texts: pa.Array) -> dict[str, pa.Array]:
        spans, left = [], []
        for t in texts:
            # bytes.split parts at space and 0x09-0x0D alone.
            words = (t.as_py() or "").encode("utf-8").split()
            found = runs_of(word_numbers(words), least_length, least_exponent)
            spans.append([{"start": s, "length": m, "period": p} for s, m, p in found.tolist()])
            left.append(b" ".join(compress(words, kept_words(len(words), found)) if len(found) else words).decode("utf-8"))
        return {runs: pa.array(spans, kind), collapsed: pa.array(left, pa.string())}

    return map_columns(df, [text], {runs: "array<struct<start:long,length:long,period:long>>", collapsed: "string"}, rows, without)


#: The query's rows: equal words a period apart, in stretches of consecutive places.
ORACLE = f"""
WITH {CRC32_SQL},
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc32_sql("coalesce(doc_id::VARCHAR, '')")}::BIGINT AS h FROM documents, crc),
sized AS (SELECT *, len(w)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM docs),
planted AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized),
words AS (SELECT r, n, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END) AS word FROM planted),
equal AS (SELECT x.r, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // {LEAST_EXPONENT}),
placed AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM equal),
stretches AS (SELECT r, p, min(i) AS start, count(*) + p AS length FROM placed GROUP BY r, p, g HAVING count(*) + p >= greatest({LEAST_LENGTH}, {LEAST_EXPONENT} * p)),
runs AS (SELECT r, start, length, min(p) AS period FROM stretches GROUP BY ALL),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, t.start::BIGINT AS start, t.length::BIGINT AS length, t.period::BIGINT AS period, (1000 * t.length // t.period)::BIGINT AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l USING (r) LEFT JOIN top t USING (r) LEFT JOIN kept k USING (r)
"""
