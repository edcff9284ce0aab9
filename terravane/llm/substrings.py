"""Exact removal of repeated substrings: suffixes are sorted bucket by bucket, with ranks of a difference cover.

Every byte covered by a string of `WIDTH` bytes that starts earlier in the corpus is found as a suffix array
would find it: equal strings are neighbours after sorting. Only suffixes that can matter are sorted, one bucket at
a time, so that memory is bounded by a bucket; where they stand in a bucket follows from hashes of their bytes, as any
order does that puts equal strings side by side.

The cover: of any `PERIOD` positions in a row those at the residues of `COVER` are sampled. Every distance is that of two
residues, so two equal strings, wherever they start, have sampled positions at one common offset under PERIOD. From
there they agree in at least `GRAM` bytes.

1. The samples' first GRAM bytes are sorted. A string none of whose samples is found twice is found once itself.
2. The samples that are found twice are ranked by their first `REACH` bytes. A sample whose rank occurred earlier
   settles the ties of all strings that start in the PERIOD positions from it: they occurred earlier too. Long matches
   are thus decided by the ranks of the sample, without a look at their other suffixes.
3. Around samples near which strings are still undecided the `MIDDLE` bytes are sorted that the strings share which start within
   `STEP` bytes. Where no other undecided place has them, these strings stand alone: the first occurrence of a string is
   undecided too, so it would be found.
4. The strings that no rule has decided (at the ends of matches) are sorted themselves.

In each round a chunk of texts sends equal strings once, so a passage that stands everywhere meets itself as often as there
are chunks. Strings are compared by the number of their bucket and 80 further bits of two independent hashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.words import mixed

#: Bytes of the strings that count as repeated.
WIDTH = 100
#: A perfect difference set: the residues' differences are every number under PERIOD once.
PERIOD, COVER = 73, np.array([1, 2, 4, 8, 16, 32, 37, 55, 64])
GRAM, REACH = WIDTH - PERIOD + 1, WIDTH + PERIOD - 1
#: Strings that hold a sample at offsets from a multiple of STEP to the next one share MIDDLE bytes around it.
STEP = (PERIOD - 1) // 4
MIDDLE = WIDTH - STEP
#: Bytes that are hashed at once; bounds of a chunk's bytes and of a bucket's strings, within which both grow with the corpus.
BLOCK, CHUNK_BYTES, BUCKET_STRINGS = 1 << 20, (1 << 22, 1 << 25), (1 << 19, 1 << 23)
#: The part of a chunk's size, or a bucket's, in the whole: many chunks and buckets, but cells of some size between them.
PARTS = 1 << 12
#: Bits of hashes that only sift; those of ranks and strings have 64, and bytes of a second hash.
SIFT_BITS, SECOND_BYTES = 48, 2
GRAMS, RANKS, MIDDLES, STRINGS = 1, 2, 3, 4


@lru_cache(maxsize=2)
def _family(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, and the powers of a random odd base and of its inverse modulo 2^64."""
    rng = np.random.default_rng([77, number])
    values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 5
    powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + REACH, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))]
    return values, *powers


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, number: int) -> np.ndarray:
    """Position-free hashes of substrings of at most REACH bytes, starts ascending; `number` names one of two families."""
    values, up, down = _family(number)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(starts, base + BLOCK))
        block = data[base : int(stops[at:to].max())]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values[block] * up[: len(block)], dtype=np.uint64)])
        a, b = starts[at:to] - base, stops[at:to] - base
        out[at:to] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def _planes(values: np.ndarray, n: int = 8) -> bytes:
    """The low n bytes of numbers, all first bytes first: bytes that are always zero then cost nothing when compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _numbers(data: bytes, n: int = 8) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(n, -1).T
    return out.view("<u8").ravel()


def _first(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted keys differ from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


@dataclass
class Sifted:
    """Strings by the first bits of their hashes: in sorted order each once, which of these each string is, and how many are."""

    known: np.ndarray
    of: np.ndarray
    counts: np.ndarray

    @classmethod
    def sort(cls, hashed: np.ndarray) -> Sifted:
        return cls(*np.unique(hashed >> np.uint64(64 - SIFT_BITS), return_inverse=True, return_counts=True))

    def twice(self, elsewhere: np.ndarray) -> np.ndarray:
        """Which strings are found twice, here or, as is said of each known one, elsewhere."""
        return (elsewhere | (self.counts > 1))[self.of]


@dataclass
class Strings:
    """Strings of a chunk by hash: in sorted order those that stand first in the chunk, and for each string which of these equals it."""

    high: np.ndarray
    low: np.ndarray
    text: np.ndarray
    of: np.ndarray
    leads: np.ndarray

    @classmethod
    def sort(cls, high: np.ndarray, low: np.ndarray, text: np.ndarray) -> Strings:
        """Strings in order of place, with 64 and 16 bits of their hashes and their texts."""
        order = np.lexsort((low, high))
        new = _first(high[order], low[order])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        lead = order[new]
        leads = np.zeros(len(order), bool)
        leads[lead] = True
        return cls(high[lead], low[lead], text[lead], number, leads)


class Chunk:
    """Different texts in order of place, one after the other in one array, and the sampled positions."""

    def __init__(self, table: pa.Table) -> None:
        self.number = table.column("chunk")[0].as_py()
        places, refs = table.column("place").to_numpy(), table.column("ref").to_numpy()
        order = np.lexsort((refs, places))
        new = _first(places[order], refs[order])
        self.of_row = np.empty(len(order), np.int64)
        self.of_row[order] = np.cumsum(new) - 1
        self.places = places[order[new]]
        column = table.column("data").combine_chunks()
        texts = [column[int(i)].as_py() or b"" for i in order[new]]
        self.bounds = np.cumsum([0, *map(len, texts)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        longest = max(map(len, texts), default=0)
        offsets = (np.arange(0, longest + PERIOD, PERIOD)[:, None] + COVER).ravel()
        counts = np.searchsorted(offsets, np.array([len(t) - GRAM if len(t) >= WIDTH else -1 for t in texts]), "right")
        self.samples = np.concatenate([np.zeros(0, np.int64), *(offsets[:n] + a for n, a in zip(counts, self.bounds, strict=False))])
        self.sample_text = np.repeat(np.arange(len(texts)), counts)
        self.grams = Sifted.sort(hashes(self.data, self.samples, self.samples + GRAM, 0))

    def _strings(self, starts: np.ndarray, stops: np.ndarray, text: np.ndarray) -> Strings:
        low = hashes(self.data, starts, stops, 1) & np.uint64((1 << 8 * SECOND_BYTES) - 1)
        return Strings.sort(hashes(self.data, starts, stops, 0), low, text)

    def rank(self, elsewhere: np.ndarray) -> None:
        """Take in which grams are found elsewhere; the samples of those found twice are ranked."""
        some = self.grams.twice(elsewhere)
        self.found, self.found_text = self.samples[some], self.sample_text[some]
        self.reach = np.minimum(self.found + REACH, self.bounds[self.found_text + 1])
        self.ranks = self._strings(self.found, self.reach, self.found_text)

    def decide(self, earlier: np.ndarray) -> None:
        """Take in which ranks occurred elsewhere before; what lies around samples near undecided strings is sifted."""
        later = (earlier[self.ranks.of] | ~self.ranks.leads) & (self.reach - self.found >= WIDTH)
        self.repeated = _marked(len(self.data), self.found[later], self.reach[later] - WIDTH + 1)
        # The places of middles, each once: several samples may share one. Strings around it start in [low, high].
        steps = np.arange(0, PERIOD - 1, STEP)[:, None]
        starts, text = (self.found - steps).ravel(), np.tile(self.found_text, len(steps))
        inside = starts >= self.bounds[text]
        starts, first = np.unique(starts[inside], return_index=True)
        text = text[inside][first]
        self.low, self.high = np.maximum(starts - STEP, self.bounds[text]), np.minimum(starts, self.bounds[text + 1] - WIDTH)
        undecided = np.concatenate([[0], np.cumsum(~self.repeated)])
        some = self.high >= self.low
        some[some] = undecided[self.high[some] + 1] > undecided[self.low[some]]
        starts, self.low, self.high = starts[some], self.low[some], self.high[some]
        self.middles = Sifted.sort(hashes(self.data, starts, starts + MIDDLE, 0))

    def narrow(self, elsewhere: np.ndarray) -> None:
        """Take in which middles are found elsewhere; undecided strings around those found twice are open."""
        some = self.middles.twice(elsewhere)
        self.open = np.flatnonzero(_marked(len(self.data), self.low[some], self.high[some] + 1) & ~self.repeated)
        self.strings = self._strings(self.open, self.open + WIDTH, np.searchsorted(self.bounds, self.open, "right") - 1)

    def settle(self, earlier: np.ndarray) -> np.ndarray:
        """Take in which open strings occurred elsewhere before; the bytes that repeated strings cover."""
        self.repeated[self.open[earlier[self.strings.of] | ~self.strings.leads]] = True
        starts = np.flatnonzero(self.repeated)
        return _marked(len(self.data), starts, starts + WIDTH)


def _marked(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n positions lie in an interval."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _cells(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The buckets of ascending numbers, and where each begins and ends."""
    cuts = np.flatnonzero(_first(bucket))
    ends = [*cuts.tolist(), len(bucket)]
    return bucket[cuts], list(zip(ends, ends[1:], strict=False))


def _deal(chunk: int, bucket: np.ndarray, columns: dict[str, tuple[np.ndarray, int]]) -> pa.Table:
    """A row for each bucket with the low bytes of its strings' numbers."""
    found, cells = _cells(bucket)
    data = {c: pa.array([_planes(v[a:b], n) for a, b in cells], pa.binary()) for c, (v, n) in columns.items()}
    return pa.table({"chunk": pa.array([chunk] * len(cells), pa.int64()), "bucket": pa.array(found, pa.int64()), **data})


def _sift_bucket(known: np.ndarray, buckets: int) -> np.ndarray:
    return (known >> np.uint64(SIFT_BITS - 24)).astype(np.int64) * buckets >> 24


def _bucket(high: np.ndarray, buckets: int) -> np.ndarray:
    return (high >> np.uint64(40)).astype(np.int64) * buckets >> 24


def _steps(values: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, each bucket's first as it is."""
    steps, firsts = np.diff(values, prepend=np.uint64(0)), np.flatnonzero(_first(bucket))
    steps[firsts] = values[firsts]
    return steps


def _deal_sifted(number: int, sifted: Sifted, buckets: int) -> pa.Table:
    bucket = _sift_bucket(sifted.known, buckets)
    return _deal(number, bucket, {"known": (_steps(sifted.known, bucket), SIFT_BITS // 8)})


def _deal_strings(chunk: Chunk, strings: Strings, buckets: int) -> pa.Table:
    bucket = _bucket(strings.high, buckets)
    return _deal(chunk.number, bucket, {"high": (_steps(strings.high, bucket), 8), "low": (strings.low, SECOND_BYTES), "place": (chunk.places[strings.text], 8)})


SIFTED, DEALT = "chunk long, bucket long, known binary", "chunk long, bucket long, high binary, low binary, place binary"
ANSWER = "chunk long, kind int, bucket long, answer binary"


def _answer(table: pa.Table, kind: int, lengths: list[int], said: np.ndarray) -> pa.Table:
    ends = np.cumsum([0, *lengths])
    parts = [np.packbits(said[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([kind] * table.num_rows, pa.int32()), "bucket": table.column("bucket"), "answer": pa.array(parts, pa.binary())})


def _sort_sifted(kind: int):
    def run(table: pa.Table) -> pa.Table:
        """For each string of a bucket: whether another chunk has it."""
        parts = [np.cumsum(_numbers(x.as_py(), SIFT_BITS // 8), dtype=np.uint64) for x in table.column("known")]
        _, of, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        return _answer(table, kind, [len(p) for p in parts], (counts > 1)[of])

    return run


def _sort_strings(kind: int):
    def run(table: pa.Table) -> pa.Table:
        """For each string of a bucket: whether an equal one has an earlier place."""
        parts = [_numbers(x.as_py()) for x in table.column("place")]
        place = np.concatenate(parts).view(np.int64)
        high = np.concatenate([np.cumsum(_numbers(x.as_py()), dtype=np.uint64) for x in table.column("high")])
        low = np.concatenate([_numbers(x.as_py(), SECOND_BYTES) for x in table.column("low")])
        order = np.lexsort((place, low, high))
        said = np.empty(len(order), bool)
        said[order] = ~_first(high[order], low[order])
        return _answer(table, kind, [len(p) for p in parts], said)

    return run


def _said(answers: list[dict], kind: int, bucket: np.ndarray) -> np.ndarray:
    """The answers to what was dealt to ascending buckets."""
    found, cells = _cells(bucket)
    parts = {r["bucket"]: r["answer"] for r in answers if r["kind"] == kind}
    out = np.zeros(len(bucket), bool)
    for number, (a, b) in zip(found.tolist(), cells, strict=True):
        out[a:b] = np.unpackbits(np.frombuffer(parts[number], np.uint8), count=b - a).astype(bool)
    return out


def _grams_kernel(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        return _deal_sifted(chunk.number, chunk.grams, buckets)

    return run


def _told(table: pa.Table, answers: pa.Table, buckets: int, rounds: int) -> tuple[Chunk, list[dict]]:
    """A chunk that has taken in the answers of the first rounds."""
    chunk, said = Chunk(table), answers.to_pylist()
    chunk.rank(_said(said, GRAMS, _sift_bucket(chunk.grams.known, buckets)))
    if rounds > 1:
        chunk.decide(_said(said, RANKS, _bucket(chunk.ranks.high, buckets)))
    if rounds > 2:
        chunk.narrow(_said(said, MIDDLES, _sift_bucket(chunk.middles.known, buckets)))
    return chunk, said


def _deal_kernel(buckets: int, rounds: int):
    """What a chunk sends out after so many rounds: ranks, middles, strings."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c in ("chunk", "bucket") else pa.binary()) for c in ("chunk", "bucket", *(("known",) if rounds == 2 else ("high", "low", "place")))})
        chunk, _ = _told(table, answers, buckets, rounds)
        if rounds == 2:
            return _deal_sifted(chunk.number, chunk.middles, buckets)
        return _deal_strings(chunk, chunk.ranks if rounds == 1 else chunk.strings, buckets)

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _removal_kernel(buckets: int, kept: list[str]):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        if table.num_rows:
            chunk, said = _told(table, answers, buckets, 3)
            gone = chunk.settle(_said(said, STRINGS, _bucket(chunk.strings.high, buckets)))
            edge = np.zeros(len(gone) + 1, bool)
            edge[chunk.bounds] = True
            before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
            starts, stops = np.flatnonzero(gone & (~before | edge[:-1])), np.flatnonzero(gone & (~after | edge[1:])) + 1
            cuts = np.searchsorted(starts, chunk.bounds)
            for k, (a, b) in enumerate(zip(chunk.bounds, chunk.bounds[1:], strict=False)):
                spans = slice(cuts[k], cuts[k + 1])
                made.append((chunk.data[a:b][~gone[a:b]].tobytes(), [{"start": int(x - a), "length": int(y - x)} for x, y in zip(starts[spans], stops[spans], strict=True)]))
            made = [made[i] for i in chunk.of_row]
        return pa.table({**{c: table.column(c) for c in kept}, "removed_spans": pa.array([r[1] for r in made], SPANS), "kept_bytes": pa.array([r[0] for r in made], pa.binary())})

    return run


def _parts(whole: int, bounds: tuple[int, int]) -> int:
    """Into how many parts a whole goes, of sizes within the bounds."""
    return max(1, -(-whole // min(max(whole // PARTS, bounds[0]), bounds[1])))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n_bytes, removed_spans, kept_bytes) for each row of docs.

    Texts are UTF-8 bytes, null is empty. Removed is each byte of a string of WIDTH bytes that also starts in
    a text of smaller key, or earlier in the same text. Null keys come after all others, in an order
    fixed by their texts. Rows that repeat key and text are one document, and each comes back; different
    texts of one key are in an order fixed by the texts. Spans are maximal. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("key_"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()
    chunks, buckets = _parts(size + 100 * n, CHUNK_BYTES), _parts(size * len(COVER) // PERIOD, BUCKET_STRINGS)
    rows = rows.withColumn("ref", F.xxhash64("data"))
    place = F.coalesce("key_", F.lit(1 << 62) + F.shiftrightunsigned("ref", 2))
    rows = rows.select("key_", "ref", place.alias("place"), "data").withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("key_", "ref")), F.lit(chunks)))
    texts = rows.groupBy("chunk")
    said = texts.applyInArrow(_grams_kernel(buckets), SIFTED).groupBy("bucket").applyInArrow(_sort_sifted(GRAMS), ANSWER)
    for rounds, kind, schema in ((1, RANKS, DEALT), (2, MIDDLES, SIFTED), (3, STRINGS, DEALT)):
        dealt = texts.cogroup(said.groupBy("chunk")).applyInArrow(_deal_kernel(buckets, rounds), schema)
        said = said.unionByName(dealt.groupBy("bucket").applyInArrow(_sort_sifted(kind) if kind == MIDDLES else _sort_strings(kind), ANSWER))
    out = texts.cogroup(said.groupBy("chunk")).applyInArrow(_removal_kernel(buckets, ["key_"]), "key_ long, removed_spans array<struct<start: long, length: long>>, kept_bytes binary")
    length = F.octet_length("kept_bytes") + F.coalesce(F.aggregate("removed_spans", F.lit(0).cast("long"), lambda s, x: s + x["length"]), F.lit(0))
    return out.select(F.col("key_").alias(key), length.cast("long").alias("n_bytes"), "removed_spans", "kept_bytes")
