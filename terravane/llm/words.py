"""Words of many texts at once, as arrays: hashes, endings and bounds, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes that part words: space and 0x09-0x0D.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
SEED = 77


@lru_cache(maxsize=1)
def _values() -> tuple[np.ndarray, int, int]:
    """A random 64-bit value for each byte, an odd base and its inverse modulo 2^64."""
    rng = np.random.default_rng(SEED)
    values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 5
    return values, base, pow(base, -1, 1 << 64)


class Powers:
    """Powers of the base and its inverse, as far as any text so far has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            _, base, inverse = _values()
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, inverse))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of a 64-bit hash over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buffer = np.frombuffer(b"\n".join([b"", *data, b""]), np.uint8)
    ends_of_texts = np.cumsum([1, *(len(d) + 1 for d in data)])
    blank = BLANK[buffer]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    values, _, _ = _values()
    up, down = POWERS.upto(len(buffer) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[buffer] * up[: len(buffer)], dtype=np.uint64)])
    hashes = mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    last = buffer[stops - 1].astype(np.int64)
    for back, shift in ((2, 8), (3, 16)):
        last |= np.where(stops - starts >= back, buffer[np.maximum(stops - back, 0)], 0).astype(np.int64) << shift
    counts = np.diff(np.searchsorted(starts, ends_of_texts))
    return hashes, last, counts


#: Bytes that are worked on at once.
BLOCK = 1 << 20


def _blocks(data: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Pieces of at most about BLOCK bytes and the text each belongs to; long texts are cut at a blank."""
    pieces, owners, size = [], [], 0
    for k, text in enumerate(data):
        start = 0
        while start < len(text) or start == 0:
            stop = len(text)
            if stop - start > BLOCK:
                found = [i for i in (text.find(b, start + BLOCK) for b in (b" ", b"\n")) if i >= 0]
                stop = min(found, default=len(text))
            pieces.append(text[start:stop])
            owners.append(k)
            size += stop - start
            start = stop
            if size >= BLOCK:
                yield pieces, owners
                pieces, owners, size = [], [], 0
            if not text:
                break
    if pieces:
        yield pieces, owners


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending, number of words of each text) of the words of texts in order, A-Z lower-cased.

    The hash is a 64-bit polynomial in random values of the word's bytes; ending is its last three bytes
    as one number. A word's hash doesn't depend on where it stands.
    """
    hashes, endings, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for pieces, owners in _blocks([(t or "").encode("utf-8").lower() for t in texts]):
        h, e, n = _words(pieces)
        hashes.append(h)
        endings.append(e)
        np.add.at(counts, owners, n)
    return np.concatenate(hashes), np.concatenate(endings), counts
