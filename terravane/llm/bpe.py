"""Byte-level BPE by dynamic programming over prefixes.

In a BPE encoding every prefix of a text has exactly one valid last token: the token that ends the
encoding of that prefix. A table of these last tokens is built left to right. A token t may end the
prefix of length i if t is its suffix and the pair (last token of the prefix of length i - len(t), t)
would not have been merged otherwise. The encoding is read off backwards. A longer text keeps the
table of its prefix, so bytes can be appended exactly, and an edit recomputes only the entries from the
edit to the point where the table agrees with the old one again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terravane.llm.common import held, map_columns

#: Distinct pieces, prefixes and pairs that a Python worker keeps before it starts anew.
CACHE_PIECES, CACHE_PREFIXES, CACHE_PAIRS = 1 << 17, 1 << 18, 1 << 18
#: Bytes up to which the last tokens of a piece's prefixes are shared with other pieces.
SHARED_BYTES = 64


def ranks(path: str) -> dict[bytes, int]:
    """The ranks in a vocabulary file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """Ranks of byte-level BPE tokens, with the pair from which each was merged."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"a byte-level vocabulary has every byte; {len(missing)} are missing")
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.joined: dict[tuple[int, int], int] = {}
        usable = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = None
                usable[token] = rank
            elif len(pair := self._merged(token, rank)) == 2:
                self.parts[rank] = (pair[0], pair[1])
                self.joined[pair[0], pair[1]] = rank
                usable[token] = rank
        self.usable = usable
        self.longest = max(map(len, usable))
        self._adjacent: dict[tuple[int, int], bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        return cls(ranks(path))

    def _merged(self, token: bytes, below: int) -> list[int]:
        """The ids of a token's bytes after all merges of a rank under its own."""
        pieces = [bytes([b]) for b in token]
        while len(pieces) > 2:
            best = min(range(len(pieces) - 1), key=lambda k: self.ranks.get(pieces[k] + pieces[k + 1], below))
            if self.ranks.get(pieces[best] + pieces[best + 1], below) >= below:
                break
            pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
        return [self.ranks[p] for p in pieces]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the two tokens, as neighbours, are the encoding of their joined bytes."""
        known = self._adjacent.get((left, right))
        if known is None:
            if len(self._adjacent) > CACHE_PAIRS:
                self._adjacent.clear()
            known = self._adjacent[left, right] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        """Undo merges on both sides of the border, last first: no pair across it may merge before that."""
        first_later = len(self.ranks) + 256
        while True:
            if self.joined.get((left, right), first_later) < first_later:
                return False
            left_parts, right_parts = self.parts[left], self.parts[right]
            if left_parts is None and right_parts is None:
                return True
            # Of equal neighbours the left one is merged first, so the right one is undone first.
            if right_parts is None or (left_parts is not None and left > right):
                first_later, left = left, left_parts[1]
            else:
                first_later, right = right + 1, right_parts[0]


class Prefixes:
    """The last tokens of all prefixes of one piece of bytes; grows by appends, follows edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.data = data
        self.last: list[int] = [-1]
        self.recomputed = 0
        self._fill(len(data))

    def _last_token(self, end: int) -> int:
        vocabulary, data, last = self.vocabulary, self.data, self.last
        usable, adjacent = vocabulary.usable, vocabulary._adjacent
        for start in range(max(0, end - vocabulary.longest), end):
            token = usable.get(data[start:end])
            if token is None:
                continue
            if start == 0:
                return token
            pair = (last[start], token)
            fits = adjacent.get(pair)
            if fits or (fits is None and vocabulary.adjacent(*pair)):
                return token
        raise AssertionError("every prefix has a last token")

    def _fill(self, end: int) -> None:
        for i in range(len(self.last), end + 1):
            self.last.append(self._last_token(i))

    def append(self, more: bytes) -> None:
        """Add bytes; entries of the old prefixes stay as they are."""
        self.data += more
        self._fill(len(self.data))

    def edit(self, start: int, end: int, put: bytes) -> None:
        """Replace the bytes from start to end; only entries near the edit are computed."""
        old, shift = self.last, len(put) - (end - start)
        self.data = self.data[:start] + put + self.data[end:]
        self.last = old[: start + 1]
        same, longest = 0, self.vocabulary.longest
        self.recomputed = 0
        for i in range(start + 1, len(self.data) + 1):
            # A last token looks at the entries and bytes of one longest token before it. When as many
            # entries in a row after the edit agree with the old ones, so do all that follow.
            if i - longest > start + len(put) and same >= longest:
                self.last.extend(old[i - shift :])
                return
            token = self._last_token(i)
            self.recomputed += 1
            self.last.append(token)
            same = same + 1 if i > start + len(put) and old[i - shift] == token else 0

    def ids(self) -> list[int]:
        out, end, tokens = [], len(self.data), self.vocabulary.tokens
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(tokens[token])
        return out[::-1]


class Encoder(dict):
    """Piece of text to its ids as int32 bytes.

    Short pieces share one store of last tokens by prefix, so a piece costs only the prefixes that no
    piece before it had; long ones get a table of their own.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern).findall
        self.last: dict[bytes, int] = {}

    def _last_token(self, prefix: bytes) -> int:
        usable, last, adjacent = self.vocabulary.usable, self.last, self.vocabulary._adjacent
        token = usable.get(prefix)
        if token is None:
            for start in range(1, len(prefix)):
                token = usable.get(prefix[start:])
                if token is not None:
                    before = last.get(prefix[:start])
                    if before is None:
                        before = self._last_token(prefix[:start])
                    fits = adjacent.get((before, token))
                    if fits or (fits is None and self.vocabulary.adjacent(before, token)):
                        break
        last[prefix] = token
        return token

    def _ids(self, data: bytes) -> list[int]:
        if len(data) > SHARED_BYTES:
            return Prefixes(self.vocabulary, data).ids()
        out, tokens, last = [], self.vocabulary.tokens, self.last
        while data:
            token = last.get(data)
            if token is None:
                token = self._last_token(data)
            out.append(token)
            data = data[: -len(tokens[token])]
        return out[::-1]

    def __missing__(self, piece: str) -> bytes:
        self[piece] = packed = np.array(self._ids(piece.encode("utf-8")), np.int32).tobytes()
        return packed

    def packed(self, text: str) -> bytes:
        """The ids of a text. Caches are emptied when they are full, within a long text too."""
        found, out = self.pieces(text), []
        for start in range(0, len(found), CACHE_PIECES):
            if len(self) > CACHE_PIECES:
                self.clear()
            if len(self.last) > CACHE_PREFIXES:
                self.last.clear()
            out.append(b"".join(map(self.__getitem__, found[start : start + CACHE_PIECES])))
        return b"".join(out)


def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.read(path), pattern)


@lru_cache(maxsize=1)
def _tokens(path: str) -> dict[int, bytes]:
    """The bytes of each id; decoding may run beside an encoder, so it is no held tool."""
    return {rank: token for token, rank in ranks(path).items()}


def lists(packed: Iterable[bytes]) -> pa.Array:
    """Arrow lists of int32 from their bytes."""
    values = list(packed)
    ends = np.cumsum([0, *map(len, values)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), np.int32)))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids", without: tuple[str, ...] = ()) -> DataFrame:
    """df with the token ids of every text, each match of the pattern encoded for itself.

    A null or empty text has no tokens. Rows are neither merged nor reordered; a column that is
    named as out is replaced, those in `without` are left out. The vocabulary file lies at path on every executor.
    """

    def rows(texts: pa.Array) -> dict[str, pa.Array]:
        of = held(encoder, path, pattern)
        return {out: lists(of.packed(t or "") for t in texts.to_pylist())}

    return map_columns(df, [text], {out: "array<int>"}, rows, without)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded", without: tuple[str, ...] = ()) -> DataFrame:
    """df with the bytes of every list of ids. Null or empty ids give empty bytes; an unknown or null id is an error."""

    def rows(lists_of_ids: pa.Array) -> dict[str, pa.Array]:
        token = _tokens(path).__getitem__
        ids_of_all, ends = lists_of_ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists_of_ids.value_lengths().fill_null(0).to_pylist()])
        return {out: pa.array([b"".join(map(token, ids_of_all[a:b].tolist())) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())}

    return map_columns(df, [ids], {out: "binary"}, rows, without)
