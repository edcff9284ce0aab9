"""Format-preserving pseudonyms by a keyed Feistel permutation.

Values that pass their kind's validation (check digits, octets, calendar) are numbered within the values
of their format, the number is permuted under a key, and the permuted number is written in the same
format. The permutation is one to one and depends on kind, format size and key alone, so equal values get
equal pseudonyms in every document and different values different ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache, partial
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from terravane.llm.common import map_columns

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
SPANS = "array<struct<kind: string, start: int, length: int>>"


class Permutation:
    """A keyed permutation of 0 .. size - 1: an unbalanced Feistel network, walked until it stays inside."""

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        self.size = size
        self.left = isqrt(size - 1) + 1 if size > 1 else 1
        self.right = -(-size // self.left)
        self.width = (max(self.left, self.right).bit_length() + 7) // 8
        self.keyed = hashlib.blake2b(key=key[:64], digest_size=min(64, self.width + 16))
        self.keyed.update(f"{tweak}|{size}|".encode())

    def _round(self, number: int, value: int) -> int:
        state = self.keyed.copy()
        state.update(bytes([number]) + value.to_bytes(self.width, "big"))
        return int.from_bytes(state.digest(), "big")

    def _once(self, value: int) -> int:
        a, b = divmod(value, self.right)
        for i in range(0, ROUNDS, 2):
            a = (a + self._round(i, b)) % self.left
            b = (b + self._round(i + 1, a)) % self.right
        return a * self.right + b

    def _back(self, value: int) -> int:
        a, b = divmod(value, self.right)
        for i in reversed(range(0, ROUNDS, 2)):
            b = (b - self._round(i + 1, a)) % self.right
            a = (a - self._round(i, b)) % self.left
        return a * self.right + b

    def __call__(self, value: int, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The image of value among the valid numbers, value being one; back undoes it."""
        step = self._back if back else self._once
        while True:
            value = step(value)
            if value < self.size and valid(value):
                return value


@lru_cache(maxsize=4096)
def permutation(key: bytes, tweak: str, size: int) -> Permutation:
    return Permutation(key, tweak, size)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def card(value: str, key: bytes, back: bool = False) -> str | None:
    digits = _digits(value)
    payload = digits[:-1]
    if luhn_digit(payload) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(payload)
    other = permutation(key, "card", 10**n)(int(payload), lambda x: len(set(f"{x:0{n}d}")) > 1, back)
    return _refill(value, f"{other:0{n}d}" + luhn_digit(f"{other:0{n}d}"))


def phone(value: str, key: bytes, back: bool = False) -> str | None:
    """The ten digits of a North American number are permuted; country code and punctuation stay."""
    digits = _digits(value)
    head, number = digits[:-10], digits[-10:]
    return _refill(value, head + f"{permutation(key, 'phone', 10**10)(int(number), back=back):010d}")


def social(value: str, key: bytes, back: bool = False) -> str | None:
    def valid(x: int) -> bool:
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    number = int(_digits(value))
    return _refill(value, f"{permutation(key, 'social', 10**9)(number, valid, back):09d}") if valid(number) else None


def address(value: str, key: bytes, back: bool = False) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    other = permutation(key, "ipv4", 1 << 32)(int.from_bytes(bytes(map(int, parts)), "big"), back=back)
    return ".".join(map(str, other.to_bytes(4, "big")))


def day(value: str, key: bytes, back: bool = False) -> str | None:
    """A day of 1900 to 2099, linked across its formats: y-m-d, d.m.y, m/d/y, or d/m/y where the day is over 12.

    A value without leading zeros gets none, so undoing it gives the day, not always its zeros.
    """
    separator = next(c for c in value if not c.isdigit())
    numbers = list(map(int, value.split(separator)))
    if separator == "-":
        order = (0, 1, 2)
    elif separator == "." or numbers[0] > 12:
        order = (2, 1, 0)
    else:
        order = (2, 0, 1)
    european = separator == "/" and order == (2, 1, 0)
    try:
        number = date(*(numbers[i] for i in order)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= number <= LAST_DAY - FIRST_DAY:
        return None

    def valid(x: int) -> bool:
        return not european or date.fromordinal(x + FIRST_DAY).day > 12

    other = date.fromordinal(permutation(key, "day", LAST_DAY - FIRST_DAY + 1)(number, valid, back) + FIRST_DAY)
    parts = [0, 0, 0]
    for i, x in zip(order, (other.year, other.month, other.day), strict=True):
        parts[i] = x
    padded = separator == "-" or all(len(p) > 1 for p in value.split(separator))
    return separator.join(f"{x:02d}" if padded else str(x) for x in parts)


#: What a character may become: (first character, how many).
CLASSES = {**{c: ("0", 10) for c in "0123456789"}, **{c: ("a", 26) for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: ("A", 26) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}


def _characters(value: str, key: bytes, tweak: str, back: bool) -> str:
    """value with its ASCII letters and digits permuted within their classes; anything else stays."""
    classes = [CLASSES.get(c) for c in value]
    number, size = 0, 1
    for c, known in zip(value, classes, strict=True):
        if known:
            number, size = number * known[1] + ord(c) - ord(known[0]), size * known[1]
    if size == 1:
        return value
    shape = "".join(k[0] if k else c for c, k in zip(value, classes, strict=True))
    other = permutation(key, f"{tweak}|{shape}", size)(number, back=back)
    out = []
    for c, known in zip(reversed(value), reversed(classes), strict=True):
        if known:
            other, digit = divmod(other, known[1])
            c = chr(ord(known[0]) + digit)
        out.append(c)
    return "".join(reversed(out))


def mail(value: str, key: bytes, back: bool = False) -> str | None:
    """The part before the @ is permuted for each domain; the domain stays."""
    local, _, domain = value.rpartition("@")
    return f"{_characters(local, key, f'mail|{domain.lower()}', back)}@{domain}"


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def account(value: str, key: bytes, back: bool = False) -> str | None:
    plain = value.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, rest) != check:
        return None
    other = _characters(rest, key, f"iban|{country}", back)
    left = iter(country + _iban_check(country, other) + other)
    return "".join(c if c == " " else next(left) for c in value)


def token(value: str, key: bytes, back: bool = False) -> str | None:
    """A long hexadecimal number of letters and digits, its letters all of one case, which stays."""
    if value.isdigit() or value.isalpha():
        return None
    n = len(value)
    other = f"{permutation(key, 'token', 16**n)(int(value, 16), lambda x: not f'{x:0{n}x}'.isdigit() and not f'{x:0{n}x}'.isalpha(), back):0{n}x}"
    return other.upper() if value.isupper() else other


KINDS = {"card": card, "phone": phone, "social": social, "address": address, "day": day, "mail": mail, "account": account, "token": token}

#: All begin at a digit, plus sign or bracket: the scan skips other characters fast.
NUMBERS = re.compile(
    r"(?P<day>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d))"
    r"|(?P<address>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))"
    r"|(?P<social>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-]?)|(?<![\w+.-])(?:\(\d{3}\) ?|\d{3}[ .-]))\d{3}[ .-]?\d{4}(?!\w))"
    r"|(?P<card>(?<!\w)(?:\d{13,19}|\d{4}([ -])\d{4}\6\d{4}\6\d{1,7}|\d{4}([ -])\d{6}\7\d{5})(?!\w))"
)
MAILS = re.compile(r"(?<![A-Za-z0-9.!#$%&'*+/=?^_`{|}~-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
ACCOUNTS = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
TOKENS = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])")


def _matches(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "mail") for m in MAILS.finditer(text)]
    found += [(m.start(), m.end(), "token") for m in TOKENS.finditer(text)]
    found += [(m.start(), m.end(), "account") for m in ACCOUNTS.finditer(text)]
    found += [(m.start(), m.end(), m.lastgroup) for m in NUMBERS.finditer(text)]
    return found


class Pseudonyms(dict):
    """(kind, value) to its pseudonym, or None where the value isn't valid."""

    def __init__(self, key: bytes, most: int = 100_000) -> None:
        self.key, self.most = key, most

    def __missing__(self, known: tuple[str, str]) -> str | None:
        if len(self) >= self.most:
            self.clear()
        self[known] = made = KINDS[known[0]](known[1], self.key)
        return made

    def rewrite(self, text: str) -> tuple[str, list[dict]]:
        """text with its valid values replaced, and where they stood. Of overlapping ones the first, then the longest, counts."""
        spans, parts, end = [], [], 0
        for start, stop, kind in sorted(_matches(text), key=lambda x: (x[0], -x[1])):
            if start < end or (other := self[kind, text[start:stop]]) is None:
                continue
            parts += [text[end:start], other]
            spans.append({"kind": kind, "start": start, "length": stop - start})
            end = stop
        return ("".join([*parts, text[end:]]) if spans else text), spans


def restore(value: str, kind: str, key: bytes) -> str | None:
    """The value whose pseudonym is given."""
    return partial(KINDS[kind], back=True)(value, key)


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with the valid personal values of every text replaced, and a column with their spans in the old text.

    Covered are the formats of NUMBERS, MAILS, ACCOUNTS and TOKENS: days as y-m-d, d.m.y, m/d/y and d/m/y; IPv4
    addresses; social security numbers; phone numbers of ten digits in groups of 3, 3 and 4, with or without a country
    code; cards; mail addresses; IBANs; hexadecimal numbers of one case. Phone numbers in other groups (+33 1 23 45 67 89)
    and days as y/m/d or d-m-y stay readable.

    Spans have kind, start and length in code points, in order. A null text stays null and has no spans;
    a text without values stays as it is. Numbers that fail validation (check digit, octet over 255, no day
    of the calendar) stay. Other columns and repeated rows stay; a column named as spans is replaced.
    """
    made: list[Pseudonyms] = []

    def rows(texts: pa.Array) -> dict[str, pa.Array]:
        if not made:
            made.append(Pseudonyms(key))
        pairs = [(None, []) if t is None else made[0].rewrite(t) for t in texts.to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        return {text: pa.array([p[0] for p in pairs], pa.string()), spans: pa.array([p[1] for p in pairs], kind)}

    order = [c for c in df.columns if c != spans]
    return map_columns(df, [text], {text: "string", spans: SPANS}, rows).select(*order, spans)
