"""Parsing of free text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of place names that say what a place is.
KIND_ENDINGS = (
    "mäki", "vuori", "vaara", "kallio", "kangas", "harju", "kumpu", "selkä", "laki", "kukkula", "nyppylä", "huippu",
    "mäet", "vuoret", "kalliot", "harjut", "vaarat", "kankaat", "tunturit",
    "berg", "backe", "klint", "ås", "holm",
    "tunturi", "duottar", "várri", "váárr", "vaarâ", "oaivi", "čohkka", "kero", "rova", "čielgi", "gaisi", "gáisá",
)


def leading_number(text: Column) -> Column:
    """The number a text begins with, its comma a point; null where it begins with none."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def strict_number(text: Column) -> Column:
    """A text that is a number as a whole, with point or comma, else null."""
    plain = F.replace(text, F.lit(","), F.lit("."))
    return F.when(F.trim(plain).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(plain).try_cast("double"))


def key_values(text: Column) -> Column:
    """Map of a "key: value, key: value" text, records parted by a backslash and n. Of equal keys the first counts."""
    parts = F.flatten(F.transform(F.split(text, r"\\n"), lambda r: F.split(r, ",")))
    pairs = F.transform(F.filter(parts, lambda p: p.contains(":")), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.substr(p, F.instr(p, ":") + 1)).alias("value")))
    none = F.array().cast("array<struct<key: string, value: string>>")
    first = F.aggregate(pairs, none, lambda seen, p: F.when(F.exists(seen, lambda s: s["key"] == p["key"]), seen).otherwise(F.array_append(seen, p)))
    return F.map_from_entries(F.coalesce(first, none))


def kind_of(name: Column, endings: tuple[str, ...] = KIND_ENDINGS) -> Column:
    """The longest ending that a name has, final full stops aside, else null."""
    plain = F.rtrim(F.lower(name), F.lit("."))
    found = F.coalesce(*(F.when(plain.endswith(e), e) for e in sorted(endings, key=len, reverse=True)))
    return found


def tag(element: Column, name: str) -> Column:
    """The text of the first element of a name in an XML fragment, else null."""
    return F.nullif(F.regexp_extract(element, rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>", 1), F.lit(""))


def wrap32(value: Column) -> Column:
    """Unsigned 32-bit ids as signed ones; others stay."""
    return F.when(value >= 2**31, value - 2**32).otherwise(value)


def age_days(stamp: Column, now: Column) -> Column:
    """Days from an ISO stamp to a time; null where the stamp can't be read."""
    return (F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(stamp))) / 86400.0
