"""Cumulative-snapshot collapse of logged conversations, then rendering.

A logger that stores a conversation after every turn leaves all its prefixes. Each conversation gets a
hash of its first 1, 2, ... turns: the running exclusive-or of two 64-bit hashes of (position, role,
text), so a long conversation is hashed in parts that are combined afterwards. A conversation whose whole
hash is a proper prefix's hash of another one, or equals that of one with a smaller id, is dropped by
anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm.common import checkpointed

#: Turn numbers of a part: what one task orders, hashes and renders at once.
PART_TURNS = 256
HASHES = ("p1", "p2")


def _part(turn: str) -> Column:
    return F.floor(F.col(turn) / PART_TURNS)


def _content(role: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(role).isNull(), role, F.col(text).isNull(), text)


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row (conv, position, n, p1, p2) for each turn: the hashes of the conversation's turns up to it.

    Turns are ordered by number (null last), role and content. Rows that repeat a turn in all four
    columns count once; turns that share a number but differ are all kept. Null ids are one conversation.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), _part(turn).alias("part"), _content(role, text, 1).alias("h1"), _content(role, text, 2).alias("h2")).distinct()
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), "h1", "h2"]
    within = Window.partitionBy("conv", "part").orderBy(*order)
    placed = checkpointed(rows.withColumn("place", F.row_number().over(within)).drop("turn", "role"))
    sizes = placed.groupBy("conv", "part").agg(F.count("*").alias("rows"))
    parts = Window.partitionBy("conv").orderBy(F.col("part").asc_nulls_last())
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    starts = sizes.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(whole).alias("n"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    terms = placed.join(starts, same("conv", "c") & same("part", "p")).drop("c", "p").withColumn("position", F.col("start") + F.col("place"))
    terms = terms.select("conv", "part", "n", "position", F.xxhash64("position", "h1").alias("t1"), F.xxhash64(F.lit(3), "position", "h2").alias("t2"))
    totals = terms.groupBy("conv", "part").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    sums = totals.select(F.col("conv").alias("c"), F.col("part").alias("p"), *(F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"o{k}") for k in (1, 2)))
    running = Window.partitionBy("conv", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = terms.select("conv", "part", "n", "position", *(F.bit_xor(f"t{k}").over(running).alias(f"r{k}") for k in (1, 2)))
    joined = local.join(sums, same("conv", "c") & same("part", "p"))
    return joined.select(F.col("conv").alias(conv), "position", "n", *(F.col(f"r{k}").bitwiseXOR(F.col(f"o{k}")).alias(f"p{k}") for k in (1, 2)))


def maximal(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations (conv, n_turns) that are no proper prefix of another and no copy of one with a smaller id."""
    known = checkpointed(prefixes(turns, conv, turn, role, text))
    # Of equal conversations the one with the smallest id stands for all; the null id is the last.
    whole = known.where("position = n").groupBy("n", *HASHES).agg(F.min(conv).alias(conv)).withColumnRenamed("n", "position")
    proper = known.where("position < n").select("position", *HASHES).distinct()
    return whole.join(proper, ["position", *HASHES], "left_anti").select(conv, F.col("position").cast("long").alias("n_turns"))


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The maximal conversations, rendered: one row (conv, part, n_turns, text) for each part of one.

    A part holds the turns of PART_TURNS consecutive turn numbers; turns without a number make the last
    part (null). Parts joined in order are the conversation's text. Null roles are called unknown, null
    texts are empty. An empty table gives an empty result; other columns aren't carried.
    """
    kept = checkpointed(maximal(turns, conv, turn, role, text)).select(F.col(conv).alias("kept_conv"), "n_turns")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), _content(role, text, 1).alias("h1"), _content(role, text, 2).alias("h2"))
    rows = rows.join(kept, F.col("conv").eqNullSafe(F.col("kept_conv")))
    entry = F.struct("turn", "role", "h1", "h2", "text")
    parts = rows.groupBy("conv", _part("turn").alias("part"), "n_turns").agg(F.array_sort(F.collect_set(entry)).alias("entries"))
    lines = F.transform("entries", lambda e: rendered_turn(e["role"], e["text"]))
    return parts.select(F.col("conv").alias(conv), F.col("part").cast("long").alias("part"), "n_turns", F.array_join(lines, "").alias("text"))


ORACLE = f"""
WITH chained AS (
  SELECT conv_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n,
         md5(string_agg(md5(coalesce(role, '') || '|' || coalesce(text, '')), '') OVER w) AS p
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
whole AS (SELECT n, p, min(conv_id) AS conv_id FROM chained WHERE position = n GROUP BY n, p),
kept AS (SELECT conv_id, n FROM whole WHERE NOT EXISTS (SELECT 1 FROM chained c WHERE c.position = whole.n AND c.p = whole.p AND c.position < c.n))
SELECT k.conv_id, floor(c.turn / {PART_TURNS})::BIGINT AS part, k.n AS n_turns,
       string_agg('<|im_start|>' || coalesce(c.role, 'unknown') || chr(10) || coalesce(c.text, '') || '<|im_end|>' || chr(10), '' ORDER BY c.turn) AS text
FROM conversations c JOIN kept k ON c.conv_id = k.conv_id GROUP BY ALL
"""
