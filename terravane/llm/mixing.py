"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws an exponential key, -ln(u) / weight, from its id and its quality weight; small keys
come first. A source whose target is a multiple of its size takes that many complete epochs; the rest
of its budget goes to the documents in the order of their keys, by prefix sums of their sizes.

The prefix sums run over buckets of keys, so that no task holds a source: as the weights have few
levels, the expected share of a source's keys below any value is known exactly, and buckets cut by that
share hold about `bucket_rows` rows each, however the weights are spread.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm.common import WORD, checkpointed

#: Quality weights are multiples of 1 / LEVELS.
LEVELS = 8
#: Characters that ordinary prose hardly has.
ODD = "#*$%&|<>!@^~_={}[]\\0123456789"
MOST_EPOCHS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_level(text: str = "text") -> Column:
    """1 to LEVELS: the squared share of characters outside ODD, rounded up. Null and empty texts get 1."""
    length = F.length(text)
    share = F.length(F.translate(F.col(text), ODD, "")).cast("double") / length
    return F.when(length > 0, F.greatest(F.lit(1), F.ceil(LEVELS * share * share))).otherwise(1).cast("int")


def uniform(key: str, text: str, seed: int) -> Column:
    """A number in (0, 1) from a row's key, or from its text where the key is null."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(text, F.lit(""))))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, source: str = "source") -> DataFrame:
    """sizes (source, source_size, ...) with weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating; targets share the sum of all sizes by
    weight, stop at MOST_EPOCHS times their source's size, and the excess is shared again. A source
    stops exactly if the level (words for each unit of weight) that the others would reach with all
    lower stops taken out isn't below its own stop; the final level is the highest of these.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("long"))
    stop = F.col("source_size") * MOST_EPOCHS
    by_stop = Window.orderBy(stop.cast("double") / F.col("weight"), F.col(source).asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(stop).over(before), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(onward).cast("double")
    leveled = weighed.withColumn("level", level)
    highest = F.max("level").over(everything)
    return leveled.withColumn("target", F.least(stop.cast("double"), highest * F.col("weight"))).drop("level")


def plan(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17, bucket_rows: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (key, source, size, source_size, target, epochs, extra, taken, *keep) for each row of df.

    size is the number of words (null text: 0), epochs the complete passes over the source, extra the
    words of this document that the rest of the budget still takes (a document at the border is taken
    in part), taken = epochs * size + extra. Null sources are one source. Equal keys are ordered by id
    and text; repeated rows count as rows of their own. An empty table gives an empty result.
    """
    sized = df.select(
        F.col(key).alias("key_"), F.col(source).alias("source_"), *keep, word_count(text).alias("size"), quality_level(text).alias("level"),
        uniform(key, text, seed).alias("u"), F.xxhash64(text).alias("tie"),
    )
    rows = checkpointed(sized.withColumn("draw", -F.log("u") * LEVELS / F.col("level")).drop("u"))
    levels = [F.count_if(F.col("level") == k).alias(f"rows_{k}") for k in range(1, LEVELS + 1)]
    sums = rows.groupBy("source_").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), *levels)
    known = checkpointed(targets(sums, "source_"))
    share = reduce(add, (F.col(f"rows_{k}") * (1 - F.exp(-F.col("draw") * k / LEVELS)) for k in range(1, LEVELS + 1))) / F.col("rows")
    buckets = F.ceil(F.col("rows") / bucket_rows)
    joined = rows.join(known.withColumnRenamed("source_", "known_source"), F.col("source_").eqNullSafe(F.col("known_source"))).drop("known_source")
    # A source without words has target zero and no epochs.
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    joined = joined.withColumn("bucket", F.least(buckets - 1, F.floor(share * buckets))).withColumn("epochs", epochs)
    joined = joined.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))).drop("rows", *(f"rows_{k}" for k in range(1, LEVELS + 1)))
    per_bucket = joined.groupBy(F.col("source_").alias("b_source"), F.col("bucket").alias("b_bucket")).agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    within = Window.partitionBy("source_", "bucket").orderBy("draw", "key_", "tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = joined.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = summed.join(offsets, F.col("source_").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("offset") - F.col("before")))
    return placed.withColumn("extra", extra.cast("long")).select(
        F.col("key_").alias(key), F.col("source_").alias(source), *keep, "size", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), "extra",
        (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )


def copies() -> Column:
    """Whole copies of a document: its epochs, and one more if at least half of it fits the rest."""
    return F.col("epochs") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)


def mixed_rows(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **settings) -> DataFrame:
    """The rows of df, each as often as copies() says, in no order; null and empty texts have no words and none.

    All columns of df stay as they are; repeated rows count as rows of their own.
    """
    # The plan is made of numbers that stored rows have; the rows themselves are moved once, to meet their copies.
    stored = checkpointed(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("held"))).withColumn("number", F.monotonically_increasing_id())
    field = lambda c: F.col("held").getField(c)
    planned = plan(stored.select("number", field(key).alias("key"), field(source).alias("source"), field(text).alias("text")), "key", "source", "text", keep=("number",), **settings)
    taken = planned.select("number", copies().cast("int").alias("copies")).where("copies > 0")
    rows = stored.join(taken, "number").select("held", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return rows.select("held.*")


ODD_SQL = ODD.replace("'", "''")
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE WHEN length(text) > 0
              THEN greatest(1, ceil({LEVELS} * (length(translate(text, '{ODD_SQL}', ''))::DOUBLE / length(text)) * (length(translate(text, '{ODD_SQL}', ''))::DOUBLE / length(text))))
              ELSE 1 END AS level,
         (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
drawn AS (SELECT *, -ln(u) * {LEVELS} / level AS draw FROM sized),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sums),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum({MOST_EPOCHS} * source_size) OVER (ORDER BY ({MOST_EPOCHS} * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY ({MOST_EPOCHS} * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM weighed),
known AS (SELECT source, source_size, least(({MOST_EPOCHS} * source_size)::DOUBLE, max(lev) OVER () * weight) AS target FROM leveled),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM known),
placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, floor(b.target - b.epochs * b.source_size) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM drawn d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - earlier)))::BIGINT AS taken FROM placed
"""
