"""Order statistics and row numbers of large groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.session import Rounds, checkpointed

#: Ranges that a round counts in; each holds the values that fall into it, from its least to its greatest one.
RANGES = 256


def _range(v: Column, low: Column, high: Column) -> Column:
    """The range from 0 to RANGES - 1 that a value between two others falls into; halved first, so that no difference overflows."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high > low, F.least(F.lit(RANGES - 1), F.floor(share * RANGES))).otherwise(0).cast("int")


def selected(rows: DataFrame, by: list[str], value: str, places: DataFrame) -> DataFrame:
    """(by, place, value): of each group the value at a place, from 0, of its known values in order.

    places: (by, place), each once; places outside are left out. A group's values are counted by ranges between its least and
    greatest one, only the range that holds the place is looked into again, until it holds a single value. What meets
    in a task are RANGES counts of a group and place. Null and nan are unknown; a null group is one of its own.
    """
    spark = rows.sparkSession
    v = F.col(value).cast("double")
    # Null-safe keys as one column, so that joins are equalities.
    key = F.to_json(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))))
    known = checkpointed(rows.where(v.isNotNull() & ~F.isnan(v)).select(key.alias("_key"), v.alias("_v")))
    groups = known.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    wanted = checkpointed(places.select(*by, F.col("place").cast("long").alias("place")).withColumn("_key", key))
    rounds = Rounds(spark)
    aims = rounds.keep(wanted.join(groups, "_key").where("place >= 0 AND place < _n").select("_key", "place", F.col("place").alias("_left"), "_low", "_high"))
    while not aims.where("_low < _high").isEmpty():
        met = known.join(aims.where("_low < _high"), "_key").where("_v >= _low AND _v <= _high").withColumn("_range", _range(F.col("_v"), F.col("_low"), F.col("_high")))
        counts = met.groupBy("_key", "place", "_left", "_range").agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_c").over(Window.partitionBy("_key", "place").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        holds = counts.withColumn("_upto", upto).where("_upto > _left AND _upto - _c <= _left")
        closer = holds.select("_key", "place", (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_left"), "_low", "_high")
        aims = rounds.keep(aims.where("_low >= _high").unionByName(closer))
    found = rounds.last(aims.select("_key", "place", F.col("_low").alias(value)))
    return wanted.join(found, ["_key", "place"]).select(*by, "place", value)


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, names of shares): exact quantiles of each group, between the two values around as percentile has them; null without a known value."""
    v = F.col(value).cast("double")
    counts = checkpointed(rows.groupBy(by).agg(F.count(F.when(~F.isnan(v), v)).alias("n")))
    at = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at")) for name, s in shares.items())))
    marks = counts.where("n > 0").select(by, at.alias("q")).select(by, "q.name", "q.at")
    both = marks.withColumn("place", F.explode(F.array(F.floor("at"), F.ceil("at")))).select(by, "place").distinct()
    found = selected(rows.select(by, v.alias("v")), [by], "v", both)
    near = lambda f: F.max(F.when(F.col("place") == f("at"), F.col("v")))
    met = marks.join(found.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    each = met.groupBy(by, "name", "at").agg(near(F.floor).alias("low"), near(F.ceil).alias("high"))
    # As a weighted mean of both, in the order in which percentile takes it.
    mixed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high"))
    wide = each.withColumn("x", mixed).groupBy(by).agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in shares))
    return counts.select(F.col(by).alias("_by")).join(wide, F.col("_by").eqNullSafe(F.col(by)), "left").select(F.col("_by").alias(by), *shares)


def numbered(rows: DataFrame, *order: Column | str, number: str = "number") -> DataFrame:
    """rows with their number from 1 in an order; of rows equal in it each has a number of its own.

    The rows are sorted by ranges and stored; a row's number is its place in its part and the counts of the parts before.
    """
    sorted_ = checkpointed(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row for each part of the sort: a bounded number.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).select("_part", "_before")
    return sorted_.join(starts, part == F.col("_part")).withColumn(number, (F.col("_before") + place + 1).cast("int")).drop("_at", "_part", "_before")
