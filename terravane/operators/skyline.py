"""Skyline profiles: rays over terrain, the rising staircase of angles along each, and what it hides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions import geo

# Sampling bands (to metres, step), bins of a circle, floor and spacing of stored angles in degrees.
BANDS = ((5_000, 10), (20_000, 25), (60_000, 50), (90_000, 100))
BINS, FLOOR_DEG, SPACING_DEG = 3600, -6.0, 0.02
SKIP_FROM_M = 15_000.0


def distance_list(bands=BANDS, reach: float | None = None) -> list[int]:
    """The distances at which a ray is sampled, up to its reach."""
    start, found = 0, []
    for to, step in bands:
        found += range(start + step, (to if reach is None else min(to, int(reach))) + 1, step)
        start = to
    return found


def distances(bands=BANDS, reach: float | None = None) -> Column:
    """distance_list as an array of doubles."""
    start, parts = 0, []
    for to, step in bands:
        last = to if reach is None else min(to, int(reach))
        if start + step <= last:
            parts.append(F.sequence(F.lit(start + step), F.lit(last), F.lit(step)))
        start = to
    return F.flatten(F.array(*parts)).cast("array<double>")


def schedule(spark: SparkSession, bands=BANDS) -> DataFrame:
    """The distances at which a ray is sampled."""
    return spark.range(1).select(F.explode(distances(bands)).alias("d"))


def records(samples: DataFrame, ray: str, order: str, value: str) -> DataFrame:
    """The samples that are higher than all before them on their ray."""
    before = Window.partitionBy(ray).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("high", F.max(value).over(before)).where(F.col("high").isNull() | (F.col(value) > F.col("high"))).drop("high")


def ray_top(samples: DataFrame, ray: str, order: str, value: str) -> DataFrame:
    """The highest value of each ray, and the first place that has it."""
    return samples.groupBy(ray).agg(F.max(value).alias("top"), F.max_by(order, F.struct(value, -F.col(order))).alias("at"))


def thinned(steps: DataFrame, ray: str = "bin", order: str = "d", angle: str = "a", spacing: float = SPACING_DEG, floor: float = FLOOR_DEG, even: bool = False) -> DataFrame:
    """(ray, order, angle) of the record highs that rise by more than the spacing over the last one kept, and the last.

    The last one is left out if it is stored as the same hundredth as the last kept: of halves the one above, as a sweep's
    staircase is stored, or with `even` the even one, as packed_angles stores them. A ray has at most as many steps as the schedule has samples, so its steps fit an array.
    """
    step = F.struct(F.col(order).alias("d"), F.col(angle).alias("a"))
    sorted_ = steps.where(F.col(angle) > floor).groupBy(ray).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    none = F.array().cast("array<struct<d: double, a: double>>")
    typed = F.transform("steps", lambda s: F.struct(s["d"].cast("double").alias("d"), s["a"].cast("double").alias("a")))
    last = lambda kept: F.element_at(kept, -1)
    rises = lambda kept, s: (F.size(kept) == 0) | (s["a"] > F.when(F.size(kept) > 0, last(kept)["a"]) + spacing)
    kept = F.aggregate(typed, none, lambda kept, s: F.when(rises(kept, s), F.array_append(kept, s)).otherwise(kept))
    end = F.element_at(typed, -1)
    centi = lambda a: F.rint(a * 100) if even else F.floor(a * 100 + 0.5)
    whole = F.when(centi(last(kept)["a"]) != centi(end["a"]), F.array_append(kept, end)).otherwise(kept)
    return sorted_.select(ray, F.explode(whole).alias("s")).select(ray, F.col("s.d").alias(order), F.col("s.a").alias(angle))


def as_of(queries: DataFrame, steps: DataFrame, ray: str, order: str, value: str) -> DataFrame:
    """queries with the value of the last step strictly before each on its ray: one sort of both, no range join."""
    q = queries.withColumn("is_step", F.lit(0)).withColumn("step_value", F.lit(None).cast(steps.schema[value].dataType))
    s = steps.select(ray, order, F.lit(1).alias("is_step"), F.col(value).alias("step_value"))
    before = Window.partitionBy(ray).orderBy(order, "is_step").rowsBetween(Window.unboundedPreceding, -1)
    both = q.unionByName(s, allowMissingColumns=True)
    return both.withColumn("step_value", F.last("step_value", ignorenulls=True).over(before)).where("is_step = 0").drop("is_step")


def can_hide(ceiling: Column, eye: Column, near: Column, far: Column) -> Column:
    """Whether a tile up to a ceiling may reach the sea skyline, or lies near enough to be read anyway."""
    return (near <= SKIP_FROM_M) | (geo.best_tangent(ceiling, eye, near, far) >= geo.dip_tangent(eye))


def profile(samples: DataFrame, ray: str = "bin") -> DataFrame:
    """(ray, angle, d): the skyline of samples (ray, d, h, eye); a missing height is the sea."""
    h = F.coalesce(F.col("h"), F.lit(0.0))
    tangent = (h - F.col("eye") - geo.drop(F.col("d"))) / F.col("d")
    best = F.max_by(F.struct(tangent.alias("t"), "d"), F.struct(F.round(tangent, 9), -F.col("d"))).alias("b")
    return samples.groupBy(ray).agg(best).select(ray, F.degrees(F.atan("b.t")).alias("angle"), F.col("b.d").alias("d"))


def packed_angles(profile: DataFrame, ray: str = "bin") -> DataFrame:
    """(ray, centidegrees): angles as 16-bit hundredths."""
    return profile.select(ray, F.rint(F.col("angle") * 100).cast("short").alias("centidegrees"))
