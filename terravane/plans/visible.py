"""Queries of what is seen: angles, spans, errors, windows and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import labels, order, skyline, sweep
from terravane.plans import views
from terravane.plans.registry import query
from terravane.plans.views import table

_EYE = 22.3
_R = f"{geo.effective_radius()!r}::DOUBLE"


def _elevation(h: str, k: float = geo.REFRACTION) -> str:
    return f"degrees(atan2({h} - {_EYE}::DOUBLE - d * d / (2 * {geo.effective_radius(k)!r}::DOUBLE), d))"


_OBJECTS = """SELECT c_custkey AS id, c_nationkey AS observer, c_mktsegment AS cat, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS label, list_extract(['registered', 'lidar', 'estimated'], (c_custkey % 3 + 1)::INT) AS conf,
 (c_custkey * 37.5::DOUBLE) % 360 AS bearing, 500.0::DOUBLE + c_custkey * 137 % 60000 AS d, 10.0::DOUBLE + abs(c_acctbal) / 50 AS top, c_custkey % 20 * 1.0::DOUBLE AS base FROM customer"""
_SEEN = f"o AS ({_OBJECTS}), s AS (SELECT *, {_elevation('top')} AS altitude, {_elevation('base')} AS low, -0.05::DOUBLE AS line FROM o), v AS (SELECT *, greatest(0.0::DOUBLE, altitude - greatest(low, line)) AS visible FROM s)"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    conf = F.element_at(F.array(*map(F.lit, ("registered", "lidar", "estimated"))), (k % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("observer"), F.col("c_mktsegment").alias("cat"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("label"), conf.alias("conf"),
        ((k * F.lit(37.5)) % 360).alias("bearing"), (F.lit(500.0) + k * 137 % 60000).alias("d"), (F.lit(10.0) + F.abs("c_acctbal") / 50).alias("top"), (k % 20).cast("double").alias("base"),
    )
    at = lambda c: geo.elevation(F.col(c), F.lit(_EYE), F.col("d"))
    rows = rows.withColumn("altitude", at("top")).withColumn("low", at("base")).withColumn("line", F.lit(-0.05))
    return rows.withColumn("visible", geo.visible_part(F.col("altitude"), F.col("low"), F.col("line")))


@query(
    "bearing_table",
    f"""WITH {_SEEN} SELECT id, cat, round(bearing, 3) AS bearing, round(d, 1) AS d, round(altitude, 6) AS altitude, row_number() OVER (ORDER BY round(altitude, 9) DESC, id)::INT AS rank FROM v
    WHERE visible >= 0.05 AND cat IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND d <= 40000 AND label <> '' AND conf IN ('lidar', 'estimated')""",
)
def bearing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of what is seen under all filters, ranked by apparent height."""
    rows = _seen(spark, sf_dir).withColumn("altitude", F.round("altitude", 9))
    found = labels.table(rows, ["BUILDING", "MACHINERY", "HOUSEHOLD"], 40_000.0, 0.05, True, ["lidar", "estimated"])
    return found.select("id", "cat", F.round("bearing", 3).alias("bearing"), F.round("d", 1).alias("d"), F.round("altitude", 6).alias("altitude"), "rank")


@query("label_candidates", f"WITH {_SEEN} SELECT id, observer, round(visible, 6) AS visible FROM v WHERE d >= 3000 AND visible >= 0.15")
def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is far and large enough for a label."""
    return labels.worth_a_label(_seen(spark, sf_dir)).select("id", "observer", F.round("visible", 6).alias("visible"))


@query(
    "window_counts",
    f"""WITH {_SEEN}, n AS (SELECT observer, floor(bearing / 10)::INT AS bin, count(*) AS n FROM v GROUP BY 1, 2)
    SELECT observer, arg_max(bin, n * 1000 - bin) AS bin, max(n) AS n, count(*) FILTER (n >= 5) AS crowded FROM n GROUP BY observer""",
)
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around each observer the ten degrees with most in them, and how many windows are crowded."""
    return labels.busiest(labels.window_counts(_seen(spark, sf_dir)))


@query("bearing_window", f"WITH {_SEEN} SELECT id FROM v WHERE abs(((bearing - 350 + 180) % 360 + 360) % 360 - 180) <= 30")
def bearing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in a window of sixty degrees across north."""
    return _seen(spark, sf_dir).where(geo.in_window(F.col("bearing"), F.lit(350.0), F.lit(60.0))).select("id")


@query(
    "silhouettes",
    f"""WITH {_SEEN} SELECT id, round(degrees(atan((id % 30 + 1) / (2 * d))), 6) AS half_width, round(visible, 6) AS visible, NOT (top > {_EYE}::DOUBLE + d * d / (2 * {_R}) + d * -0.001::DOUBLE) AS hidden, round({geo.effective_radius()!r}::DOUBLE * 0 + sqrt(2 * {_R}) / 1000 * (sqrt({_EYE}::DOUBLE) + sqrt(top)), 4) AS range_km FROM v""",
)
def silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half width, part over the line of sight, whether a line hides the top, and the range over the sea."""
    rows = _seen(spark, sf_dir)
    return rows.select(
        "id", F.round(geo.half_width(F.col("id") % 30 + 1, F.col("d")), 6).alias("half_width"), F.round("visible", 6).alias("visible"),
        geo.hidden(F.col("top"), F.lit(_EYE), F.col("d"), F.lit(-0.001)).alias("hidden"), F.round(geo.geometric_range(F.lit(_EYE), F.col("top")), 4).alias("range_km"),
    )


@query(
    "refraction_states",
    f"""WITH o AS ({_OBJECTS}), e AS (SELECT id, d, {", ".join(f"round({_elevation('top', k)}, 9) > 0.05 AS s{i}" for i, k in enumerate((0.07, 0.13, 0.25)))} FROM o)
    SELECT id, CASE WHEN s0 THEN 'solid' WHEN s1 THEN 'normal' WHEN s2 THEN 'marginal' ELSE 'mirage' END AS state FROM e""",
)
def refraction_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which refraction each object clears the line of sight."""
    return _seen(spark, sf_dir).select("id", geo.refraction_state(F.col("top"), F.lit(_EYE), F.col("d"), F.lit(0.05)).alias("state"))


@query(
    "footprint_spans",
    """WITH c AS (SELECT s_suppkey AS id, s_suppkey * 3.6::DOUBLE AS centre, [(s_suppkey * 3.6::DOUBLE + x + 360) % 360 for x in [-1.25, 0.5, 2.0, -0.75]] AS b FROM supplier),
    u AS (SELECT id, centre, [((x - centre + 180) % 360 + 360) % 360 - 180 for x in b] AS t FROM c) SELECT id, round(centre + list_min(t), 6) AS low, round(centre + list_max(t), 6) AS high FROM u""",
)
def footprint_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bearings between which a footprint, or an island, lies; those across north are not torn apart."""
    centre = F.col("s_suppkey") * F.lit(3.6)
    corners = F.array(*(F.pmod(centre + x, F.lit(360.0)) for x in (-1.25, 0.5, 2.0, -0.75)))
    span = geo.bearing_span(corners, centre)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.round(span["from"], 6).alias("low"), F.round(span["to"], 6).alias("high"))


@query(
    "error_budget",
    f"""WITH o AS ({_OBJECTS}) SELECT id, round(degrees(atan((id % 40 / 2.0::DOUBLE) / d)), 7) AS bearing_off, round(degrees(atan(1.0::DOUBLE / d)), 7) AS elevation_off,
    round(degrees(atan((d * d / (2 * {geo.effective_radius(0.07)!r}::DOUBLE) - d * d / (2 * {geo.effective_radius(0.25)!r}::DOUBLE)) / d)), 7) AS refraction_off FROM o""",
)
def error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees by which a position, a height and the refraction put an object off, by its distance."""
    d = F.col("d")
    return _seen(spark, sf_dir).select(
        "id", F.round(geo.position_error(geo.deviation((F.col("id") % 40).cast("double")), d), 7).alias("bearing_off"), F.round(geo.height_error(F.lit(1.0), d), 7).alias("elevation_off"), F.round(geo.refraction_band(d), 7).alias("refraction_off")
    )


@query("height_percentiles", "SELECT c_mktsegment AS cat, round(quantile_cont(c_acctbal, 0.05), 4) AS p05, round(quantile_cont(c_acctbal, 0.1), 4) AS p10, round(quantile_cont(c_acctbal, 0.5), 4) AS p50, round(quantile_cont(c_acctbal, 0.9), 4) AS p90, round(quantile_cont(c_acctbal, 0.95), 4) AS p95 FROM customer GROUP BY 1")
def height_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles by class, by ranges that are looked into again and again."""
    shares = {"p05": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95}
    found = order.quantiles(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "cat"), "cat", "c_acctbal", shares)
    return found.select("cat", *(F.round(n, 4).alias(n) for n in shares))


@query(
    "profile_slopes",
    "WITH p AS (SELECT user_id AS id, (event_id % 36)::INT AS bin, max(value) AS angle FROM events GROUP BY 1, 2) SELECT p.id, p.bin, round(coalesce(q.angle - p.angle, 0), 6) AS slope FROM p LEFT JOIN p q ON p.id = q.id AND q.bin = (p.bin + 1) % 36",
)
def profile_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a profile changes from each bin to the next."""
    profile = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), (F.col("event_id") % 36).cast("int").alias("bin")).agg(F.max("value").alias("angle"))
    return sweep.between_bins(profile, 36).select("id", "bin", F.round("slope", 6).alias("slope"))


@query("packed_profiles", f"WITH r AS ({views.RAYS}), p AS (SELECT bin, max(h) / 10 AS angle FROM r GROUP BY 1) SELECT bin, round_even(angle * 100, 0)::INT AS centidegrees FROM p")
def packed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles as 16-bit hundredths."""
    top = skyline.ray_top(views.rays(spark, sf_dir), "bin", "d", "h").withColumn("angle", F.col("top") / 10)
    return skyline.packed_angles(top).select("bin", F.col("centidegrees").cast("int").alias("centidegrees"))


@query(
    "island_spans",
    f"""WITH c AS (SELECT s_suppkey AS id, s_suppkey * 3.6::DOUBLE AS centre, 1.0::DOUBLE + s_suppkey % 12 AS top, 10000.0::DOUBLE + s_suppkey * 211 AS d, [(s_suppkey * 3.6::DOUBLE + x + 360) % 360 for x in [-1.25, 0.5, 2.0]] AS b FROM supplier),
    u AS (SELECT id, centre, [((x - centre + 180) % 360 + 360) % 360 - 180 for x in b] AS t FROM c WHERE (top - {_EYE}::DOUBLE - d * d / (2 * {_R})) / d > -sqrt(2 * {_EYE}::DOUBLE / {_R}))
    SELECT id, round(centre + list_min(t), 6) AS low, round(centre + list_max(t), 6) AS high FROM u""",
)
def island_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the islands that rise over the sea's line."""
    k = F.col("s_suppkey")
    centre = k * F.lit(3.6)
    shores = table(spark, sf_dir, "supplier").select(k.alias("id"), centre.alias("centre"), F.array(*(F.pmod(centre + x, F.lit(360.0)) for x in (-1.25, 0.5, 2.0))).alias("bearings"), (F.lit(1.0) + k % 12).alias("top"), (F.lit(10_000.0) + k * 211).alias("d"))
    found = labels.islands(shores, _EYE)
    return found.select("id", F.round("from", 6).alias("low"), F.round("to", 6).alias("high"))
