"""Positions, rasters and rays derived from the driver's tables, in Spark and in SQL by the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import raster


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _step(key: str, times: int, modulus: int, size: float):
    return F.pmod(F.col(key) * times, F.lit(modulus)) * F.lit(size)


def geo_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lon = 25 + F.pmod(F.floor(k / 50), F.lit(50)) * F.lit(0.004)
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (60 + _step("c_custkey", 1, 50, 0.002)).alias("lat"), lon.alias("lon"),
        F.col("c_acctbal").alias("height_m"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"),
    )


def geo_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        (60 + _step("s_suppkey", 7, 50, 0.002) + _step("s_suppkey", 1, 3, 0.0004)).alias("lat"),
        (25 + _step("s_suppkey", 3, 50, 0.004) + _step("s_suppkey", 1, 2, 0.0005)).alias("lon"),
        F.col("s_acctbal").alias("height_m"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(k / 4096).alias("tile"), F.pmod(F.floor(k / 64), F.lit(64)).alias("row"), F.pmod(k, F.lit(64)).alias("col"), F.col("o_totalprice").alias("v"))


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("bin"), F.col("event_id").alias("d"), F.col("value").alias("h"))


GEO_BASE = """SELECT c_custkey AS id, 60 + (c_custkey % 50) * 0.002::DOUBLE AS lat, 25 + ((c_custkey // 50) % 50) * 0.004::DOUBLE AS lon,
 c_acctbal AS height_m, c_mktsegment AS segment, c_nationkey AS nation, c_name AS name FROM customer"""
GEO_IN = """SELECT s_suppkey AS id, 60 + (s_suppkey * 7 % 50) * 0.002::DOUBLE + (s_suppkey % 3) * 0.0004::DOUBLE AS lat,
 25 + (s_suppkey * 3 % 50) * 0.004::DOUBLE + (s_suppkey % 2) * 0.0005::DOUBLE AS lon, s_acctbal AS height_m, s_nationkey AS nation, s_name AS name FROM supplier"""
GRID = "SELECT o_orderkey // 4096 AS tile, (o_orderkey // 64) % 64 AS row, o_orderkey % 64 AS col, o_totalprice AS v FROM orders"
RAYS = "SELECT user_id AS bin, event_id AS d, value AS h FROM events"
METRES = "sqrt(((a.lat - b.lat) * 111320.0::DOUBLE) ** 2 + ((a.lon - b.lon) * 111320.0::DOUBLE * cos(radians(a.lat))) ** 2)"
PAIRS = f"base AS ({GEO_BASE}), inc AS ({GEO_IN}), pairs AS (SELECT a.id AS a_id, b.id AS b_id, {METRES} AS dd, a.height_m AS ah, b.height_m AS bh FROM inc a JOIN base b ON {METRES} <= 150)"


#: A small country: the grid's tiles side by side in cells of 10 m, and again, twice as large, in cells of 20 m.
SMALL_RINGS, SMALL_BANDS = ((400, 10, 64), (1500, 20, 64)), ((400, 10), (1500, 50))


def land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, v) of the grid's cells in one line of tiles, counted from the anchor; v in metres."""
    return grid(spark, sf_dir).select("row", (F.col("tile") * 64 + F.col("col")).alias("col"), (F.col("v") / 400).alias("v"))


LAND = f"SELECT row, tile * 64 + col AS col, v / 400 AS v FROM ({GRID})"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, sr, name): names on the land, of map scales in turn."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), (F.pmod(k * 173, F.lit(2400)) + F.lit(33.0)).alias("x"), (F.lit(7_800_000.0) - 17 - F.pmod(k * 89, F.lit(600))).alias("y"),
        F.when(k % 4 == 0, 25_000).when(k % 4 == 1, 250_000).otherwise(100_000).alias("sr"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("ele"),
    )


PLACES = """SELECT s_suppkey AS id, s_suppkey * 173 % 2400 + 33.0::DOUBLE AS x, 7800000.0::DOUBLE - 17 - s_suppkey * 89 % 600 AS y,
 CASE s_suppkey % 4 WHEN 0 THEN 25000 WHEN 1 THEN 250000 ELSE 100000 END AS sr, s_name AS name, s_acctbal AS ele FROM supplier"""


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, e, n, eye, override): five places to look from; one has a ground of its own."""
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        k.cast("long").alias("id"), (F.lit(323.0) + k * 297).alias("e"), (F.lit(7_800_000.0) - 207 - k * 61).alias("n"), F.lit(2.0).alias("eye"), F.when(k == 3, F.lit(150.0)).alias("override")
    )


OBSERVERS = """SELECT r_regionkey::BIGINT AS id, 323.0::DOUBLE + r_regionkey * 297 AS e, 7800000.0::DOUBLE - 207 - r_regionkey * 61 AS n, 2.0::DOUBLE AS eye,
 CASE WHEN r_regionkey = 3 THEN 150.0::DOUBLE END AS override FROM region"""


def small_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, tx, ty, width, height, scale, v) of the small country, v in quarter metres; cells that aren't there are null."""
    q = F.greatest(F.lit(-32767), F.least(F.lit(32767), F.rint(F.col("v") / 400 * 4))).cast("int")
    cells = grid(spark, sf_dir).select("tile", (F.col("row") * 64 + F.col("col")).alias("k"), q.alias("q"))
    held = raster.scattered(cells, ["tile"], "k", "q", 64 * 64, "int")
    return held.select(F.explode(F.array(F.lit(10), F.lit(20))).alias("cell"), F.col("tile").alias("tx"), F.lit(0).cast("long").alias("ty"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.lit(4).alias("scale"), "v")


SMALL_CELLS = f"SELECT unnest([10, 20]) AS cell, tile AS tx, 0::BIGINT AS ty, row, col, greatest(-32767, least(32767, round_even(v / 400 * 4, 0)))::INT AS q FROM ({GRID})"
