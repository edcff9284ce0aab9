"""Joins by distance: equality joins on grid cells, then the exact test.

A point looks only into the cells that its radius reaches, at any latitude: one or two where the radius is small
against a cell. A crowded cell is split by the skew-join rule of adaptive execution; both sides only hold keys and positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import geo

CELL_DEG = 0.01
# Which categories an object may be merged into; the heights' tolerance, and the distance under which it doesn't count.
COMPATIBLE = {
    "mast": ("mast",),
    "chimney": ("chimney",),
    "turbine": ("turbine",),
    "watertower": ("watertower",),
    "obstower": ("obstower", "building", "lighthouse"),
    "belltower": ("belltower",),
    "lighthouse": ("lighthouse", "obstower", "building"),
    "building": ("building", "obstower", "lighthouse"),
}
VETO_M, VETO_SHARE, SURE_M = 10.0, 0.15, 15.0


def compatible(a: Column, b: Column) -> Column:
    """Whether an object of category a may be merged into one of b; a category that isn't listed merges with none."""
    return F.coalesce(*(F.when(a == k, b.isin(*v)) for k, v in COMPATIBLE.items()), F.lit(False))


def heights_agree(a: Column, b: Column) -> Column:
    """False only if both heights are known and too far apart."""
    limit = F.greatest(F.lit(VETO_M), VETO_SHARE * F.greatest(a, b))
    return a.isNull() | b.isNull() | (F.abs(a - b) <= limit)


def near_conflict(a: Column, b: Column, d: Column, sure: float = SURE_M) -> Column:
    """Whether heights disagree at a distance at which two records are one object all the same: to be merged and noted."""
    return ~heights_agree(a, b) & (d <= sure)


def with_cell(df: DataFrame, lat: str = "lat", lon: str = "lon", size: float = CELL_DEG) -> DataFrame:
    return df.withColumn("ci", F.floor(F.col(lat) / size)).withColumn("cj", F.floor(F.col(lon) / size))


def with_reached_cells(df: DataFrame, radius: float, lat: str = "lat", lon: str = "lon", size: float = CELL_DEG) -> DataFrame:
    """df with a row for each cell that points within the radius can lie in."""
    # A hair wider than the radius, so that rounding loses no cell; a degree of longitude shrinks with the latitude.
    north = F.lit(1.000001 * radius / geo.DEGREE_M)
    east = F.least(north / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9)), F.lit(360.0))
    span = lambda c, half: F.sequence(F.floor((F.col(c) - half) / size), F.floor((F.col(c) + half) / size))
    known = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return known.withColumn("ci", F.explode(span(lat, north))).withColumn("cj", F.explode(span(lon, east)))


def range_join(left: DataFrame, right: DataFrame, radius: float, size: float = CELL_DEG) -> DataFrame:
    """(left columns as a_*, right columns as b_*, d): pairs of points (id, lat, lon, ...) at most radius metres apart.

    Distances are flat, with the left point's latitude in the cosine. Points with a null position match nothing.
    """
    a = with_reached_cells(left, radius, size=size)
    b = with_cell(right, size=size)
    a = a.select("ci", "cj", *(F.col(c).alias(f"a_{c}") for c in left.columns))
    b = b.select("ci", "cj", *(F.col(c).alias(f"b_{c}") for c in right.columns))
    d = geo.flat_metres(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return a.join(b, ["ci", "cj"]).withColumn("d", d).where(F.col("d") <= radius).drop("ci", "cj")


def scan_order(a_lat: str, a_lon: str, b_lat: str, b_lon: str, b_seq: str, size: float = CELL_DEG) -> Column:
    """The order in which a walk over the cells around a meets b: row of cells, column, then the order of insertion."""
    cell = lambda c: F.floor(F.col(c) / size)
    return F.struct((cell(b_lat) - cell(a_lat)).alias("i"), (cell(b_lon) - cell(a_lon)).alias("j"), F.col(b_seq).alias("seq"))


def nearest(pairs: DataFrame, others: list[str] | None = None) -> DataFrame:
    """Of each left point's pairs the nearest, of equal distances (to the millimetre) the one with the smallest id."""
    best = F.min_by(F.struct("b_id", F.round("d", 3).alias("d"), *(others or [])), F.struct(F.round("d", 3), F.col("b_id"))).alias("n")
    return pairs.groupBy("a_id").agg(best).select("a_id", "n.*")
