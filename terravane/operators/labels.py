"""What is worth a label: visible parts, farms, and a budget for every ten degrees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import order, spatial
from terravane.operators.graph import components

# Least distance, least visible part, window and labels in it, distance within a farm.
LEAST_M, LEAST_DEG, WINDOW_DEG, BUDGET, FARM_M = 3000.0, 0.15, 10.0, 3, 2000.0


def farms(sites: DataFrame, distance: float = FARM_M, size: float = 0.05) -> DataFrame:
    """(id, farm): single-link clusters of sites (id, lat, lon), at any latitude; a site alone is its own farm."""
    point = sites.select("id", "lat", "lon")
    pairs = spatial.range_join(point, point, distance, size).where("a_id < b_id")
    found = components(pairs, "a_id", "b_id")
    return sites.join(found, sites["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("farm"))


def farm_labels(sites: DataFrame, distance: float = FARM_M) -> DataFrame:
    """(farm, n, lat, lon): one label for each farm, at the mean of its sites."""
    joined = sites.join(farms(sites, distance), "id")
    return joined.groupBy("farm").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def worth_a_label(seen: DataFrame, least_m: float = LEAST_M, least_deg: float = LEAST_DEG) -> DataFrame:
    """Of what is seen (d, visible) what is neither too near nor too small."""
    return seen.where((F.col("d") >= least_m) & (F.col("visible") >= least_deg))


def table(seen: DataFrame, categories: list[str] | None = None, most_m: float | None = None, least_deg: float = 0.0, named: bool = False, confidence: list[str] | None = None) -> DataFrame:
    """Rows of seen (id, cat, d, altitude, visible, label, conf) that pass the filters, with rank: highest altitude first, equal ones by id.

    A filter that is None or false lets all pass.
    """
    rows = seen.where(F.col("visible") >= least_deg)
    rows = rows if categories is None else rows.where(F.col("cat").isin(*categories))
    rows = rows if most_m is None else rows.where(F.col("d") <= most_m)
    rows = rows.where(F.col("label") != "") if named else rows
    rows = rows if confidence is None else rows.where(F.col("conf").isin(*confidence))
    return order.numbered(rows, F.desc("altitude"), "id", number="rank")


def window_counts(seen: DataFrame, observer: str = "observer", window: float = WINDOW_DEG) -> DataFrame:
    """(observer, bin, n) of the windows with anything in them, numbered from north."""
    return seen.groupBy(observer, F.floor(F.pmod(F.col("bearing"), F.lit(360.0)) / window).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def busiest(counts: DataFrame, observer: str = "observer", crowded: int = 5) -> DataFrame:
    """(observer, bin, n, crowded): the window with most, the first of equals, and how many windows have at least so many."""
    best = F.max_by(F.struct("bin", "n"), F.struct("n", -F.col("bin"))).alias("b")
    return counts.groupBy(observer).agg(best, F.count_if(F.col("n") >= crowded).alias("crowded")).select(observer, "b.*", "crowded")


def islands(shores: DataFrame, eye: float) -> DataFrame:
    """(id, from, to): the bearings between which an island (id, centre, bearings, top, d) lies; those under the sea's line are left out."""
    seen = shores.where(F.tan(F.radians(geo.elevation(F.col("top"), F.lit(eye), F.col("d")))) > geo.dip_tangent(F.lit(eye)))
    return seen.select("id", geo.bearing_span(F.col("bearings"), F.col("centre")).alias("s")).select("id", "s.*")


def budget(seen: DataFrame, observer: str = "observer", window: float = WINDOW_DEG, most: int = BUDGET) -> DataFrame:
    """The labels (observer, id, bearing, size) that fit: by size, unless a window already has its budget.

    The choice depends on all larger labels around, so each observer's circle is replayed in one task; only
    what can be seen from one place is in it. Labels without an bearing are left out.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[float] = []
        rows = []
        for row in pdf.sort_values(["size", "id"], ascending=[False, True]).itertuples(index=False):
            near = sorted((a - row.bearing + 180) % 360 - 180 for a in kept)
            near = [a for a in near if abs(a) <= window]
            full = any(sum(lo <= a <= lo + window for a in near) >= most for lo in [*(a for a in near if a <= 0), *(a - window for a in near if a >= 0)])
            if not full:
                kept.append(row.bearing)
                rows.append(row)
        return pd.DataFrame(rows, columns=pdf.columns)

    return seen.where(F.col("bearing").isNotNull()).groupBy(observer).applyInPandas(choose, seen.schema)
