"""Sweeps by tiles: many viewpoints against one at a time, and pruning that changes nothing."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import skyline, sweep
from terravane.operators.raster import ANCHOR_NORTH
from terravane.plans import views
from terravane.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_sweep(e0, n0, hobs, ue, un, tiles, bands, rings):
    """(d, t) of one ray's records, sample by sample."""
    radius, out, high = geo.effective_radius(), [], -math.inf
    for d in map(float, skyline.distance_list(bands, rings[-1][0])):
        _, cell, edge = next(r for r in rings if d <= r[0])
        e, n = e0 + ue * d, n0 + un * d
        step = cell * edge
        tx, ty = math.floor(e / step), math.floor((ANCHOR_NORTH - n) / step)
        h = 0.0
        if (cell, tx, ty) in tiles:
            v = tiles[cell, tx, ty]
            fx, fy = (e - tx * step) / cell - 0.5, (ANCHOR_NORTH - ty * step - n) / cell - 0.5
            ix, iy = max(0, min(math.floor(fx), edge - 2)), max(0, min(math.floor(fy), edge - 2))
            gx, gy = min(1.0, max(0.0, fx - ix)), min(1.0, max(0.0, fy - iy))
            four = [v[iy, ix], v[iy, ix + 1], v[iy + 1, ix], v[iy + 1, ix + 1]]
            top, low = four[0] + (four[1] - four[0]) * gx, four[2] + (four[3] - four[2]) * gx
            h = top + (low - top) * gy if not any(map(math.isnan, four)) else v[min(edge - 1, max(0, math.floor(fy + 0.5))), min(edge - 1, max(0, math.floor(fx + 0.5)))]
            h = 0.0 if math.isnan(h) else h / 4
        t = (h - hobs - d * d / (2 * radius)) / d
        if t > high:
            high = t
            out.append((d, t))
    return out


def arrays(df):
    return {(r["cell"], r["tx"], r["ty"]): np.array([np.nan if x is None else x for x in r["v"]], float).reshape(r["height"], r["width"]) for r in df.collect()}


def test_viewpoints_as_one_at_a_time(spark):
    df = views.small_tiles(spark, FOLDER)
    tiles = arrays(df)
    found = QUERIES["viewpoint_profiles"](spark, FOLDER).collect()
    assert len(found) > 5
    k = F.col("s_suppkey")
    e, n = F.lit(101.0) + (k * 29) % 1800, F.lit(float(ANCHOR_NORTH)) - 33 - (k * 17) % 560
    lat, lon = geo.to_degrees(e, n)
    where = spark.read.parquet(f"{FOLDER}/supplier.parquet").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"))
    rays = defaultdict(dict)
    for r in sweep.bearings(where, views.SMALL_RINGS[-1][0], 36).collect():
        rays[r["id"]][r["bin"]] = r
    for row in found:
        for b, centi in enumerate(row["profile"]):
            r = rays[row["id"]][b]
            steps = plain_sweep(r["e0"], r["n0"], row["hobs"], r["ue"], r["un"], tiles, views.SMALL_BANDS, views.SMALL_RINGS)
            assert abs(math.degrees(math.atan(steps[-1][1])) * 100 - centi) <= 0.5 + 1e-3


def hills(spark, seed, rings):
    """A cone of ground to the middle's north and noise elsewhere, in tiles of every ring."""
    rng = np.random.default_rng(seed)
    rows, out = [], {}
    for reach, cell, edge in rings:
        step = cell * edge
        for tx in range(int((500_000 - reach) // step), int((500_000 + reach) // step) + 1):
            for ty in range(int((799_000 - reach) // step), int((799_000 + reach) // step) + 1):
                if rng.random() < 0.1:
                    continue
                east = tx * step + (np.arange(edge) + 0.5) * cell - 500_000
                down = ty * step + (np.arange(edge) + 0.5) * cell - 799_000
                far = np.hypot(*np.meshgrid(east, down))
                v = np.rint(np.maximum(0, 400 - np.abs(far - 700)) * (0.4 + 0.2 * rng.random((edge, edge))) * 4)
                v[rng.random((edge, edge)) < 0.02] = np.nan
                out[cell, tx, ty] = v
                rows.append((cell, tx, ty, edge, edge, 4, [None if np.isnan(x) else int(x) for x in v.ravel()]))
    return out, spark.createDataFrame(rows, "cell int, tx long, ty long, width int, height int, scale int, v array<int>")


def test_pruning_changes_nothing(spark):
    """A ridge all around hides most of what lies behind it: fewer tiles are read, the staircases are those of every sample."""
    rings, bands = ((1_000, 10, 32), (4_000, 20, 32), (9_000, 50, 32)), ((1_000, 10), (4_000, 40), (9_000, 100))
    tiles, df = hills(spark, 3, rings)
    places = [(k, 500_000.0 + 37.0 * k, ANCHOR_NORTH - 799_000.0 - 23.0 * k, 2.0, None) for k in range(4)]
    seen = sweep.eyes(spark.createDataFrame(places, "id long, e double, n double, eye double, override double"), df, rings).cache()
    angle = F.radians(F.col("bin") * 15.0)
    rays = seen.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(23)))).select("id", "bin", F.col("e").alias("e0"), F.col("n").alias("n0"), F.sin(angle).alias("ue"), F.cos(angle).alias("un"))
    index = df.select("cell", "tx", "ty", (F.array_max("v") / F.col("scale")).alias("most_m"))
    report = []
    got = defaultdict(list)
    for r in sweep.skylines(seen, rays, df, index, bands, rings, report).orderBy("d").collect():
        got[r["id"], r["bin"]].append((r["d"], r["t"]))
    hobs = {r["id"]: r["hobs"] for r in seen.collect()}
    for r in rays.collect():
        want = plain_sweep(r["e0"], r["n0"], hobs[r["id"]], r["ue"], r["un"], tiles, bands, rings)
        mine = got[r["id"], r["bin"]]
        assert [d for d, _ in mine] == [d for d, _ in want]
        assert np.allclose([t for _, t in mine], [t for _, t in want], rtol=0, atol=1e-12)
    there, read = sum(x[1] for x in report), sum(x[2] for x in report)
    assert report[0][1] == report[0][2] and read < 0.7 * there
