"""The catalogue's build, and rules of terrain, against plain sequential versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import catalogue, fuse, spatial, sweep, terrain
from terravane.plans import catalogue as plan
from tests.test_operators import metres, walked

FOLDER = "/root/testdata/sf0.001"


def absorbed(into, other):
    for c in (*fuse.CARRIED, "ground_m", "name", "obst_id"):
        if into[c] in (None, "") and other[c] not in (None, ""):
            into[c] = other[c]
    if other["height_m"] is not None and (into["height_m"] is None or fuse.TRUST.get(other["src_h"], 0) > fuse.TRUST.get(into["src_h"], 0)):
        into["height_m"], into["src_h"] = other["height_m"], other["src_h"]
    into["srcs"] = sorted({*into["srcs"], *other["srcs"]})


def in_sequence(base, layers):
    held = [dict(r) for r in base]
    for name, rows in layers.items():
        for r in map(dict, rows):
            near = sorted((h for h in walked(r, held) if metres(r, h) <= fuse.RADII[name]), key=lambda h: metres(r, h))
            fits = (h for h in near if h["cat"] in spatial.COMPATIBLE.get(r["cat"], ()) and (h["height_m"] is None or r["height_m"] is None or abs(h["height_m"] - r["height_m"]) <= max(10, 0.15 * max(h["height_m"], r["height_m"]))))
            into = next(fits, None)
            held.append(r) if into is None else absorbed(into, r)
    return held


def test_build_in_sequence(spark):
    base, incoming = plan.layers(spark, FOLDER)
    rows = lambda df: [r.asDict() for r in df.orderBy("seq").collect()]
    held = in_sequence(rows(base), {n: rows(df) for n, df in incoming.items()})
    samples = {}
    for survey in reversed(plan.surveys(spark, FOLDER)):
        samples |= {r["key"]: r["h"] for r in survey.collect() if r["h"] >= 3}
    model = {(r["row"], r["col"]): r["v"] for r in plan.model(spark, FOLDER).collect() if r["v"] is not None and -1000 <= r["v"] <= 1500}
    e, n = geo.to_grid(F.col("lat"), F.col("lon"))
    at = {r["id"]: (r["e"], r["n"]) for r in spark.createDataFrame([(h["id"], h["lat"], h["lon"]) for h in held], "id long, lat double, lon double").select("id", e.alias("e"), n.alias("n")).collect()}
    want = {}
    for h in held:
        sample = samples.get(f"{h['lat']:.6f},{h['lon']:.6f}")
        if h["height_m"] is None and sample:
            h["height_m"], h["src_h"], h["conf"] = round(sample, 1), "ndsm", "lidar"
        if h["ground_m"] is None:
            v = model.get((math.floor((plan.MODEL_NORTH - at[h["id"]][1]) / 100), math.floor((at[h["id"]][0] - plan.MODEL_WEST) / 100)))
            if v is not None:
                h["ground_m"], h["src_g"] = v, "dem100"
            elif h["cat"] == "lighthouse":
                h["ground_m"], h["src_g"] = 0.0, "sea"
        basis = None
        if h["vayla_id"] is not None and h["height_m"] is None:
            above = h["focal_agl_m"] or h["daymark_agl_m"]
            low = h["focal_m"] if h["ground_m"] is not None and h["ground_m"] <= 2 else None
            if (found := above if above is not None else low) is not None:
                h["height_m"], h["src_h"], basis = found, "vayla", "agl" if above is not None else "water"
        want[h["id"]] = (h["cat"], None if h["height_m"] is None else round(h["height_m"], 2), h["src_h"], None if h["ground_m"] is None else round(h["ground_m"], 0), h["src_g"], h["conf"], h["name"], h["obst_id"], basis, "+".join(h["srcs"]))
    out = plan.catalogue_build(spark, FOLDER).collect()
    near = lambda x, k: None if x is None or x != x else round(x, k)
    got = {r["id"]: (r["cat"], near(r["height_m"], 2), r["src_h"], near(r["ground_m"], 0), r["src_g"], r["conf"], r["name"], r["obst_id"], r["h_basis"], r["srcs"]) for r in out}
    assert got.keys() == want.keys()
    # Spark rounds halves up, Python to even: numbers agree to a unit of what is left.
    same = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1)
    tight = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 0.0101)
    differ = {k: (got[k], want[k]) for k in got if not (tight(got[k][1], want[k][1]) and same(got[k][3], want[k][3]) and all(got[k][i] == want[k][i] for i in (0, 2, 4, 5, 6, 7, 8, 9)))}
    assert not differ
    tops = [r["top_m"] or 0.0 for r in out]
    assert tops == sorted(tops, reverse=True) and any(r["src_h"] == "vayla" for r in out) and any(r["src_h"] == "ndsm" for r in out)


def test_rays_follow_geodesics(spark):
    seen = spark.createDataFrame([(1, 60.2, 24.9)], "id long, lat double, lon double")
    rays = {r["bin"]: r for r in sweep.bearings(seen, 90_000.0, 8).collect()}
    # The grid's north lies (lon - 27) * sin(lat) degrees from true north; lengths differ by the scale.
    convergence = (24.9 - 27) * math.sin(math.radians(60.2))
    for b, r in rays.items():
        turn = math.degrees(math.atan2(r["ue"], r["un"])) - (b * 45 - convergence)
        assert abs((turn + 180) % 360 - 180) < 0.5 and 0.9990 < math.hypot(r["ue"], r["un"]) < 1.001


def test_sweep_with_nothing_around_is_the_sea(spark):
    """Without tiles every ray's top is the sea's own, at the dip of the eye."""
    none = "cell int, tx long, ty long, width int, height int, scale int, v array<int>"
    tiles = spark.createDataFrame([], none)
    where = spark.createDataFrame([(1, 300000.0, 6700000.0, 30.0, 0.0)], "id long, e double, n double, eye double, override double")
    seen = sweep.eyes(where, tiles)
    rays = spark.createDataFrame([(1, 0, 300000.0, 6700000.0, 0.0, 1.0)], "id long, bin int, e0 double, n0 double, ue double, un double")
    index = spark.createDataFrame([], "cell int, tx long, ty long, most_m double")
    top = sweep.profile(sweep.skylines(seen, rays, tiles, index)).first()
    assert top["angle"] == pytest.approx(math.degrees(math.atan(-math.sqrt(2 * 30 / geo.effective_radius()))), abs=1e-4)


def test_low_tiles_are_skipped_only_far_away(spark):
    seen = spark.createDataFrame([(1, 302_560.0, 6_697_440.0, 40.0)], "id long, e double, n double, hobs double")
    tiles = terrain.raster.tile_cover(seen.select("id", "e", "n"))
    index = tiles.select("cell", "tx", "ty", F.when((F.col("tx") + F.col("ty")) % 2 == 0, F.lit(5.0)).otherwise(900.0).alias("most_m")).distinct()
    found = sweep.tiles_to_read(seen, index).join(tiles, ["id", "cell", "tx", "ty"]).join(index, ["cell", "tx", "ty"]).collect()
    assert any(r["skipped"] for r in found)
    assert all(r["nearest"] > 15_000 and r["most_m"] < 10 for r in found if r["skipped"])
    assert all(r["skipped"] for r in found if r["nearest"] > 61_000 and r["most_m"] < 10)


def test_staircase_ends_at_the_top(spark):
    steps = spark.createDataFrame([(1, 0, 10.0, -0.01), (1, 0, 20.0, -0.0099), (1, 0, 30.0, 0.02)], "id long, bin int, d double, t double")
    got = [(r["d10"], r["centi"]) for r in sweep.staircase(steps).orderBy("d10").collect()]
    assert got == [(1, math.floor(math.degrees(math.atan(-0.01)) * 100 + 0.5)), (3, math.floor(math.degrees(math.atan(0.02)) * 100 + 0.5))]


def test_claimant_below_the_scale(spark):
    """A name's wide summit lies at another, small name, which is then sampled too."""
    rows, cols = range(200), range(200)
    peak = (100, 140)
    cells = spark.createDataFrame([(r, c, 500.0 - math.hypot(r - peak[0], c - peak[1])) for r in rows for c in cols], "row long, col long, v double")
    x = lambda c: (c + 0.5) * 10
    y = lambda r: terrain.ANCHOR_NORTH - (r + 0.5) * 10
    places = spark.createDataFrame([(1, x(100), y(100), 500_000), (2, x(142), y(101), 25_000), (3, x(145), y(100), 250_000)], "id long, x double, y double, sr int")
    got = {r["id"]: r for r in terrain.snapped(places, cells).collect()}
    assert (got[1]["open"], got[1]["wide"], got[1]["claimed"], got[1]["d"]) == (True, True, 2, 150.0)
    assert (got[3]["open"], got[3]["top"], got[3]["x"]) == (False, 500.0, x(140))
    assert (got[2]["open"], got[2]["top"], got[2]["wide"]) == (False, 500.0, None)


def test_farm_labels(spark):
    from terravane.operators import labels

    sites = spark.createDataFrame([(1, 60.0, 25.0), (2, 60.01, 25.0), (3, 61.0, 25.0)], "id long, lat double, lon double")
    got = sorted((r["farm"], r["n"], round(r["lat"], 4)) for r in labels.farm_labels(sites).collect())
    assert got == [(1, 2, 60.005), (3, 1, 61.0)]


def test_paths_and_bounds(spark):
    row = spark.range(1).select(terrain.tile_path(F.lit(10), F.lit(3), F.lit(4)).alias("p"), *(c.alias(f"b{k}") for k, c in enumerate(terrain.tile_bounds(F.lit(5120), F.lit(3), F.lit(4))))).first()
    assert tuple(row) == ("10/3_4.azt", 15360, 7774400, 20480, 7779520)
    outside = spark.createDataFrame([(0, 400_000.0, 6_601_000.0)], "id long, e double, n double")
    inside, whole = terrain.observer_cover(outside).collect(), terrain.raster.tile_cover(outside).collect()
    assert 0 < len(inside) < len(whole) and all(terrain.ANCHOR_NORTH - r["ty"] * r["cell"] * terrain.EDGES[r["cell"]] > 6_600_000 for r in inside)


def test_medians_by_tier_as_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.choice([None, *map(float, range(7))])) for _ in range(60)]
    got = {r["rank"]: (r["n"], r["median"]) for r in catalogue.tier_medians(spark.createDataFrame(rows, "sr int, v double"), "sr", "v").collect()}
    for k in {r for r, _ in rows}:
        above = sorted(v for r, v in rows if r >= k and v is not None)
        assert got[k] == (sum(r >= k for r, _ in rows), above[len(above) // 2])


def test_arrays_of_tiles(spark):
    """A tile of the finer level is pooled from cells that are there; a tile that is done is not made again."""
    v = np.arange(64.0).reshape(8, 8)
    source = spark.createDataFrame([(5, r, c, float(v[r, c])) for r in range(8) for c in range(8) if (r, c) != (7, 7)], "level int, row long, col long, v double")
    wanted = spark.createDataFrame([(10, 0, 0), (10, 1, 0), (10, 0, 1), (10, 1, 1), (10, 5, 5)], "cell int, tx int, ty int")
    done = spark.createDataFrame([(10, 1, 0)], "cell int, tx int, ty int")
    got = {(r["tx"], r["ty"]): r["v"] for r in terrain.raster.decode_tiles(terrain.build_tiles(wanted, done, source, {10: 2}, {10: 5})).collect()}
    pooled = v.reshape(4, 2, 4, 2).max(axis=(1, 3)) * 4
    pooled[3, 3] = 62 * 4
    assert got == {(x, y): pooled[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].ravel().tolist() for x, y in ((0, 0), (0, 1), (1, 1))}


def test_viewpoints(spark):
    """A ridge to the north rises in the profiles of both viewpoints, and more in the nearer one's."""
    rings, bands = ((1500, 10, 256),), ((1500, 10),)
    where = spark.createDataFrame([(1, 60.0, 24.0, 2.0, None), (2, 60.002, 24.0, 2.0, None)], "id long, lat double, lon double, eye double, override double")
    e, n = geo.to_grid(F.col("lat"), F.col("lon"))
    spots = {r["id"]: (r["e"], r["n"]) for r in where.select("id", e.alias("e"), n.alias("n")).collect()}
    tx, ty = int(spots[1][0] // 2560), int((terrain.ANCHOR_NORTH - spots[1][1]) // 2560)
    rows = []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            north = terrain.ANCHOR_NORTH - ((ty + dy) * 256 + np.arange(256) + 0.5) * 10
            v = np.repeat((np.abs(north - spots[1][1] - 900) < 20) * 400, 256)
            rows.append((10, tx + dx, ty + dy, 256, 256, 4, v.tolist()))
    tiles = spark.createDataFrame(rows, "cell int, tx long, ty long, width int, height int, scale int, v array<int>")
    index = tiles.select("cell", "tx", "ty", (F.array_max("v") / F.col("scale")).alias("most_m"))
    got = {r["id"]: (r["hobs"], r["profile"]) for r in sweep.viewpoints(where, tiles, index, 8, bands, rings).collect()}
    assert got[1][0] == got[2][0] == 2.0
    first, second = got[1][1], got[2][1]
    assert first[0] > 550 and second[0] > first[0] and first[4] < 0 and second[4] < 0 and len(first) == 8
