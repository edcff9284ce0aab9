"""Operators that SQL can't express, against plain sequential versions, and known values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import geo, text
from terravane.operators import fuse, graph, labels, raster, skyline, spatial
from terravane.sources import sinks


def metres(a, b):
    return math.hypot((a["lat"] - b["lat"]) * 111320.0, (a["lon"] - b["lon"]) * 111320.0 * math.cos(math.radians(a["lat"])))


LAYER = "id long, seq long, cat string, lat double, lon double, height_m double, src_h string, name string, srcs array<string>"


CELL = 0.01


def cell(o):
    return int(o["lat"] / CELL), int(o["lon"] / CELL)


def walked(o, held):
    """What is held in the cells around o: row of cells by row, and in a cell as it came."""
    i, j = cell(o)
    around = [(i + di, j + dj) for di in (-1, 0, 1) for dj in (-1, 0, 1)]
    return [h for c in around for h in held if cell(h) == c]


def layer(rng, n, start, source, cats, spacing=1e-9):
    """Sites on a lattice; with a spacing of zero many distances tie. Ids do not follow the order."""
    ids = rng.sample(range(start, start + n), n)
    out = []
    for k in range(n):
        out.append(dict(id=ids[k], seq=start + k, cat=rng.choice(cats), lat=60 + rng.randrange(40) * 0.0004 + k * spacing, lon=25 + rng.randrange(40) * 0.0008, height_m=rng.choice([None, 10.0, 20.0, 100.0, 130.0]), src_h=source, name=rng.choice([None, f"n{k}"]), srcs=[source]))
    return out


def merged(base, incoming, radius):
    held = [dict(r) for r in base]
    for r in incoming:
        near = sorted((h for h in walked(r, held) if metres(r, h) <= radius), key=lambda h: metres(r, h))
        for h in (h for h in near if h["cat"] in spatial.COMPATIBLE.get(r["cat"], ())):
            a, b = h["height_m"], r["height_m"]
            if a is None or b is None or abs(a - b) <= max(10, 0.15 * max(a, b)):
                if b is not None and (a is None or fuse.TRUST[r["src_h"]] > fuse.TRUST[h["src_h"]]):
                    h["height_m"], h["src_h"] = b, r["src_h"]
                h["name"] = h["name"] or r["name"]
                h["srcs"] = sorted({*h["srcs"], *r["srcs"]})
                break
        else:
            held.append(dict(r))
    return {h["id"]: (h["cat"], h["height_m"], h["src_h"], h["name"], tuple(h["srcs"])) for h in held}


@pytest.mark.parametrize(("seed", "spacing"), [(0, 1e-9), (1, 0), (2, 0)])
def test_merge_as_in_sequence(spark, seed, spacing):
    rng = random.Random(seed)
    base, incoming = layer(rng, 80, 0, "osm", ["mast", "obstower", "pylon"], spacing), layer(rng, 80, 1000, "aip", ["mast", "building", "pylon"], spacing)
    out = fuse.merge(spark.createDataFrame(base, LAYER), spark.createDataFrame(incoming, LAYER), 90.0).collect()
    nan = lambda x: None if x is None or x != x else x
    assert {r["id"]: (r["cat"], nan(r["height_m"]), r["src_h"], r["name"], tuple(r["srcs"])) for r in out} == merged(base, incoming, 90.0)


@pytest.mark.parametrize("seed", range(2))
def test_collapse_as_in_sequence(spark, seed):
    rng = random.Random(seed)
    rows = [dict(id=i, lat=60.0099 + rng.randrange(6) * 0.00004, lon=25.0098 + rng.randrange(6) * 0.00007, vayla_type=rng.choice([*fuse.MARK_RANK, "x"]), focal_m=rng.choice([None, 5.0, 9.0]), focal_agl_m=None, daymark_agl_m=rng.choice([None, 7.0]), name=rng.choice([None, f"n{i}"]), vayla_id=i) for i in range(60)]
    hint = lambda o: max((o[c] for c in ("focal_agl_m", "daymark_agl_m", "focal_m") if o[c] is not None), default=0.0)
    held = []
    for o in sorted((dict(r) for r in rows), key=lambda o: (-fuse.MARK_RANK.get(o["vayla_type"], 0), -hint(o), o["id"])):
        into = next((h for h in walked(o, held) if metres(o, h) <= 10), None)
        if into is None:
            held.append(o)
            continue
        for c in fuse.FOLDED:
            into[c] = o[c] if into[c] is None else into[c]
    schema = "id long, lat double, lon double, vayla_type string, focal_m double, focal_agl_m double, daymark_agl_m double, name string, vayla_id long"
    nan = lambda x: None if x is None or x != x else x
    got = {r["id"]: tuple(nan(r[c]) for c in fuse.FOLDED) for r in fuse.collapse(spark.createDataFrame(rows, schema)).collect()}
    assert got == {h["id"]: tuple(h[c] for c in fuse.FOLDED) for h in held}


def test_merge_keeps_two_masts_of_different_height(spark):
    row = dict(seq=0, cat="mast", lon=25.0, name=None, srcs=["osm"])
    base = [{**row, "id": 0, "lat": 60.0, "height_m": 322.0, "src_h": "osm"}]
    other = [{**row, "id": 1, "seq": 1, "lat": 60.0 + 100 / 111320, "height_m": 121.0, "src_h": "aip"}]
    assert fuse.merge(spark.createDataFrame(base, LAYER), spark.createDataFrame(other, LAYER), 150.0).count() == 2


def test_collapse(spark):
    schema = "id long, lat double, lon double, vayla_type string, focal_m double, focal_agl_m double, daymark_agl_m double, name string, vayla_id long"
    rows = [(1, 60.0, 25.0, "Linjamerkki", None, 7.0, None, "b", 1), (2, 60.00002, 25.0, "Merimajakka", 50.0, None, None, None, 2), (3, 60.1, 25.0, "Linjamerkki", None, None, None, "c", 3)]
    out = {r["id"]: r for r in fuse.collapse(spark.createDataFrame(rows, schema)).collect()}
    assert set(out) == {2, 3} and out[2]["focal_agl_m"] == 7.0 and out[2]["name"] == "b"


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("south", [0.0, 60.0, 70.0, 84.0])
def test_range_join_as_all_pairs(spark, south):
    rng = random.Random(2)
    a, b = ([dict(id=i, lat=south + rng.random() * 0.03, lon=25 + rng.random() * 0.06) for i in range(80)] for _ in range(2))
    schema = "id long, lat double, lon double"
    got = {(r["a_id"], r["b_id"]) for r in spatial.range_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 300.0).collect()}
    want = {(x["id"], y["id"]) for x in a for y in b if metres(x, y) <= 300}
    assert got == want and want


def test_projection_and_geodesics(spark):
    df = spark.createDataFrame([(60.0, 27.0), (60.15672, 24.95604)], "lat double, lon double")
    e, n = geo.to_grid(F.col("lat"), F.col("lon"))
    rows = df.select(e.alias("e"), n.alias("n"), "lat", "lon")
    got = rows.collect()
    assert [(round(r["e"], 3), round(r["n"], 3)) for r in got] == [(500000.0, 6651411.19), (386544.44, 6670620.561)]
    lat, lon = geo.to_degrees(F.col("e"), F.col("n"))
    back = rows.select((lat - F.col("lat")).alias("a"), (lon - F.col("lon")).alias("b")).collect()
    assert all(abs(x) < 1e-8 for r in back for x in r)
    zero = spark.range(1).select(geo.inverse(F.lit(60.0), F.lit(25.0), F.lit(60.0), F.lit(25.0)).alias("g")).first()["g"]
    assert (zero["bearing"], zero["metres"]) == (0.0, 0.0)


def test_known_angles(spark):
    cases = [(369.1, 17_560.0, 1.063), (544.6, 99_890.0, -0.091), (338.3, 76_300.0, -0.061)]
    df = spark.createDataFrame(cases, "h double, d double, want double").withColumn("a", geo.elevation(F.col("h"), F.lit(22.3), F.col("d")))
    assert all(abs(r["a"] - r["want"]) < 6e-4 for r in df.collect())
    falls = spark.createDataFrame([(60e3,), (90e3,), (100e3,)], "d double").select(F.round(geo.drop(F.col("d"))).alias("x")).collect()
    assert [r["x"] for r in falls] == [246, 553, 683]


def test_text(spark):
    rows = [("75 (estimate)", 75.0), ("61.0;61", 61.0), ("10;7.5", 10.0), ("NIL", None), ("", None), ("10,5", 10.5), ("-3", -3.0), (None, None)]
    got = spark.createDataFrame(rows, "s string, want double").withColumn("x", text.leading_number(F.col("s"))).collect()
    assert all(r["x"] == r["want"] for r in got)
    kv = spark.createDataFrame([("a: 1, b : 2\\na: 3, c: , d",), (None,)], "s string").select(text.key_values(F.col("s")).alias("m")).collect()
    assert [r["m"] for r in kv] == [{"a": "1", "b": "2", "c": ""}, {}]
    ids = spark.createDataFrame([(2**31,), (2**32 - 1,), (5,), (-7,)], "v long").select(text.wrap32(F.col("v")).alias("v")).collect()
    assert [r["v"] for r in ids] == [-(2**31), -1, 5, -7]


def test_thinned_as_a_loop(spark):
    rng = random.Random(3)
    rays = {b: sorted((float(d), rng.random() * 4 - 1 + d * 0.001) for d in range(10, 2000, 10)) for b in range(5)}
    want = set()
    for b, samples in rays.items():
        high, kept = -99.0, []
        records = []
        for d, a in samples:
            if a > high:
                high = a
                records.append((d, a))
        for d, a in records:
            if a > -6 and (not kept or a > kept[-1][1] + 0.02):
                kept.append((d, a))
        if records and round(records[-1][1] * 100) != round(kept[-1][1] * 100):
            kept.append(records[-1])
        want |= {(b, d, a) for d, a in kept}
    df = spark.createDataFrame([(b, d, a) for b, s in rays.items() for d, a in s], "bin long, d double, a double")
    got = skyline.thinned(skyline.records(df, "bin", "d", "a"))
    assert {tuple(r) for r in got.collect()} == want


def test_schedule(spark):
    assert skyline.schedule(spark).agg(F.count("*"), F.max("d")).first()[:] == (2200, 90000.0)


def test_label_budget(spark):
    rng = random.Random(4)
    rows = [(0, i, rng.random() * 360, rng.random()) for i in range(200)]
    kept = [r["bearing"] for r in labels.budget(spark.createDataFrame(rows, "observer long, id long, bearing double, size double")).collect()]
    assert all(sum((a - lo) % 360 <= 10 for a in kept) <= 3 for lo in kept)
    assert max(rows, key=lambda r: r[3])[2] in kept


def test_tiles_round_trip(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.random((8, 16)) * 20000 - 10000, 2)
    values = [None if x > 9000 else float(x) for x in v.ravel()]
    rows = [(10, 3, 4, 16, 8, True, values), (10, 3, 5, 16, 8, False, [None] * 128)]
    schema = "cell int, tx int, ty int, width int, height int, pooled boolean, v array<double>"
    files = raster.encode_tiles(spark.createDataFrame(rows, schema))
    got = raster.decode_tiles(files).collect()
    assert len(got) == 1 and (got[0]["tx"], got[0]["pooled"], got[0]["scale"]) == (3, True, 4)
    assert got[0]["v"] == [None if x is None else max(-32767, min(32767, round(x * 4))) for x in values]
    head = raster.decode_tiles(files, header_only=True).first()
    live = [x for x in got[0]["v"] if x is not None]
    assert (head["v"], head["least"], head["most"]) == (None, min(live), max(live))
    index = raster.tile_index(raster.decode_tiles(files, header_only=True).withColumn("bytes", F.lit(1))).first()
    assert list(index["tiles"]) == ["3_4"]


def test_plateau_takes_the_first_cell(spark):
    cells = spark.createDataFrame([(0, r, c, 5.0) for r in range(9) for c in range(9)], "tile long, row long, col long, v double")
    points = spark.createDataFrame([(1, 0, 4, 4)], "id long, tile long, row long, col long")
    top = raster.disc_top(points, cells, 2).first()
    assert (top["row"], top["col"]) == (2, 4)


def test_resume(spark):
    a, b = spark.range(5), spark.range(3)
    assert sorted(r["id"] for r in sinks.resume(a, b, "id").collect()) == [3, 4]


def test_farms_in_the_far_north(spark):
    """At 70 N a cell of 0.05 degrees is 1,904 m wide: 1,980 m can lie two cells apart."""
    step = 1980.0 / (111320.0 * math.cos(math.radians(70.0)))
    sites = spark.createDataFrame([(1, 70.0, 25.0499), (2, 70.0, 25.0499 + step), (3, 70.0, 27.0)], "id long, lat double, lon double")
    assert sorted(tuple(r) for r in labels.farms(sites).select("id", "farm").collect()) == [(1, 1), (2, 1), (3, 3)]
