"""Queries on tables made for what shows only at size: ties, halves, many rows at one place."""

from __future__ import annotations

import math
import random

import duckdb
import pytest

from terravane.operators import catalogue, fuse, spatial, terrain
from terravane.plans.queries import ORACLE_SQL, QUERIES
from tests.test_operators import LAYER, metres, walked
from tests.test_queries import plain
from tests.test_settle import plain as merged_rows


def agrees(spark, folder, name, **tables):
    """The rows of a query over tables (name: (schema, rows)), which are those of its SQL."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    mine = sorted(tuple(plain(x) for x in r) for r in df.collect())
    assert mine == sorted(tuple(plain(x) for x in r) for r in con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall())
    return mine


def test_last_step_of_a_staircase_with_a_half(spark, tmp_path):
    """174.5 hundredths are 174, so that 175.09 after it is a step of its own; 175.5 and 176.4 are both 176."""
    rows = [(1, 1, 174.5), (1, 2, 175.09), (2, 1, 175.5), (2, 2, 176.4), (3, 1, 174.6), (3, 2, 175.2)]
    got = agrees(spark, tmp_path, "staircase_thinned", events=("user_id long, event_id long, value double", rows))
    assert len(got) == 4


def counted(monkeypatch):
    """The sizes of all joins by distance that follow."""
    join, sizes = spatial.range_join, []

    def counting(*args, **settings):
        pairs = join(*args, **settings)
        sizes.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "range_join", counting)
    return sizes


def crowd(rng, n, start, source):
    """n sites at three places, of which the outer two aren't near each other."""
    return [
        dict(id=start + k, seq=start + k, cat=rng.choice(["building", "obstower"]), lat=60 + rng.randrange(3) * 0.0005, lon=25.0, height_m=rng.choice([None, 10.0, 30.0, 60.0, 100.0, 150.0]), src_h=source, name=rng.choice([None, f"n{k}"]), srcs=[source])
        for k in range(n)
    ]


@pytest.mark.parametrize("most", [1 << 18, 100])
def test_crowded_places_are_merged_without_pairs(spark, monkeypatch, most):
    """Rows of few places, in order or in rounds: as in sequence; in order only pairs of places are made."""
    rng = random.Random(2)
    base, incoming = crowd(rng, 150, 0, "osm"), crowd(rng, 150, 1000, "aip")
    far = [dict(incoming[0], id=5000, seq=5000, lat=61.0, name="far"), dict(incoming[0], id=5001, seq=5001, lat=61.0, name="too")]
    monkeypatch.setitem(fuse.COMPONENT, "rows", most)
    sizes = counted(monkeypatch)
    objects, noted = fuse.merge_noting(spark.createDataFrame(base, LAYER), spark.createDataFrame(incoming + far, LAYER), 60.0, 10.0)
    want, conflicts = merged_in_order(base, incoming + far, 60.0, 10.0)
    assert merged_rows(objects.collect()) == want
    assert {r["id"]: r["into"] for r in noted.collect()} == conflicts and conflicts
    assert sizes[0] <= 100 and len(sizes) == (1 if most > 1000 else 2)


def merged_in_order(base, incoming, radius, sure):
    """The rule row by row over all objects, nearest first, of equals as a walk over cells meets them."""
    held, noted = [dict(o) for o in base], {}
    own = {o["id"]: o["height_m"] for o in (*base, *incoming)}
    agree = lambda a, b: a is None or b is None or abs(a - b) <= max(10, 0.15 * max(a, b))
    for r in incoming:
        near = sorted((h for h in walked(r, held) if metres(r, h) <= radius and h["cat"] in spatial.COMPATIBLE[r["cat"]]), key=lambda h: metres(r, h))
        h = next((h for h in near if agree(h["height_m"], r["height_m"]) or metres(r, h) <= sure), None)
        if h is None:
            held.append(dict(r))
            continue
        if metres(r, h) <= sure and not agree(own[h["id"]], own[r["id"]]):
            noted[r["id"]] = h["id"]
        if r["height_m"] is not None and (h["height_m"] is None or fuse.TRUST[r["src_h"]] > fuse.TRUST[h["src_h"]]):
            h["height_m"], h["src_h"] = r["height_m"], r["src_h"]
        h["name"], h["srcs"] = h["name"] or r["name"], sorted({*h["srcs"], *r["srcs"]})
    return {h["id"]: (h["height_m"], h["src_h"], h["name"], tuple(h["srcs"])) for h in held}, noted


def test_crowded_places_collapse_without_pairs(spark, monkeypatch):
    """400 marks at three places, of which the outer two are too far apart: as in sequence, from pairs of places. A null position meets nothing."""
    rng = random.Random(6)
    rows = [dict(id=k, lat=60.0099 + rng.randrange(3) * 0.00006, lon=25.0, vayla_type=rng.choice(list(fuse.MARK_RANK)), focal_m=rng.choice([None, 5.0, 9.0]), focal_agl_m=None, daymark_agl_m=None, name=rng.choice([None, f"n{k}"]), vayla_id=k) for k in range(400)]
    lost = [dict(rows[0], id=k, lat=None) for k in (1000, 1001)]
    held = []
    for o in sorted((dict(r) for r in rows), key=lambda o: (-fuse.MARK_RANK[o["vayla_type"]], -(o["focal_m"] or 0), o["id"])):
        into = next((h for h in walked(o, held) if metres(o, h) <= 10), None)
        if into is None:
            held.append(o)
        else:
            into |= {c: o[c] for c in fuse.FOLDED if into[c] is None}
    sizes = counted(monkeypatch)
    schema = "id long, lat double, lon double, vayla_type string, focal_m double, focal_agl_m double, daymark_agl_m double, name string, vayla_id long"
    got = {r["id"]: tuple(r[c] for c in fuse.FOLDED) for r in fuse.collapse(spark.createDataFrame(rows + lost, schema)).collect()}
    assert got == {h["id"]: tuple(h[c] for c in fuse.FOLDED) for h in held + lost}
    assert sizes == [7]


def test_closest_pairs_of_crowded_places(spark, monkeypatch):
    """Points that share positions, two of them alone, and one without a position: as all pairs say, from pairs of positions."""
    rng = random.Random(9)
    points = [(k, 60 + rng.randrange(4) * 0.002, 25.0) for k in rng.sample(range(300), 60)] + [(900, 60.02, 25.0), (901, 60.025, 25.0), (902, None, 25.0)]
    at = {k: dict(lat=lat, lon=lon) for k, lat, lon in points if lat}
    nearest = [min((round(metres(at[a], at[b]), 3), b) for b in at if a != b) for a in at]
    want = sorted((d, a, b) for a, (d, b) in zip(at, nearest, strict=True) if d <= 1000)
    sizes = counted(monkeypatch)
    for most in (6, 100):
        got = catalogue.closest_pairs(spark.createDataFrame(points, "id long, lat double, lon double"), 1000.0, most)
        assert [(r["d"], r["a_id"], r["b_id"]) for r in got.collect()] == want[:most]
    assert max(sizes) <= 6 * 6


def stored(monkeypatch):
    """The sizes of all tables that terrain stores from now on."""
    keep, sizes = terrain.checkpointed, []

    def counting(df):
        found = keep(df)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(terrain, "checkpointed", counting)
    return sizes


def test_rivals_at_crowded_places(spark, monkeypatch):
    """Names that share positions: of equal distances the smallest id but the summit's own, from pairs of positions."""
    rng = random.Random(8)
    places = [(k, rng.randrange(3) * 40.0, 0.0) for k in rng.sample(range(500), 90)] + [(700, 9000.0, 0.0), (701, None, 0.0)]
    found = [(k, None if x is None else x + 15.0, y, 30.0) for k, x, y in places]
    want = {}
    for k, x, y, own in found:
        near = [(math.hypot(x - qx, y - qy), q) for q, qx, qy in places if q != k and None not in (x, qx)] if x is not None else []
        want |= {k: min(near)[1]} if near and min(near)[0] < own else {}
    sizes = stored(monkeypatch)
    got = terrain.rivals(spark.createDataFrame(found, "id long, x double, y double, own double"), spark.createDataFrame(places, "id long, x double, y double"))
    assert {r["id"]: r["rival"] for r in got.collect()} == want and len(want) == 90
    assert sizes and max(sizes) <= 12


def test_summits_of_crowded_places(spark, monkeypatch, tmp_path):
    """Names that share positions are searched around once for each position; a name without a position has no summit."""
    rng = random.Random(12)
    supplier = ("s_suppkey long, s_name string, s_acctbal double, s_nationkey int", [(k + 2400 * i, f"n{k}", 1.0 * k, 0) for k in (1, 2, 3) for i in range(12)])
    orders = ("o_orderkey long, o_totalprice double", [(k, round(100_000 + 200 * (k % 64) + rng.random() * 9000, 2)) for k in range(8192)])
    sizes = stored(monkeypatch)
    assert len(agrees(spark, tmp_path, "summit_snap", supplier=supplier, orders=orders)) == 36
    assert sizes[0] == 3
    cells = spark.createDataFrame([(5, 5, 10.0), (5, 6, 12.0)], "row long, col long, v double")
    places = spark.createDataFrame([(1, 55.0, terrain.ANCHOR_NORTH - 55.0), (2, 55.0, terrain.ANCHOR_NORTH - 55.0), (3, None, None), (4, 9e5, 0.0)], "id long, x double, y double")
    assert {r["id"]: (r["pt"], r["top"], r["x"]) for r in terrain.summits(places, cells, 150.0).collect()} == {1: (10.0, 12.0, 65.0), 2: (10.0, 12.0, 65.0), 3: (None, None, None), 4: (None, None, None)}


def test_hills_of_crowded_places(spark, monkeypatch, tmp_path):
    """Hills of names that share positions are those of the SQL, from one search for each position."""
    rng = random.Random(13)
    supplier = ("s_suppkey long, s_name string, s_acctbal double, s_nationkey int", [(k + 2400 * i, f"n{k}", 1.0 * k, 0) for k in (1, 2, 4) for i in range(8)])
    orders = ("o_orderkey long, o_totalprice double", [(k, round(130_000 + rng.random() * 9000, 2)) for k in range(8192)])
    sizes = stored(monkeypatch)
    assert len(agrees(spark, tmp_path, "hill_assembly", supplier=supplier, orders=orders)) == 16
    assert sizes[0] == 2
