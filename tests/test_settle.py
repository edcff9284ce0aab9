"""Merge where one component of the candidate graph spans everything, and conflicts noted below a distance."""

from __future__ import annotations

import logging
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terravane.operators import fuse, spatial
from tests.test_operators import CELL, LAYER, cell, metres

RADIUS = 90.0


def field(rng, n, start, source, side):
    """n sites of one kind, spread evenly over a square of `side` metres."""
    return [
        dict(id=start + k, seq=start + k, cat="mast", lat=60 + rng.random() * side / 111320, lon=25 + rng.random() * side / 55660, height_m=rng.choice([None, 10.0, 20.0, 100.0, 130.0]), src_h=source, name=rng.choice([None, f"n{k}"]), srcs=[source])
        for k in range(n)
    ]


def in_order(base, incoming, radius, sure=-1.0):
    """The rule row by row; objects are found by cells, met row of cells by row, and in a cell as they came."""
    grid, held, noted = defaultdict(list), [], {}

    def keep(o):
        held.append(o)
        grid[cell(o)].append(o)

    for o in base:
        keep(dict(o))
    own = {o["id"]: o["height_m"] for o in (*base, *incoming)}
    for r in incoming:
        i, j = cell(r)
        around = [h for di in (-1, 0, 1) for dj in (-1, 0, 1) for h in grid.get((i + di, j + dj), ())]
        near = sorted(((metres(r, h), k, h) for k, h in enumerate(around) if metres(r, h) <= radius), key=lambda x: x[:2])
        for d, _, h in near:
            a, b = h["height_m"], r["height_m"]
            if a is None or b is None or abs(a - b) <= max(10, 0.15 * max(a, b)) or d <= sure:
                if b is not None and (a is None or fuse.TRUST[r["src_h"]] > fuse.TRUST[h["src_h"]]):
                    h["height_m"], h["src_h"] = b, r["src_h"]
                h["name"] = h["name"] or r["name"]
                h["srcs"] = sorted({*h["srcs"], *r["srcs"]})
                x, y = own[r["id"]], own[h["id"]]
                if d <= sure and x is not None and y is not None and abs(x - y) > max(10, 0.15 * max(x, y)):
                    noted[r["id"]] = h["id"]
                break
        else:
            keep(dict(r))
    return {h["id"]: (h["height_m"], h["src_h"], h["name"], tuple(h["srcs"])) for h in held}, noted


def largest_component(sites):
    """How many sites hang together within the radius, by filling from each in turn."""
    grid = defaultdict(list)
    small = lambda o: (int(o["lat"] * 1000), int(o["lon"] * 500))
    for o in sites:
        grid[small(o)].append(o)
    left, most = {o["id"] for o in sites}, 0
    for first in sites:
        if first["id"] not in left:
            continue
        left.discard(first["id"])
        todo, n = [first], 0
        while todo:
            o = todo.pop()
            n += 1
            i, j = small(o)
            near = [h for di in (-1, 0, 1) for dj in (-1, 0, 1) for h in grid[i + di, j + dj] if h["id"] in left and metres(o, h) <= RADIUS]
            left.difference_update(h["id"] for h in near)
            todo += near
        most = max(most, n)
    return most


def plain(rows):
    return {r["id"]: (None if r["height_m"] is None or math.isnan(r["height_m"]) else r["height_m"], r["src_h"], r["name"], tuple(r["srcs"])) for r in rows}


def test_merge_of_one_component(spark, caplog):
    """50,000 rows, nearly all in one component: rounds are few, and no task holds the component."""
    rng = random.Random(4)
    base, incoming = field(rng, 20_000, 0, "osm", 14_000), field(rng, 30_000, 1 << 20, "aip", 14_000)
    assert largest_component([*base, *incoming]) > 40_000
    a, b = (spark.createDataFrame(x, LAYER).repartition(4) for x in (base, incoming))
    with caplog.at_level(logging.INFO, logger="terravane.operators.fuse"):
        got = plain(fuse.merge(a, b, RADIUS).collect())
    assert got == in_order(base, incoming, RADIUS)[0]
    rounds = int(re.search(r"settled in (\d+) rounds", caplog.text)[1])
    assert 1 < rounds <= 40


@pytest.mark.parametrize("source", ["aip", "osm"])
def test_crowded_site(spark, source):
    """Very many registrations at one place, of ascending and of equal trust."""
    rng = random.Random(7)
    base = [dict(id=0, seq=0, cat="mast", lat=60.0, lon=25.0, height_m=None, src_h=None, name=None, srcs=["mtk"])]
    incoming = [dict(id=k, seq=k, cat="mast", lat=60.0 + rng.randrange(3) * 1e-5, lon=25.0, height_m=rng.choice([None, 30.0, 36.0, 90.0]), src_h=rng.choice(["osm", source]), name=rng.choice([None, f"n{k}"]), srcs=["x"]) for k in range(1, 400)]
    got = plain(fuse.merge(spark.createDataFrame(base, LAYER), spark.createDataFrame(incoming, LAYER), RADIUS).collect())
    for o in base:
        o["src_h"] = "none"
    fuse_trust = {**fuse.TRUST, "none": 0}
    held = [dict(o) for o in base]
    for r in incoming:
        for h in sorted(held, key=lambda h: (metres(r, h), h["seq"])):
            x, y = h["height_m"], r["height_m"]
            if x is None or y is None or abs(x - y) <= max(10, 0.15 * max(x, y)):
                if y is not None and (x is None or fuse_trust[r["src_h"]] > fuse_trust[h["src_h"]]):
                    h["height_m"], h["src_h"] = y, r["src_h"]
                h["name"], h["srcs"] = h["name"] or r["name"], sorted({*h["srcs"], *r["srcs"]})
                break
        else:
            held.append(dict(r))
    assert got == {h["id"]: (h["height_m"], h["src_h"], h["name"], tuple(h["srcs"])) for h in held}


def test_conflicts_are_merged_and_noted(spark):
    rng = random.Random(11)
    base, incoming = field(rng, 150, 0, "osm", 500), field(rng, 150, 1000, "aip", 500)
    objects, noted = fuse.merge_noting(spark.createDataFrame(base, LAYER), spark.createDataFrame(incoming, LAYER), RADIUS)
    want, conflicts = in_order(base, incoming, RADIUS, spatial.SURE_M)
    assert plain(objects.collect()) == want
    assert {r["id"]: r["into"] for r in noted.where(F.col("d") <= spatial.SURE_M).collect()} == conflicts and conflicts


def test_merge_of_nothing(spark):
    empty = spark.createDataFrame([], LAYER)
    row = spark.createDataFrame([dict(id=1, seq=1, cat="mast", lat=60.0, lon=25.0, height_m=None, src_h=None, name=None, srcs=None)], LAYER)
    assert fuse.merge(empty, empty, RADIUS).count() == 0
    assert fuse.merge(row, empty, RADIUS).count() == fuse.merge(empty, row, RADIUS).count() == 1


assert CELL == spatial.CELL_DEG
