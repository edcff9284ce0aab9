"""Prominence by merge trees against flooding cell by cell."""

from __future__ import annotations

import random

import pytest

from terravane.operators.prominence import prominences
from terravane.plans import views
from terravane.plans.queries import QUERIES


def flooded(cells, least=0.0, sea=0.0):
    """Every cell from the highest down; at each join the lower peak ends."""
    rows, cols = [r for r, _ in cells], [c for _, c in cells]
    edge = lambda r, c: r in (min(rows), max(rows)) or c in (min(cols), max(cols))
    parent, top, open_, found = {}, {}, {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(cells, key=lambda x: (-cells[x], x))
    rank = {x: k for k, x in enumerate(order)}
    levels = sorted(set(cells.values()), reverse=True)
    by = {v: [x for x in order if cells[x] == v] for v in levels}
    for v in levels:
        # Whether a peak is open is seen above the level at which it ends: what the level itself opens is no way up.
        before = {top[x]: open_[x] for x in parent if parent[x] == x}
        for x in by[v]:
            parent[x], top[x], open_[x] = x, x, False
        for x in by[v]:
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    y = (x[0] + dr, x[1] + dc)
                    if y not in parent:
                        continue
                    a, b = find(x), find(y)
                    if a == b:
                        continue
                    if rank[top[a]] > rank[top[b]]:
                        a, b = b, a
                    if cells[top[b]] > v:
                        found[top[b]] = (None if before[top[b]] else cells[top[b]] - v, v, before[top[b]])
                    parent[b] = a
                    open_[a] |= open_[b]
        for x in by[v]:
            if edge(*x):
                open_[find(x)] = True
    for x in parent:
        if find(x) == x:
            t = top[x]
            found[t] = (None, None, True) if open_[x] else (cells[t] - sea, None, False)
    return {x: f for x, f in found.items() if (f[2] and f[1] is None) or (cells[x] - f[1] if f[1] is not None else cells[x] - sea) >= least}


def got(spark, cells, **how):
    df = spark.createDataFrame([(r, c, float(v)) for (r, c), v in cells.items()], "row long, col long, v double")
    rows = prominences(df, **how).collect()
    found = {(r["row"], r["col"]): (r["prominence"], r["key_col"], r["open"]) for r in rows}
    assert len(found) == len(rows)
    return found


def land(seed, rows, cols, levels, holes, r0=0, c0=0):
    rng = random.Random(seed)
    return {(r0 + r, c0 + c): rng.randrange(1, levels) for r in range(rows) for c in range(cols) if rng.random() >= holes}


@pytest.mark.parametrize(("seed", "rows", "cols", "levels", "holes", "edge", "fan"), [(0, 30, 37, 10**6, 0.0, 5, 2), (1, 41, 23, 12, 0.0, 4, 4), (2, 26, 40, 8, 0.35, 6, 2), (3, 33, 33, 10**6, 0.6, 7, 4), (4, 20, 20, 50, 0.1, 64, 4), (5, 17, 90, 5, 0.2, 3, 3)])
def test_as_flooding(spark, seed, rows, cols, levels, holes, edge, fan):
    cells = land(seed, rows, cols, levels, holes, 3 * (seed % 2), 11 * (seed % 3))
    want = flooded(cells)
    assert got(spark, cells, edge=edge, fan=fan) == want
    assert any(not f[2] for f in want.values()) and any(f[2] for f in want.values())


def test_smooth_hills(spark):
    """Few peaks far apart, whose cols lie several tiles away."""
    hills = [(20, 20, 300), (20, 60, 250), (55, 40, 200), (60, 70, 280), (40, 12, 120)]
    cells = {(r, c): max(int(h - 5 * ((r - y) ** 2 + (c - x) ** 2) ** 0.5 * 2) for y, x, h in hills) + 400 for r in range(80) for c in range(90)}
    want = flooded(cells, least=30)
    assert got(spark, cells, edge=8, fan=2, least=30.0) == want


def test_edges(spark):
    assert got(spark, {}) == {}
    assert got(spark, {(5, 5): 7}) == {(5, 5): (None, None, True)}
    island = {(r, c): 10 for r in (0, 9) for c in (0, 9)} | {(4, 4): 50, (4, 5): 40, (7, 7): 30}
    found = got(spark, island, edge=4)
    assert found[4, 4] == (50.0, None, False) and found[7, 7] == (30.0, None, False)
    df = spark.createDataFrame([(0, 0, None), (1, 1, float("nan"))], "row long, col long, v double")
    assert prominences(df).count() == 0


def test_query_as_flooding(spark):
    folder = "/root/testdata/sf0.001"
    cells = {(r["row"], r["col"]): r["v"] for r in views.land(spark, folder).collect()}
    found = {(r["row"], r["col"]): (r["prominence"], r["key_col"], r["open"]) for r in QUERIES["prominence"](spark, folder).collect()}
    assert found == flooded(cells, least=30.0) and found
