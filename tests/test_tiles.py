"""Tiles as arrays: from blocks that don't fit the tiles, at their real size, against plain numpy."""

from __future__ import annotations

import time

import numpy as np
import pytest

from terravane.operators import raster, terrain

BLOCKS = "level int, bx long, by long, v array<double>"


def cut(a, edge):
    """A raster as blocks of `edge` cells; nan is nodata."""
    rows, cols = (-(-n // edge) * edge for n in a.shape)
    whole = np.full((rows, cols), np.nan)
    whole[: a.shape[0], : a.shape[1]] = a
    return {(x, y): whole[y * edge : (y + 1) * edge, x * edge : (x + 1) * edge] for y in range(rows // edge) for x in range(cols // edge)}


def frame(spark, levels, edge):
    rows = [(level, x, y, [None if np.isnan(q) else float(q) for q in b.ravel()]) for level, a in levels.items() for (x, y), b in cut(a, edge).items()]
    return spark.createDataFrame(rows, BLOCKS)


@pytest.mark.parametrize("block", [5, 12, 16, 40])
def test_blocks_that_do_not_fit(spark, block):
    rng = np.random.default_rng(block)
    fine, coarse = (np.where(rng.random((70, 50)) < 0.3, np.nan, rng.normal(100, 400, (70, 50)).round(2)) for _ in range(2))
    fine[:32, :32] = np.nan
    edges, refined = {10: 8, 20: 6}, {10: 5}
    wanted = spark.createDataFrame([(10, x, y) for x in range(5) for y in range(6)] + [(20, x, y) for x in range(10) for y in range(13)] + [(10, 0, 1)], "cell int, tx long, ty long")
    done = spark.createDataFrame([(20, 1, 1)], "cell int, tx long, ty long")
    got = {(r["cell"], r["tx"], r["ty"]): r for r in raster.decode_tiles(terrain.build_from_blocks(wanted, done, frame(spark, {5: fine, 20: coarse}, block), block, edges, refined)).collect()}
    want = {}
    for cell, a, edge, k in ((10, fine, 8, 2), (20, coarse, 6, 1)):
        for (x, y), b in cut(a, edge * k).items():
            p = b if k == 1 else np.array([[np.nan if np.isnan(b[2 * i : 2 * i + 2, 2 * j : 2 * j + 2]).all() else np.nanmax(b[2 * i : 2 * i + 2, 2 * j : 2 * j + 2]) for j in range(edge)] for i in range(edge)])
            if not np.isnan(p).all() and (cell, x, y) != (20, 1, 1):
                want[cell, x, y] = [None if np.isnan(q) else int(np.clip(np.rint(q * 4), -32767, 32767)) for q in p.ravel()]
    assert {k: r["v"] for k, r in got.items()} == want
    assert all(r["pooled"] == (k[0] == 10) and r["least"] == min(q for q in want[k] if q is not None) for k, r in got.items())


def test_cells_as_blocks(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random((300, 290)) < 0.2, np.nan, rng.normal(0, 50, (300, 290)).round(1))
    rows = [(10, r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(300) for c in range(290)]
    cells = spark.createDataFrame(rows, "level int, row long, col long, v double")
    got = {(r["bx"], r["by"]): np.array([np.nan if q is None else q for q in r["v"]]).reshape(64, 64) for r in raster.blocks(cells, 64).collect()}
    want = cut(a, 64)
    assert got.keys() == want.keys()
    assert all(np.array_equal(got[k], want[k], equal_nan=True) for k in want)


def test_a_tile_of_real_size_is_quick():
    """The kernel's work on one tile of 512 by 512 cells, pooled from 1,024 by 1,024."""
    a = np.add.outer(np.sin(np.arange(1024) / 40) * 200, np.cos(np.arange(1024) / 90) * 150) + np.random.default_rng(0).random((1024, 1024))
    start = time.perf_counter()
    data = raster.encoded(raster.pooled(a, 2), 10, 3, 4, True)
    back = raster.decoded(data)
    assert time.perf_counter() - start < 2
    assert back.shape == (512, 512) and raster.header(data)[:6] == (10, 3, 4, 512, 512, True)
    assert np.array_equal(back, np.rint(a.reshape(512, 2, 512, 2).max((1, 3)) * 4))
