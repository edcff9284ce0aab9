"""Parts of large rasters and of tile files: what is read, what is not, and what a failed write leaves."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import raster
from terravane.sources import blocks


def tiff(path, width, height, w, h, block_of, order="<", big=False, packed=8):
    """A tiled GeoTIFF whose internal tiles come from block_of(number); blocks that are the same object are stored once."""
    n = -(-width // w) * -(-height // h)
    place = {}
    with open(path, "wb") as f:
        f.write(bytes(16))
        starts, sizes = [], []
        for k in range(n):
            data = block_of(k)
            if id(data) not in place:
                place[id(data)] = (f.tell(), data)
                f.write(data)
            starts.append(place[id(data)][0])
            sizes.append(len(data))
        kind, letter = (16, "Q") if big else (4, "I")
        values = {256: (4, "I", [width]), 257: (4, "I", [height]), 258: (3, "H", [32]), 259: (3, "H", [packed]), 322: (3, "H", [w]), 323: (3, "H", [h]), 324: (kind, letter, starts), 325: (4, "I", sizes), 339: (3, "H", [3]), 33550: (12, "d", [10.0, 10.0, 0.0]), 33922: (12, "d", [0.0, 0.0, 0.0, 1000.0, 9000.0, 0.0]), 42113: (2, "s", [b"-9999\0"])}
        inline, entries = (8 if big else 4), b""
        for tag, (t, c, v) in values.items():
            raw = v[0] if c == "s" else struct.pack(f"{order}{len(v)}{c}", *v)
            count = len(raw) if c == "s" else len(v)
            if len(raw) > inline:
                at = f.tell()
                f.write(raw)
                raw = struct.pack(order + ("Q" if big else "I"), at)
            entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, t, count) + raw.ljust(inline, b"\0")
        at = f.tell()
        f.write(struct.pack(order + ("Q" if big else "H"), len(values)) + entries + bytes(8))
        f.seek(0)
        mark = {"<": b"II", ">": b"MM"}[order]
        f.write(mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at)))


@pytest.mark.parametrize(("order", "big", "packed"), [("<", False, 8), (">", False, 1), ("<", True, 8), (">", True, 8)])
def test_all_cells(spark, tmp_path, order, big, packed):
    rng = np.random.default_rng(3)
    a = rng.normal(100, 50, (50, 70)).astype(np.float32)
    a[rng.random(a.shape) < 0.2] = -9999
    whole = np.full((64, 80), -9999, np.float32)
    whole[:50, :70] = a

    def block(k):
        data = whole[k // 5 * 16 :][:16, k % 5 * 16 :][:, :16].astype(order + "f4").tobytes()
        return data if packed == 1 else zlib.compress(data)

    tiff(tmp_path / "a.tif", 70, 50, 16, 16, block, order, big, packed)
    got = np.full(a.shape, np.nan)
    for r in blocks.tiff_blocks(spark, str(tmp_path), 3 * 16 * 16 * 4).collect():
        part = np.array([np.nan if x is None else x for x in r["v"]]).reshape(r["row1"] - r["row0"] + 1, -1)
        got[r["row0"] : r["row1"] + 1, r["col0"] : r["col1"] + 1] = part
        assert (r["cell"], r["west"], r["north"]) == (10.0, 1000.0, 9000.0)
    assert np.array_equal(got, np.where(a == -9999, np.nan, a), equal_nan=True)


def test_a_window_of_a_large_raster_reads_its_tiles_only(spark, tmp_path):
    """20,000 by 20,000 cells; all internal tiles but the window's are no deflated data at all, so that reading one fails."""
    broken = b"no data"
    good = {k: zlib.compress((np.arange(512 * 512, dtype="<f4") % 1000 + k).astype("<f4").tobytes(), 1) for k in (10 * 40 + 20, 10 * 40 + 21, 11 * 40 + 20, 11 * 40 + 21)}
    tiff(tmp_path / "big.tif", 20_000, 20_000, 512, 512, lambda k: good.get(k, broken))
    rows, cols = (11 * 512 - 3, 11 * 512 + 2), (21 * 512 - 4, 21 * 512 + 5)
    window = blocks.tiff_window(spark, str(tmp_path / "big.tif"), rows, cols)
    got = {(r["row"], r["col"]): r["v"] for r in window.collect()}
    assert len(got) == 6 * 10
    for (r, c), v in got.items():
        assert v == (r % 512 * 512 + c % 512) % 1000 + (r // 512) * 40 + c // 512
    with pytest.raises(Exception, match="incorrect header check"):
        blocks.tiff_blocks(spark, str(tmp_path / "big.tif")).agg(F.sum(F.size("v"))).collect()


def test_a_large_raster_in_many_tasks(spark, tmp_path):
    same = zlib.compress(np.full(512 * 512, 7, "<f4").tobytes())
    tiff(tmp_path / "big.tif", 20_000, 20_000, 512, 512, lambda k: same)
    df = blocks.tiff_blocks(spark, str(tmp_path / "big.tif"))
    assert df.rdd.getNumPartitions() == -(-1600 // 64)
    some = df.where("row0 < 4096 AND col0 < 4096").select(F.sum(F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x)).alias("s"), F.count("*").alias("n")).first()
    assert (some["s"], some["n"]) == (7.0 * 4096 * 4096, 64)
    assert blocks.tiff_blocks(spark, str(tmp_path / "big.tif")).where("row0 < 0").count() == 0


def tiles(spark, n):
    a = [(10, x, y, raster.encoded(np.full((8, 8), float(x + y)), 10, x, y, False)) for x in range(n) for y in range(n)]
    return spark.createDataFrame(a, "cell int, tx int, ty int, content binary").repartition(4)


def test_tile_files(spark, tmp_path):
    path = str(tmp_path / "t")
    assert blocks.tile_headers(spark, path).count() == 0
    blocks.write_tiles(tiles(spark, 3), path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.azt")}
    assert {str(p.relative_to(path)) for p in before} == {f"10/{x}_{y}.azt" for x in range(3) for y in range(3)}
    blocks.write_tiles(tiles(spark, 4), path)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    headers = {(r["tx"], r["ty"]): (r["least"], r["bytes"]) for r in blocks.tile_headers(spark, path).collect()}
    assert headers == {(x, y): (4 * (x + y), (tmp_path / f"t/10/{x}_{y}.azt").stat().st_size) for x in range(4) for y in range(4)}
    assert not [p for p in (tmp_path / "t").iterdir() if p.name != "10"]
    got = {(r["tx"], r["ty"]): r["v"] for r in raster.decode_tiles(blocks.tile_contents(spark, path).where("tx = 2 AND ty >= 2")).collect()}
    assert got == {(2, y): [4 * (2 + y)] * 64 for y in (2, 3)}


def test_headers_are_36_bytes(spark, tmp_path):
    """Tile files cut after their headers are enough for an index, and files that a filter leaves out may be anything."""
    blocks.write_tiles(tiles(spark, 2), str(tmp_path / "t"))
    for p in (tmp_path / "t").rglob("*.azt"):
        p.write_bytes(p.read_bytes()[: raster.HEADER_BYTES])
    assert blocks.tile_headers(spark, str(tmp_path / "t")).count() == 4
    (tmp_path / "t/10/9_9.azt").write_bytes(b"x")
    assert blocks.tile_headers(spark, str(tmp_path / "t")).where("tx <= 1").select(F.sum("least").alias("s")).first()["s"] == 4 * (0 + 1 + 1 + 2)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    broken = tiles(spark, 3).withColumn("content", F.when((F.col("tx") == 2) & (F.col("ty") == 2), F.raise_error(F.lit("no tile")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no tile"):
        blocks.write_tiles(broken.coalesce(1), str(tmp_path / "one"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    # Tasks that are killed while they write may leave files under names of their own, never a tile.
    with pytest.raises(Exception, match="no tile"):
        blocks.write_tiles(broken, str(tmp_path / "many"))
    assert not list(tmp_path.rglob("*.azt")) and blocks.tile_headers(spark, str(tmp_path / "many")).count() == 0
