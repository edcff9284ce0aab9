"""Rasters in long form (tile, row, col, v) and as tiles of bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tile format's header, scale and nodata; the tile grid's anchor and rings (outer metres, cell, edge).
# Header: magic, header bytes, value type, predictor, west and north edge, cell, columns, rows, scale, nodata,
# compression, flags (1 pooled, 2 has nodata), payload bytes, least and greatest stored value.
HEADER, HEADER_BYTES = "<4sHBBiiHHHhhBBIhh", 36
MAGIC, SCALE, NODATA = b"AZT1", 4, -32768
INT16, DELTA, DEFLATE = 1, 2, 1
ANCHOR_NORTH = 7_800_000
RINGS = ((12_000, 10, 512), (35_000, 20, 512), (60_000, 50, 256), (90_000, 100, 256))
TILE_SCHEMA = "cell int, tx int, ty int, width int, height int, pooled boolean, scale int, least int, most int, v array<int>"


def quantise(v: Column) -> Column:
    """Quarter metres, to even at halves, kept within 16 bits."""
    return F.greatest(F.lit(-32767), F.least(F.lit(32767), F.rint(v * SCALE))).cast("int")


def wrap16(v: Column) -> Column:
    return F.pmod(v + 32768, F.lit(65536)) - 32768


def max_pool(cells: DataFrame, k: int, width: int, height: int) -> DataFrame:
    """Maxima of k by k blocks; the rows and columns that fill no block are dropped. Nodata is null."""
    whole = cells.where((F.col("row") < height // k * k) & (F.col("col") < width // k * k))
    return whole.groupBy("tile", F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col")).agg(F.max("v").alias("v"))


def zone_map(cells: DataFrame) -> DataFrame:
    """Least and greatest value and number of live cells of each tile."""
    return cells.groupBy("tile").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("live"))


def _line() -> Window:
    return Window.partitionBy("tile", "row").orderBy("col")


def delta_encoded(cells: DataFrame, v: str = "q") -> DataFrame:
    return cells.withColumn("delta", wrap16(F.col(v) - F.coalesce(F.lag(v).over(_line()), F.lit(0))))


def delta_decoded(cells: DataFrame, delta: str = "delta") -> DataFrame:
    return cells.withColumn("q", wrap16(F.sum(delta).over(_line().rowsBetween(Window.unboundedPreceding, Window.currentRow))))


def disc_top(points: DataFrame, cells: DataFrame, radius: int) -> DataFrame:
    """The highest cell of each point's disc (id, tile, row, col in cells), the first in raster order of equals.

    Points and cells meet by blocks as wide as the radius.
    """
    block = lambda c: F.floor(F.col(c) / radius)
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    p = points.select("id", "tile", F.col("row").alias("pr"), F.col("col").alias("pc"), F.explode(offsets).alias("o"), block("row").alias("br"), block("col").alias("bc"))
    p = p.withColumn("br", F.col("br") + F.col("o.i")).withColumn("bc", F.col("bc") + F.col("o.j")).drop("o")
    c = cells.where("v IS NOT NULL").withColumn("br", block("row")).withColumn("bc", block("col"))
    d2 = (F.col("row") - F.col("pr")) * (F.col("row") - F.col("pr")) + (F.col("col") - F.col("pc")) * (F.col("col") - F.col("pc"))
    inside = p.join(c, ["tile", "br", "bc"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    best = F.max_by(F.struct("row", "col", "v", "d2"), F.struct("v", -F.col("row"), -F.col("col"))).alias("b")
    return inside.groupBy("id").agg(best).select("id", "b.*")


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, v): the weighted mean of the four cells around each point (id, tile, y, x in cells); nodata carries no weight."""
    r, c = F.floor(F.col("y") - 0.5), F.floor(F.col("x") - 0.5)
    corners = F.array(*(F.struct((r + i).alias("row"), (c + j).alias("col")) for i in (0, 1) for j in (0, 1)))
    p = points.withColumn("k", F.explode(corners)).select("id", "tile", "y", "x", "k.row", "k.col")
    weight = (1 - F.abs(F.col("y") - 0.5 - F.col("row"))) * (1 - F.abs(F.col("x") - 0.5 - F.col("col")))
    met = p.join(cells.where("v IS NOT NULL"), ["tile", "row", "col"]).withColumn("w", weight)
    return met.groupBy("id").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def tile_cover(observers: DataFrame, rings=RINGS) -> DataFrame:
    """(id, cell, tx, ty, nearest): the tiles of each ring around observers (id, e, n), without what inner rings hold."""
    found, inner = None, 0
    for outer, cell, edge in rings:
        step = cell * edge
        e, n = F.col("e"), F.col("n")
        span = lambda low, high: F.sequence(F.floor(low / step), F.floor(high / step))
        down = ANCHOR_NORTH - n
        tiles = observers.withColumn("tx", F.explode(span(e - outer, e + outer))).withColumn("ty", F.explode(span(down - outer, down + outer)))
        dx = F.greatest(F.col("tx") * step - e, e - (F.col("tx") + 1) * step, F.lit(0.0))
        dy = F.greatest(F.col("ty") * step - down, down - (F.col("ty") + 1) * step, F.lit(0.0))
        fx = F.greatest(F.abs(F.col("tx") * step - e), F.abs((F.col("tx") + 1) * step - e))
        fy = F.greatest(F.abs(F.col("ty") * step - down), F.abs((F.col("ty") + 1) * step - down))
        near2, far2 = dx * dx + dy * dy, fx * fx + fy * fy
        kept = tiles.where((near2 <= outer * outer) & (far2 > inner * inner)).select("id", F.lit(cell).alias("cell"), "tx", "ty", F.sqrt(near2).alias("nearest"))
        found = kept if found is None else found.unionByName(kept)
        inner = outer
    return found


def pooled(a: np.ndarray, k: int) -> np.ndarray:
    """Maxima of k by k blocks of an array as a view of k-strided axes; nan is nodata, and what fills no block is dropped."""
    rows, cols = a.shape[0] // k, a.shape[1] // k
    return np.fmax.reduce(np.fmax.reduce(a[: rows * k, : cols * k].reshape(rows, k, cols, k), axis=3), axis=1)


def numbers(values: pa.Array) -> np.ndarray:
    """An Arrow array of numbers as doubles, null as nan."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as one Arrow array of lists, nan as null."""
    flat = np.concatenate([np.zeros(0), *(a.ravel() for a in arrays)])
    gaps = np.isnan(flat)
    values = pa.array(np.where(gaps, 0, flat), pa.float64()).cast(kind)
    if gaps.any():
        values = pc.if_else(pa.array(gaps), pa.scalar(None, kind), values)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(a.size for a in arrays)]), pa.int32()), values)


def scattered(rows: DataFrame, keys: list[str], at: str, value: str, size: int, kind: str = "double", out: str = "v") -> DataFrame:
    """(keys, out): for each key an array of `size` with the values at their places and null elsewhere.

    Places outside are dropped; of equal places the greatest value counts. A key's rows meet in one task and become one array there.
    """
    parts = rows.select(*keys, F.col(at).cast("long").alias("_at"), F.col(value).cast("double").alias("_value"))
    # Two keys may differ in kind; all rows of a group have the same.
    schema = parts.select(*keys, F.lit(None).cast(f"array<{kind}>").alias(out)).schema
    to = {"int": pa.int32(), "short": pa.int16(), "float": pa.float32()}.get(kind, pa.float64())

    def fill(group: pa.Table) -> pa.Table:
        place, found = group.column("_at").to_numpy(), numbers(group.column("_value").combine_chunks())
        inside = (place >= 0) & (place < size)
        filled = np.full(size, np.nan)
        np.fmax.at(filled, place[inside], found[inside])
        first = [group.column(c).slice(0, 1).combine_chunks() for c in keys]
        return pa.Table.from_arrays([*first, listed([filled], to)], [*keys, out])

    return parts.groupBy(*keys).applyInArrow(fill, schema)


def blocks(cells: DataFrame, edge: int) -> DataFrame:
    """(level, bx, by, v): cells (level, row, col, v), counted from the anchor, as square arrays of `edge` cells; nodata is null."""
    at = F.pmod("row", F.lit(edge)) * edge + F.pmod("col", F.lit(edge))
    placed = cells.where("v IS NOT NULL").select("level", F.floor(F.col("col") / edge).alias("bx"), F.floor(F.col("row") / edge).alias("by"), at.alias("k"), "v")
    return scattered(placed, ["level", "bx", "by"], "k", "v", edge * edge)


def block_values(points: DataFrame, level: DataFrame, edge: int, row: str = "row", col: str = "col", out: str = "v") -> DataFrame:
    """points with the value of the cell (row, col) they name, from one level's blocks (bx, by, v) of `edge` cells; null where it is not known.

    Points meet blocks by number, and a value is picked from its block by place: the raster is not taken apart, however few the points are.
    """
    block = level.select(F.col("bx").alias("_bx"), F.col("by").alias("_by"), F.col("v").alias("_v"))
    where = (F.floor(F.col(col) / edge) == F.col("_bx")) & (F.floor(F.col(row) / edge) == F.col("_by"))
    at = (F.pmod(F.col(row), F.lit(edge)) * edge + F.pmod(F.col(col), F.lit(edge))).cast("int")
    return points.join(block, where, "left").withColumn(out, F.get("_v", at)).drop("_bx", "_by", "_v")


def encoded(a: np.ndarray, cell: int, tx: int, ty: int, pooled: bool) -> bytes | None:
    """A tile's bytes: header, then its quantised rows as deflated differences; None without a live cell."""
    live = ~np.isnan(a)
    if not live.any():
        return None
    height, width = a.shape
    q = np.where(live, np.clip(np.rint(np.where(live, a, 0) * SCALE), -32767, 32767), NODATA).astype(np.int16)
    delta = np.diff(q, axis=1, prepend=np.zeros((height, 1), np.int16))
    body = zlib.compress(delta.astype("<i2").tobytes(), 9)
    flags = int(pooled) | 2 * int(not live.all())
    least, most = int(q[live].min()), int(q[live].max())
    west, north = tx * cell * width, ANCHOR_NORTH - ty * cell * height
    return struct.pack(HEADER, MAGIC, HEADER_BYTES, INT16, DELTA, west, north, cell, width, height, SCALE, NODATA, DEFLATE, flags, len(body), least, most) + body


def encode_tiles(tiles: DataFrame) -> DataFrame:
    """(cell, tx, ty, content) of tiles (cell, tx, ty, width, height, pooled, v); those without a live cell are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                cell, tx, ty, width, height, was_pooled = (b.column(i)[k].as_py() for i in range(6))
                made = encoded(numbers(b.column(6)[k].values).reshape(height, width), cell, tx, ty, was_pooled)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([tx], pa.int32()), pa.array([ty], pa.int32()), pa.array([made], pa.binary())], ["cell", "tx", "ty", "content"])

    columns = tiles.select("cell", F.col("tx").cast("int"), F.col("ty").cast("int"), "width", "height", "pooled", F.col("v").cast("array<double>").alias("v"))
    return columns.mapInArrow(run, "cell int, tx int, ty int, content binary")


def header(data: bytes) -> tuple:
    """(cell, tx, ty, width, height, pooled, scale, least, most, start, bytes of the payload, nodata) of a tile's first HEADER_BYTES bytes."""
    magic, start, _, _, west, north, cell, width, height, scale, nodata, _, flags, size, least, most = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a terrain tile")
    return cell, west // (cell * width), (ANCHOR_NORTH - north) // (cell * height), width, height, bool(flags & 1), scale, least, most, start, size, nodata


def decoded(data: bytes) -> np.ndarray:
    """A tile's stored units as doubles, nodata nan."""
    _, _, _, width, height, _, _, _, _, start, size, nodata = header(data)
    delta = np.frombuffer(zlib.decompress(data[start : start + size]), "<i2").reshape(height, width)
    q = np.cumsum(delta, axis=1, dtype=np.int16)
    return np.where(q == nodata, np.nan, q.astype(float))


def decode_tiles(files: DataFrame, header_only: bool = False) -> DataFrame:
    """Tiles of a column content; v in stored units, nodata null. With header_only v is null and only the header is looked at.

    `sinks.tile_headers` reads no more than the headers from files.
    """
    kinds = [pa.int32()] * 5 + [pa.bool_()] + [pa.int32()] * 3
    names = ["cell", "tx", "ty", "width", "height", "pooled", "scale", "least", "most", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                data = data.as_py()
                v = pa.nulls(1, pa.list_(pa.int32())) if header_only else listed([decoded(data)], pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(header(data)[:9], kinds, strict=True)), v], names)

    content = F.substring("content", 1, HEADER_BYTES).alias("content") if header_only else F.col("content")
    return files.select(content).mapInArrow(run, TILE_SCHEMA)


def tile_index(tiles: DataFrame) -> DataFrame:
    """One row for each cell size: a map of tile to (bytes, least, most), in metres, outward to the decimetre."""
    entry = F.struct(F.concat_ws("_", "tx", "ty").alias("tile"), F.struct("bytes", (F.floor(F.col("least") / F.col("scale") * 10) / 10).alias("least_m"), (F.ceil(F.col("most") / F.col("scale") * 10) / 10).alias("most_m")).alias("of"))
    return tiles.groupBy("cell").agg(F.map_from_entries(F.collect_list(entry)).alias("tiles"))
