"""Binary sources: point tables of a GeoPackage, float GeoTIFFs, point blobs."""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The point tables by category, and the heights' tables with the column that names the point.
POINT_TABLES = {"masto": "mast", "savupiippu": "chimney", "tuulivoimala": "turbine", "vesitorni": "watertower", "nakotorni": "obstower", "kellotapuli": "belltower"}
HEIGHT_TABLES = {"mast": ("mastonkorkeus", "mastoviittaus"), "chimney": ("savupiipunkorkeus", "savupiippuviittaus")}
# Envelope bytes of a GeoPackage point by code, point types, the height that means none.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
POINTS, WITH_Z, NO_Z = (1, 1001, 2001, 3001), (1001, 3001), -999.999


def point(blob: bytes | None) -> tuple[float, float, float | None] | None:
    """x, y and z of a GeoPackage point; null for anything else."""
    if not blob or blob[:2] != b"GP":
        return None
    at = 8 + ENVELOPES[blob[3] >> 1 & 7]
    order = "<" if blob[at] else ">"
    (kind,) = struct.unpack_from(order + "I", blob, at + 1)
    if kind not in POINTS:
        return None
    x, y = struct.unpack_from(order + "2d", blob, at + 5)
    z = struct.unpack_from(order + "d", blob, at + 21)[0] if kind in WITH_Z and len(blob) >= at + 29 else None
    return x, y, None if z == NO_Z else z


def with_points(df: DataFrame, blob: str) -> DataFrame:
    """df with x, y and z in place of a point blob; rows without a point have nulls."""
    kept = [c for c in df.columns if c not in (blob, "x", "y", "z")]
    schema = df.select(*kept, *(F.lit(None).cast("double").alias(c) for c in "xyz")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([point(x) or (None, None, None) for x in b[blob]], columns=list("xyz"), index=b.index, dtype=float)
            yield pd.concat([b[kept], found], axis=1)

    return df.select(*kept, blob).mapInPandas(run, schema)


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class GeoPackage(DataSource):
    """spark.read.format("gpkg").option("path", ...).option("table", ...).schema(...).load(): a table, by ranges of rowid.

    Only the columns of the schema are read. The file lies at its path on every executor.
    """

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        kinds = {"INT": "bigint", "MEDIUMINT": "bigint", "INTEGER": "bigint", "REAL": "double", "DOUBLE": "double", "TEXT": "string"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        return ", ".join(f"`{n}` {kinds.get(t.upper().split('(')[0], 'binary')}" for n, t in columns)

    def reader(self, schema) -> DataSourceReader:
        return GeoPackageReader(self.options, schema)


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.table = options["path"], options["table"].replace('"', '""')
        self.rows, self.columns = int(options.get("rowsperpartition", 1_000_000)), schema.names

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [_Range(a, a + self.rows) for a in range(low, high + 1, self.rows)] if low is not None else [_Range(0, 0)]

    def read(self, part: _Range):
        columns = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        with self._open() as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (part.low, part.high))


def geopackage(spark: SparkSession, path: str, table: str, rows: int = 1_000_000) -> DataFrame:
    spark.dataSource.register(GeoPackage)
    return spark.read.format("gpkg").option("path", path).option("table", table).option("rowsPerPartition", str(rows)).load()


def topographic(spark: SparkSession, path: str, points: dict[str, str] = POINT_TABLES, heights: dict[str, tuple[str, str]] = HEIGHT_TABLES) -> DataFrame:
    """Point tables (name to category) of a GeoPackage with the heights (category to table and key column) by signed id.

    Millimetres become metres; an accuracy of zero is unknown; of several heights of an id the last counts.
    """
    from terravane.functions.text import wrap32
    from terravane.operators.fuse import last_by

    found = None
    for table, cat in points.items():
        rows = with_points(geopackage(spark, path, table).select("sijainti_piste", "mtk_id", "sijaintitarkkuus"), "sijainti_piste").where("x IS NOT NULL")
        rows = rows.select(F.lit(cat).alias("cat"), "mtk_id", (F.nullif("sijaintitarkkuus", F.lit(0)) / 1000.0).alias("acc_m"), "x", "y", F.col("z").alias("ground_m"))
        if cat in heights:
            name, key = heights[cat]
            values = geopackage(spark, path, name).select(wrap32(F.col(key).cast("long")).alias("mtk_id"), (F.col("korkeusarvo") / 1000.0).alias("height_m"), F.monotonically_increasing_id().alias("seq"))
            rows = rows.join(last_by(values, "mtk_id", "height_m", "seq"), "mtk_id", "left")
        else:
            rows = rows.withColumn("height_m", F.lit(None).cast("double"))
        found = rows if found is None else found.unionByName(rows)
    return found


_TYPES = {2: "s", 3: "H", 4: "I", 12: "d"}
_SIZES = {2: 1, 3: 2, 4: 4, 12: 8}


def geotiff(data: bytes) -> dict:
    """Size, cell, corner, nodata and float32 values (rows from the north) of an uncompressed or deflated GeoTIFF."""
    order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
    (at,) = struct.unpack_from(order + "I", data, 4)
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in _TYPES:
            continue
        place = at + 10 + 12 * k
        if n * _SIZES[kind] > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = bytes(data[place : place + n]).rstrip(b"\0").decode() if kind == 2 else struct.unpack_from(f"{order}{n}{_TYPES[kind]}", data, place)
    width, height, packed = tags[256][0], tags[257][0], tags.get(259, (1,))[0]
    if tags[258][0] != 32 or tags.get(339, (1,))[0] != 3 or packed not in (1, 8, 32946):
        raise ValueError("only 32-bit floats, plain or deflated")
    cell = tags[33550]
    if cell[0] != cell[1]:
        raise ValueError("cells aren't square")
    tiled = 324 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, tags.get(278, (height,))[0])
    across = -(-width // w)
    out = np.zeros((-(-height // h) * h, across * w), np.float32)
    for k, (start, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        part = data[start : start + size]
        block = np.frombuffer(part if packed == 1 else zlib.decompress(part), order + "f4").reshape(-1, w)
        row, col = k // across * h, k % across * w
        out[row : row + len(block), col : col + w] = block
    corner = tags[33922]
    return {"w": width, "h": height, "px": cell[0], "ox": corner[3], "oy": corner[4], "nodata": float(tags.get(42113, "-9999")), "v": out[:height, :width].ravel()}


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, w, h, px, ox, oy, nodata, v) for each GeoTIFF file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([{"path": where, **geotiff(content)}])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, w int, h int, px double, ox double, oy double, nodata double, v array<float>")


def cells(tiles: DataFrame, low: float = -500.0, high: float = 2000.0) -> DataFrame:
    """Tiles in long form (tile, row, col, v); nodata and values outside (low, high) are null."""
    rows = tiles.select(F.col("path").alias("tile"), "w", "nodata", F.posexplode("v").alias("k", "x"))
    live = (F.col("x") > low) & (F.col("x") < high) & (F.col("x") != F.col("nodata"))
    return rows.select("tile", F.floor(F.col("k") / F.col("w")).alias("row"), (F.col("k") % F.col("w")).alias("col"), F.when(live, F.col("x")).alias("v"))
