"""Data sources that read parts of binary files: internal tiles of large GeoTIFFs, headers of terrain tiles; and one that writes such tiles.

Files are opened through pyarrow's file systems, so a path may be a folder that all executors see or an address of shared storage.
"""

from __future__ import annotations

import operator
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from terravane.operators import raster

_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def located(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if ":/" in path else (files.LocalFileSystem(), path)


class Bounds:
    """Comparisons of whole-number columns with constants that a source answers itself."""

    def __init__(self, columns: tuple[str, ...]) -> None:
        self.columns, self.kept = columns, []

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the filters it can answer; gives back the others."""
        for f in filters:
            if (type(f) in _COMPARE or isinstance(f, In)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.kept.append((f.attribute[0], type(f), tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def hold(self, row: dict) -> bool:
        return all(row[c] in v if kind is In else _COMPARE[kind](row[c], v) for c, kind, v in self.kept)


# Fixed values of the format: sizes and letters of field types, tags.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d"), 16: (8, "Q")}
_WIDTH, _HEIGHT, _BITS, _PACKED, _STRIPS, _STRIP_ROWS, _STRIP_BYTES, _PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _FORMAT, _SCALE, _CORNER, _NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113


@dataclass
class Layout:
    """What a GeoTIFF's directory says: byte order, size, cell, corner, nodata, the internal tiles' size, places and bytes."""

    order: str
    width: int
    height: int
    cell: float
    west: float
    north: float
    nodata: float
    packed: int
    w: int
    h: int
    starts: tuple[int, ...]
    sizes: tuple[int, ...]


def layout(source) -> Layout:
    """The layout of an open file, plain or with 64-bit offsets; only the directory and the values it points to are read."""

    def at(place: int, n: int) -> bytes:
        source.seek(place)
        return source.read(n)

    head = at(0, 16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack_from(order + "H", head, 2)[0] == 43
    (place,) = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)
    count, entry, inline = ("Q", "HHQ", 8) if big else ("H", "HHI", 4)
    (n,) = struct.unpack(order + count, at(place, struct.calcsize(order + count)))
    size = struct.calcsize(order + entry)
    table = at(place + struct.calcsize(order + count), n * (size + inline))
    tags = {}
    for k in range(n):
        tag, kind, m = struct.unpack_from(order + entry, table, k * (size + inline))
        if kind in _TYPES:
            width, letter = _TYPES[kind]
            value = table[k * (size + inline) + size :][:inline]
            if m * width > inline:
                value = at(struct.unpack(order + ("Q" if big else "I"), value)[0], m * width)
            tags[tag] = value[:m].rstrip(b"\0").decode() if kind == 2 else struct.unpack_from(f"{order}{m}{letter}", value)
    packed = tags.get(_PACKED, (1,))[0]
    if tags[_BITS][0] != 32 or tags.get(_FORMAT, (1,))[0] != 3 or packed not in (1, 8, 32946) or tags.get(_PREDICTOR, (1,))[0] != 1:
        raise ValueError("only 32-bit floats, plain or deflated, without predictor")
    if tags[_SCALE][0] != tags[_SCALE][1]:
        raise ValueError("cells aren't square")
    width, height = tags[_WIDTH][0], tags[_HEIGHT][0]
    tiled = _TILES in tags
    w, h = (tags[_TILE_WIDTH][0], tags[_TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(_STRIP_ROWS, (height,))[0]))
    starts, sizes = tags[_TILES if tiled else _STRIPS], tags[_TILE_BYTES if tiled else _STRIP_BYTES]
    corner = tags[_CORNER]
    return Layout(order, width, height, tags[_SCALE][0], corner[3], corner[4], float(tags.get(_NODATA, "-9999")), packed, w, h, starts, sizes)


@dataclass
class _Run(InputPartition):
    path: str
    numbers: tuple[int, ...]


class _TiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes = options["path"], int(options.get("bytesPerPartition", 64 << 20))
        self.bounds = Bounds(("row0", "row1", "col0", "col1"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        return self.bounds.take(filters)

    def _place(self, of: Layout, k: int) -> dict:
        across = -(-of.width // of.w)
        row, col = k // across * of.h, k % across * of.w
        return {"row0": row, "row1": min(row + of.h, of.height) - 1, "col0": col, "col1": min(col + of.w, of.width) - 1}

    def partitions(self) -> list[InputPartition]:
        system, path = located(self.path)
        found = system.get_file_info(files.FileSelector(path, recursive=True)) if system.get_file_info(path).type == files.FileType.Directory else [system.get_file_info(path)]
        out = []
        for info in sorted((f for f in found if f.type == files.FileType.File), key=lambda f: f.path):
            with system.open_input_file(info.path) as source:
                of = layout(source)
            wanted = [k for k in range(len(of.starts)) if self.bounds.hold(self._place(of, k))]
            step = max(1, self.bytes // (of.w * of.h * 4))
            out += [_Run(info.path, tuple(wanted[i : i + step])) for i in range(0, len(wanted), step)]
        return out or [_Run("", ())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.numbers:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.path) as source:
            of = layout(source)
            for k in partition.numbers:
                place = self._place(of, k)
                source.seek(of.starts[k])
                data = source.read(of.sizes[k])
                block = np.frombuffer(data if of.packed == 1 else zlib.decompress(data), of.order + "f4").reshape(-1, of.w)
                block = block[: place["row1"] - place["row0"] + 1, : place["col1"] - place["col0"] + 1].astype(np.float64)
                v = raster.listed([np.where(block == of.nodata, np.nan, block)], pa.float32())
                longs = [pa.array([place[c]], pa.int64()) for c in ("row0", "row1", "col0", "col1")]
                doubles = [pa.array([x], pa.float64()) for x in (of.cell, of.west, of.north)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), *longs, *doubles, v], ["path", "row0", "row1", "col0", "col1", "cell", "west", "north", "v"])


class Tiff(DataSource):
    """Option path: a GeoTIFF or a folder of them; bytesPerPartition: decoded bytes of a task's internal tiles."""

    @classmethod
    def name(cls) -> str:
        return "tiff_blocks"

    def schema(self) -> str:
        return "path string, row0 long, row1 long, col0 long, col1 long, cell double, west double, north double, v array<float>"

    def reader(self, schema) -> _TiffReader:
        return _TiffReader(self.options)


def _source(spark: SparkSession, kind: type[DataSource], **options: object) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(**{k: str(v) for k, v in options.items()}).load()


def tiff_blocks(spark: SparkSession, path: str, bytes_per_partition: int = 64 << 20) -> DataFrame:
    """(path, row0, row1, col0, col1, cell, west, north, v): a row for each internal tile or strip of the GeoTIFFs at path; nodata is null.

    Only directories are read while planning. Comparisons of the first and last rows and columns with constants reach the source: tiles
    outside are neither read nor decoded. v holds a tile's rows from the north, cut at the raster's end.
    """
    return _source(spark, Tiff, path=path, bytesPerPartition=bytes_per_partition)


def tiff_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], low: float = -500.0, high: float = 2000.0) -> DataFrame:
    """(path, row, col, v) of a window, its bounds inside; values outside (low, high) are null."""
    met = tiff_blocks(spark, path).where((F.col("row1") >= rows[0]) & (F.col("row0") <= rows[1]) & (F.col("col1") >= cols[0]) & (F.col("col0") <= cols[1]))
    wide = F.col("col1") - F.col("col0") + 1
    cells = met.select("path", "row0", "col0", wide.alias("w"), F.posexplode("v").alias("k", "x"))
    found = cells.select("path", (F.col("row0") + F.floor(F.col("k") / F.col("w"))).alias("row"), (F.col("col0") + F.col("k") % F.col("w")).alias("col"), F.when((F.col("x") > low) & (F.col("x") < high), F.col("x")).alias("v"))
    return found.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def tile_path(cell: int, tx: int, ty: int) -> str:
    return f"{cell}/{tx}_{ty}.azt"


@dataclass
class _Written(WriterCommitMessage):
    moves: tuple[tuple[str, str], ...]


class _TileWriter(DataSourceArrowWriter):
    """Each task writes its tiles under names of their own; they get their places when all tasks are done, or go when one failed.

    A task that is killed while it writes, after the others were told to stop, may leave a file in the job's own folder.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = located(self.path)
        moves = []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    final = f"{root}/{tile_path(row['cell'], row['tx'], row['ty'])}"
                    if system.get_file_info(final).type == files.FileType.NotFound:
                        # A name for each attempt: a task that runs twice never writes where the other one does.
                        own = f"{root}/_writing-{self.job}/{uuid.uuid4().hex}"
                        system.create_dir(own.rpartition("/")[0], recursive=True)
                        moves.append((own, final))
                        with system.open_output_stream(own) as out:
                            out.write(row["content"])
        except BaseException:
            for own, _ in moves:
                if system.get_file_info(own).type != files.FileType.NotFound:
                    system.delete_file(own)
            raise
        return _Written(tuple(moves))

    def _end(self) -> None:
        system, root = located(self.path)
        if system.get_file_info(f"{root}/_writing-{self.job}").type != files.FileType.NotFound:
            system.delete_dir(f"{root}/_writing-{self.job}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = located(self.path)
        for own, final in (m for message in messages if message for m in message.moves):
            if system.get_file_info(final).type == files.FileType.NotFound:
                system.create_dir(final.rpartition("/")[0], recursive=True)
                system.move(own, final)
        self._end()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._end()


@dataclass
class _Some(InputPartition):
    paths: tuple[str, ...]


class _TileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.whole, self.files = options["path"], options.get("content", "false") == "true", int(options.get("filesPerPartition", 512))
        self.bounds = Bounds(("cell", "tx", "ty"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        return self.bounds.take(filters)

    def partitions(self) -> list[InputPartition]:
        system, root = located(self.path)
        wanted = []
        for info in system.get_file_info(files.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = info.path.rsplit("/", 2)
            if info.type == files.FileType.File and parts[-1].endswith(".azt") and parts[-2].isdigit():
                tx, ty = map(int, parts[-1][:-4].split("_"))
                if self.bounds.hold({"cell": int(parts[-2]), "tx": tx, "ty": ty}):
                    wanted.append(info.path)
        wanted.sort()
        return [_Some(tuple(wanted[i : i + self.files])) for i in range(0, len(wanted), self.files)] or [_Some(())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = located(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as source:
                size = source.size()
                data = source.read(size if self.whole else raster.HEADER_BYTES)
            yield (*raster.header(data)[:9], size, data if self.whole else None)


class Tiles(DataSource):
    """Options path; content: whether contents are read, not only headers; filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "terrain_tiles"

    def schema(self) -> str:
        return "cell int, tx int, ty int, width int, height int, pooled boolean, scale int, least int, most int, bytes long, content binary"

    def reader(self, schema) -> _TileReader:
        return _TileReader(self.options)

    def writer(self, schema, overwrite: bool) -> _TileWriter:
        if overwrite:
            raise ValueError("tiles are only added: append")
        return _TileWriter(self.options)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Encoded tiles (cell, tx, ty, content) as files cell/tx_ty.azt; those that are there stay as they are, a failed run leaves none."""
    tiles.sparkSession.dataSource.register(Tiles)
    tiles.select(F.col("cell").cast("int"), F.col("tx").cast("int"), F.col("ty").cast("int"), "content").write.format(Tiles.name()).mode("append").option("path", path).save()


def tile_headers(spark: SparkSession, path: str) -> DataFrame:
    """(cell, tx, ty, width, height, pooled, scale, least, most, bytes) of the tile files at path: an index as rows, from 36 bytes of each file.

    Comparisons of cell, tx and ty with constants reach the source by the files' names.
    """
    return _source(spark, Tiles, path=path).drop("content")


def tile_contents(spark: SparkSession, path: str) -> DataFrame:
    """tile_headers with content, for raster.decode_tiles."""
    return _source(spark, Tiles, path=path, content="true")
