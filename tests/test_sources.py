"""Sources over small made-up files."""

from __future__ import annotations

import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import raster
from terravane.sources import binary, registers, sinks


def blob(x, y, z=None, code=0):
    kind = 1 if z is None else 1001
    return b"GP\0" + bytes([1 | code << 1]) + b"\0" * 4 + b"\0" * binary.ENVELOPES[code] + b"\1" + struct.pack("<I2d", kind, x, y) + (b"" if z is None else struct.pack("<d", z))


def test_points():
    assert binary.point(blob(1.0, 2.0, 3.0, 1)) == (1.0, 2.0, 3.0)
    assert binary.point(blob(1.0, 2.0, -999.999)) == (1.0, 2.0, None)
    assert binary.point(b"XX") is None and binary.point(None) is None


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE masto (id INTEGER PRIMARY KEY, sijainti_piste BLOB, mtk_id INT, sijaintitarkkuus INT)")
        db.execute("CREATE TABLE mastonkorkeus (id INTEGER PRIMARY KEY, mastoviittaus TEXT, korkeusarvo INT)")
        db.executemany("INSERT INTO masto VALUES (?, ?, ?, ?)", [(1, blob(1, 2, 3), -5, 0), (2, blob(4, 5), 7, 1500), (3, b"no", 8, 1)])
        db.executemany("INSERT INTO mastonkorkeus VALUES (?, ?, ?)", [(1, str(2**32 - 5), 1000), (2, str(2**32 - 5), 2000)])
    df = binary.topographic(spark, path, {"masto": "mast"}, {"mast": ("mastonkorkeus", "mastoviittaus")})
    got = {r["mtk_id"]: (r["height_m"], r["acc_m"], r["x"], r["ground_m"]) for r in df.collect()}
    assert got[-5] == (2.0, None, 1.0, 3.0) and got[7][:3] == (None, 1.5, 4.0) and set(got) == {-5, 7}
    assert binary.geopackage(spark, path, "masto", rows=2).rdd.getNumPartitions() == 2


def test_obstacles(spark, tmp_path):
    path = tmp_path / "o.csv"
    head = "TYPE;LAT;LONG;HGT AGL (FT);ELEV MSL (FT);Horizontal accuracy (m);OBST ID"
    path.write_text("﻿" + head + "\nMast;60.1;25.2;100;150;NIL; A1 \nCrane;60;25;1;1;5;x\nTower;60;25;;1;5;y\n", encoding="utf-8")
    rows = registers.obstacles(spark, str(path)).collect()
    assert [(r["cat"], r["height_m"], r["ground_m"], r["acc_m"], r["obst_id"]) for r in rows] == [("mast", 30.5, 15.2, None, "A1")]


def test_structures(spark, tmp_path):
    el = [
        {"lat": 60.0, "lon": 25.0, "tags": {"man_made": "tower", "tower:type": "lighting"}},
        {"center": {"lat": 60.0, "lon": 25.0}, "tags": {"generator:source": "wind", "height:hub": "100"}},
        {"lat": 60.0, "lon": 25.0, "tags": {"man_made": "tower", "tower:type": "communication", "height": "61.0;61", "name": "x"}},
        {"lat": 60.0, "lon": 25.0, "tags": {"building": "yes", "building:levels": "9"}},
        {"tags": {"man_made": "mast"}},
    ]
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"osm3s": {"timestamp_osm_base": "2020-01-01T00:00:00Z"}, "elements": el}))
    got = sorted((r["cat"], r["height_m"], r["src_h"]) for r in registers.structures(spark, str(path)).collect())
    assert got == [("mast", 61.0, "osm"), ("turbine", 143.0, "osm")]
    assert [r["levels"] for r in registers.buildings(spark, str(path)).collect()] == [9.0]
    assert registers.snapshot_age(spark, str(path)) > 2000


def test_sea_marks(spark, tmp_path):
    rows = [
        {"id": 1, "turvalaitetyyppifi": "Merimajakka", "nimifi": " A ", "loistojen_tiedot": "Korkeus vedestä: 51, Korkeus maasta: 46\\nKorkeus maasta: 3", "_lonlat": [21.0, 60.0], "toimintatilakoodi": 1},
        {"id": 2, "turvalaitetyyppifi": "Linjamerkki", "paivatunnusten_tiedot": "Korkeus maasta (m): 24.5", "nimifi": "", "nimisv": "B", "_lonlat": [21.0, 60.1]},
        {"id": 3, "turvalaitetyyppifi": "Linjamerkki", "paivatunnusten_tiedot": "Korkeus maasta (m): 4", "_lonlat": [21.0, 60.1]},
        {"id": 4, "turvalaitetyyppifi": "Kummeli", "_lonlat": [21.0, 60.1]},
    ]
    path = tmp_path / "m.json"
    path.write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    got = {r["id"]: (r["name"], r["focal_m"], r["focal_agl_m"], r["daymark_agl_m"]) for r in registers.sea_marks(spark, str(path)).collect()}
    assert got == {1: ("A", 51.0, 46.0, None), 2: ("B", None, None, 24.5)}


def place(i, typ, pos, names):
    inner = "".join(f"<Name><spelling>{n}</spelling><language>{g}</language><languageOfficiality>{o}</languageOfficiality><languageDominance>{d}</languageDominance></Name>" for n, g, o, d in names)
    return f"<gml:featureMember><Place><placeId>{i}</placeId><placeType>{typ}</placeType>{f'<gml:pos>{pos}</gml:pos>' if pos else ''}<placeElevation>100</placeElevation><scaleRelevance>250000</scaleRelevance>{inner}</Place></gml:featureMember>"


def test_places_and_hills(spark, tmp_path):
    path = tmp_path / "p.xml"
    names = [("Nordberg", "swe", "1", "0"), ("Pohjanmäki", "fin", "1", "1")]
    path.write_text("<x>" + place(1, 1010210, "300000 6700000", names) + place(2, 999, "1 2", names) + place(3, 1010205, "", names) + place(4, 1010205, "5 6", names[:1]) + "</x>", encoding="utf-8")
    df = registers.places(spark, str(path))
    got = {r["id"]: (r["name"], r["kind"], r["x"], r["sr"]) for r in df.collect()}
    assert got == {1: ("Pohjanmäki", "mäki", 300000.0, 250000), 4: ("Nordberg", "berg", 5.0, 250000)}
    summits = spark.createDataFrame([(1, 120.04, 110.0, 1.0, 2.0, 30.0, False, True, None)], "id long, top double, pt double, x double, y double, d double, open boolean, wide boolean, claimed long")
    out = {r["id"]: r for r in registers.hills(registers.selected(df, summits), summits).collect()}
    assert (out[1]["top_m"], out[1]["src_top"], out[1]["gain_m"], out[1]["x"]) == (120.0, "dem10", 10.0, 1.0)
    assert (out[1]["cat"], out[1]["wide"], out[1]["name_lat"] is not None) == ("hill", True, True)
    assert (out[4]["top_m"], out[4]["src_top"], out[4]["cat"], out[4]["name_lat"]) == (100.0, "nimisto", "hillgroup", None)
    assert [r["id"] for r in registers.hills(registers.selected(df, summits), summits, least_top=110.0).collect()] == [1]


def tiff(v, packed):
    h, w = v.shape
    body = zlib.compress(v.astype("<f4").tobytes()) if packed == 8 else v.astype("<f4").tobytes()
    entries = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (32,)), (259, 3, (packed,)), (273, 4, (8,)), (278, 4, (h,)), (279, 4, (len(body),)), (339, 3, (3,)), (33550, 12, (2.0, 2.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 100.0, 200.0, 0.0)), (42113, 2, b"-9999\0")]
    at = 8 + len(body) + len(body) % 2
    extra, rows = b"", b""
    base = at + 2 + 12 * len(entries) + 4
    for tag, kind, value in entries:
        data = value if kind == 2 else struct.pack(f"<{len(value)}{'H' if kind == 3 else 'I' if kind == 4 else 'd'}", *value)
        n = len(value)
        if len(data) <= 4:
            rows += struct.pack("<HHI", tag, kind, n) + data.ljust(4, b"\0")
        else:
            rows += struct.pack("<HHII", tag, kind, n, base + len(extra))
            extra += data
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(entries)) + rows + b"\0" * 4 + extra


def test_geotiff(spark, tmp_path):
    v = np.arange(12, dtype=float).reshape(3, 4)
    v[1, 1] = -9999
    for k, packed in enumerate((1, 8)):
        (tmp_path / f"{k}.tif").write_bytes(tiff(v, packed))
    df = binary.rasters(spark, str(tmp_path / "*.tif"))
    rows = df.collect()
    assert all((r["w"], r["h"], r["px"], r["ox"], r["oy"], r["v"]) == (4, 3, 2.0, 100.0, 200.0, v.ravel().tolist()) for r in rows) and len(rows) == 2
    assert binary.cells(df).where("v IS NULL").count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0, 10.0), (2, None, 3.0)], "id long, ground_m double, height_m double")
    sinks.catalogue(rows, str(tmp_path / "c"))
    back = spark.read.json(str(tmp_path / "c/objects")).collect()
    assert [r["id"] for r in back] == [1, 2] and back[0]["top_m"] == 15.0
    assert spark.read.json(str(tmp_path / "c/header")).first()["n"] == 2


def test_extracts_are_checked(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"osm3s": {"timestamp_osm_base": "2020-01-01T00:00:00Z"}, "elements": [{"lat": 60.0, "lon": 25.0, "tags": {"man_made": "mast"}}]}))
    assert registers.structures(spark, str(path), least=1).count() == 1
    with pytest.raises(ValueError, match="at least 2"):
        registers.structures(spark, str(path), least=2)
    with pytest.raises(ValueError, match="days old"):
        registers.buildings(spark, str(path), most_days=registers.MOST_DAYS)


def test_sea_mark_features(spark, tmp_path):
    def feature(i, kind, geometry):
        return {"properties": {"id": i, "turvalaitetyyppifi": kind, "nimifi": "x"}, "geometry": geometry}

    (tmp_path / "a.json").write_text(json.dumps({"features": [feature(7, "Merimajakka", {"type": "MultiPoint", "coordinates": [[21.0, 60.0], [1.0, 2.0]]}), feature(None, "Linjamerkki", {"type": "Point", "coordinates": [22.0, 61.0]}), feature(3, "Kummeli", {"type": "Point", "coordinates": [1, 2]})]}))
    (tmp_path / "b.json").write_text(json.dumps({"features": [feature(1, "Merimajakka", {"type": "MultiPoint", "coordinates": []}), feature(2, "Merimajakka", None), feature(5, "Tutkamerkki", {"type": "Point", "coordinates": [23.0, 62.0, 4.0]})]}))
    got = registers.sea_mark_features(spark, {"b": str(tmp_path / "b.json"), "a": str(tmp_path / "a.json")}).collect()
    assert [(r["_collection"], r["id"], r["_lonlat"][:2]) for r in got] == [("a", None, [22.0, 61.0]), ("a", 7, [21.0, 60.0]), ("b", 5, [23.0, 62.0])]


def test_stored_and_extended(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "id long, v long"
    assert sinks.stored(spark, path, schema).count() == 0 and sinks.stored(spark, path, schema).columns == ["id", "v"]
    seen = []

    def double(work):
        seen.append(sorted(r["id"] for r in work.collect()))
        return work.selectExpr("id", "2 * id AS v")

    sinks.extend(spark.range(3), path, "id", double, schema)
    out = sinks.extend(spark.range(5), path, "id", double, schema)
    assert seen == [[0, 1, 2], [3, 4]] and sorted(map(tuple, out.collect())) == [(i, 2 * i) for i in range(5)]


def test_hills_sink(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 4.5)], "id long, name string, snap_m double")
    report = sinks.hills(rows, str(tmp_path / "h"), 100_000)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "h/hills")).collect()]
    assert lines == ['{"id":1,"name":"a","snap_m":4.5}', '{"id":2,"name":"b"}']
    assert report["rows"] == 2 and report["bytes"] == sum(len(x) + 1 for x in lines) and report["compressed"] > 0
    assert spark.read.json(str(tmp_path / "h/header")).first()["min_scale"] == 100_000


def test_a_run_that_breaks_off_loses_one_part(spark, tmp_path, caplog):
    schema, path = "id long, twice long", str(tmp_path / "w")

    def double(rows, broken=False):
        fails = F.when(F.col("id") == 77, F.raise_error(F.lit("broken off")).cast("long")) if broken else F.lit(None).cast("long")
        return rows.select("id", F.coalesce(fails, F.col("id") * 2).alias("twice"))

    with pytest.raises(Exception, match="broken off"):
        sinks.extend(spark.range(100), path, "id", lambda rows: double(rows, True), schema, parts=8)
    kept = {r["id"] for r in sinks.stored(spark, path, schema).collect()}
    part = spark.range(100).where(F.pmod(F.xxhash64("id"), F.lit(8)) < F.pmod(F.xxhash64(F.lit(77).cast("long")), F.lit(8)))
    assert kept == {r["id"] for r in part.collect()}
    with caplog.at_level("INFO", logger="terravane.sources.sinks"):
        out = sinks.extend(spark.range(100), path, "id", double, schema, parts=8)
    assert sorted((r["id"], r["twice"]) for r in out.collect()) == [(i, 2 * i) for i in range(100)]
    assert sum(int(m.rsplit(" ", 2)[1]) for m in (r.getMessage() for r in caplog.records)) == 100 - len(kept)


def test_blocks_and_windows(spark, tmp_path):
    cells = spark.range(4096).selectExpr("id DIV 64 AS row", "id % 64 AS col", "CASE WHEN id = 70 THEN -9999.0D ELSE CAST(id AS double) END AS v")
    path = str(tmp_path / "r")
    sinks.blocks(cells, path, 16)
    window = sinks.window(spark, path, (1, 2), (5, 20), 16)
    got = {(r["row"], r["col"]): r["v"] for r in window.collect()}
    assert got == {(r, c): None if r * 64 + c == 70 else float(r * 64 + c) for r in (1, 2) for c in range(5, 21)}
    plan = window._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "brow" in filters and "bcol" in filters


def test_tile_files_and_index(spark, tmp_path):
    rows = [(10, 3, 4, 2, 2, False, [1.0, 2.0, 3.0, None]), (20, 0, 0, 2, 2, False, [9.06, 0.0, 0.0, 0.0])]
    files = raster.encode_tiles(spark.createDataFrame(rows, "cell int, tx int, ty int, width int, height int, pooled boolean, v array<double>"))
    path = str(tmp_path / "t")
    sinks.tile_files(files, path)
    sinks.tile_files(files, path)
    held = spark.read.parquet(path)
    assert held.count() == 2
    headers = raster.decode_tiles(held, header_only=True).join(held.select("cell", "tx", "ty", F.octet_length("content").alias("bytes")), ["cell", "tx", "ty"])
    sinks.write_index(raster.tile_index(headers), str(tmp_path / "i"))
    got = {(r["cell"], r["tx"], r["ty"]): (r["least_m"], r["most_m"]) for r in sinks.read_index(spark, str(tmp_path / "i")).collect()}
    assert got == {(10, 3, 4): (1.0, 3.0), (20, 0, 0): (0.0, 9.0)}
    (tmp_path / "page.html").write_text("<html>not here</html>")
    with pytest.raises(ValueError, match="not a tile index"):
        sinks.read_index(spark, str(tmp_path / "page.html"))


def tiled_tiff(v, tile):
    """A big-endian GeoTIFF of deflated tiles; edge tiles are padded."""
    h, w = v.shape
    across, down = -(-w // tile), -(-h // tile)
    padded = np.zeros((down * tile, across * tile))
    padded[:h, :w] = v
    parts = [zlib.compress(padded[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].astype(">f4").tobytes()) for i in range(down) for j in range(across)]
    offsets, at = [], 8
    for p in parts:
        offsets.append(at)
        at += len(p)
    at += at % 2
    entries = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (32,)), (259, 3, (8,)), (322, 3, (tile,)), (323, 3, (tile,)), (324, 4, tuple(offsets)), (325, 4, tuple(map(len, parts))), (339, 3, (3,)), (33550, 12, (10.0, 10.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 5.0, 6.0, 0.0))]
    base, rows, extra = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, value in entries:
        data = struct.pack(f">{len(value)}{'H' if kind == 3 else 'I' if kind == 4 else 'd'}", *value)
        if len(data) <= 4:
            rows += struct.pack(">HHI", tag, kind, len(value)) + data.ljust(4, b"\0")
        else:
            rows += struct.pack(">HHII", tag, kind, len(value), base + len(extra))
            extra += data
    body = b"".join(parts)
    return b"MM\0*" + struct.pack(">I", at) + body + b"\0" * (at - 8 - len(body)) + struct.pack(">H", len(entries)) + rows + b"\0" * 4 + extra


def test_tiled_big_endian_geotiff():
    v = np.arange(5 * 7, dtype=float).reshape(5, 7)
    got = binary.geotiff(tiled_tiff(v, 4))
    assert (got["w"], got["h"], got["px"], got["ox"], got["oy"], got["nodata"]) == (7, 5, 10.0, 5.0, 6.0, -9999.0)
    assert got["v"].tolist() == v.ravel().tolist()
