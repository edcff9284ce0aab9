"""The skyline around observers: rays over tiles of several cell sizes, sampled ever more coarsely with distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import raster, skyline
from terravane.operators.raster import ANCHOR_NORTH, RINGS
from terravane.operators.skyline import BANDS, BINS
from terravane.session import checkpointed

#: Tiles of a sweep: cell, tx, ty, width, height, scale, least and most in stored units, v (array, nodata null).


def bearings(observers: DataFrame, reach: float, bins: int = BINS) -> DataFrame:
    """(id, bin, e0, n0, ue, un): for each observer (id, lat, lon) the grid position and the direction of every bin's ray.

    A ray is straight in the grid, from the observer to the end of the geodesic that leaves at its bearing.
    """
    rays = observers.select("id", "lat", "lon").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    # Stored, so that the geodesic and the projection of its end are expressions of their own: as one they are too long to compile.
    rays = checkpointed(rays.withColumn("end", geo.direct(F.col("lat"), F.col("lon"), F.col("bin") * F.lit(360.0 / bins), F.lit(float(reach)))))
    e0, n0 = geo.to_grid(F.col("lat"), F.col("lon"))
    e1, n1 = geo.to_grid(F.col("end.lat"), F.col("end.lon"))
    return rays.select("id", "bin", e0.alias("e0"), n0.alias("n0"), ((e1 - e0) / reach).alias("ue"), ((n1 - n0) / reach).alias("un"))


def _tile(e: Column, n: Column, cell: Column, edge: Column) -> tuple[Column, Column]:
    step = cell * edge
    return F.floor(e / step), F.floor((ANCHOR_NORTH - n) / step)


def observer_ground(observers: DataFrame, tiles: DataFrame, rings=RINGS) -> DataFrame:
    """(id, ground): of observers (id, e, n) the value of the cell they stand in, from the finest tile there is; nodata is the sea's zero.

    Null where no tile covers the observer.
    """
    sizes = F.array(*(F.struct(F.lit(cell).alias("cell"), F.lit(edge).alias("edge")) for _, cell, edge in rings))
    rows = observers.select("id", "e", "n", F.explode(sizes).alias("s"))
    tx, ty = _tile(F.col("e"), F.col("n"), F.col("s.cell"), F.col("s.edge"))
    met = rows.select("id", "e", "n", F.col("s.cell").alias("cell"), tx.alias("tx"), ty.alias("ty"), F.col("s.edge").alias("edge")).join(tiles, ["cell", "tx", "ty"])
    row, col = F.floor((ANCHOR_NORTH - F.col("n")) / F.col("cell")) - F.col("ty") * F.col("edge"), F.floor(F.col("e") / F.col("cell")) - F.col("tx") * F.col("edge")
    value = F.coalesce(F.get("v", (row * F.col("width") + col).cast("int")) / F.col("scale"), F.lit(0.0))
    return observers.select("id").join(met.groupBy("id").agg(F.min_by(value, "cell").alias("ground")), "id", "left")


def eyes(observers: DataFrame, tiles: DataFrame, rings=RINGS) -> DataFrame:
    """observers (id, e, n, eye, override) with ground and hobs, the height of the eye: an override counts before the tiles' ground.

    Observers without either are left out.
    """
    found = observers.join(observer_ground(observers, tiles, rings), "id")
    stands = F.coalesce("override", "ground")
    return found.withColumn("hobs", stands + F.col("eye")).where("hobs IS NOT NULL")


def tiles_to_read(seen: DataFrame, index: DataFrame, rings=RINGS) -> DataFrame:
    """(id, cell, tx, ty, skipped): the tiles of the index (cell, tx, ty, most_m) in each observer's rings; skipped if too low to be seen.

    seen: (id, e, n, hobs). Within SKIP_FROM_M no tile is skipped.
    """
    cover = raster.tile_cover(seen.select("id", "e", "n"), rings)
    step = F.coalesce(*(F.when(F.col("cell") == cell, F.lit(cell * edge)) for _, cell, edge in rings))
    met = cover.join(index.select("cell", "tx", "ty", "most_m"), ["cell", "tx", "ty"]).join(seen.select("id", "e", "n", "hobs"), "id")
    dx = F.greatest(F.abs(F.col("tx") * step - F.col("e")), F.abs((F.col("tx") + 1) * step - F.col("e")))
    down = ANCHOR_NORTH - F.col("n")
    dy = F.greatest(F.abs(F.col("ty") * step - down), F.abs((F.col("ty") + 1) * step - down))
    far = F.sqrt(dx * dx + dy * dy)
    near = F.greatest(F.col("nearest"), F.lit(1e-9))
    return met.select("id", "cell", "tx", "ty", (~skyline.can_hide(F.col("most_m"), F.col("hobs"), near, far)).alias("skipped"))


def samples(rays: DataFrame, bands=BANDS, rings=RINGS) -> DataFrame:
    """(id, bin, hobs, d, e, n, cell, edge): the points of each ray (id, bin, hobs, e0, n0, ue, un), and the cell size of the ring they lie in."""
    rows = rays.withColumn("d", F.explode(skyline.distances(bands, rings[-1][0])))
    ring = lambda at: F.coalesce(*(F.when(F.col("d") <= r[0], F.lit(r[at])) for r in rings))
    return rows.select("id", "bin", "hobs", "d", (F.col("e0") + F.col("ue") * F.col("d")).alias("e"), (F.col("n0") + F.col("un") * F.col("d")).alias("n"), ring(1).alias("cell"), ring(2).alias("edge"))


def crossings(rays: DataFrame, cover: DataFrame, ring: tuple[int, int, int], inner: float) -> DataFrame:
    """rays (id, bin, hobs, e0, n0, ue, un) with a row for each tile of the cover (id, cell, tx, ty, ...) of a ring that they may cross, from near to far.

    By the circle around a tile, so a little more than what they do cross.
    """
    outer, cell, edge = ring
    step, half = cell * edge, cell * edge * 0.7072
    east, down = (F.col("tx") + 0.5) * step - F.col("e0"), ANCHOR_NORTH - (F.col("ty") + 0.5) * step - F.col("n0")
    size = F.sqrt(F.col("ue") * F.col("ue") + F.col("un") * F.col("un"))
    aside, along = F.abs(east * F.col("un") - down * F.col("ue")) / size, (east * F.col("ue") + down * F.col("un")) / size
    reach = half * 1.001 + 1.0
    met = rays.join(cover.where(F.col("cell") == cell), "id").where(aside <= reach)
    met = met.withColumn("near", F.greatest(F.lit(float(inner)), (along - reach) / size)).withColumn("far", F.least(F.lit(float(outer)), (along + reach) / size))
    return met.where("near <= far")


#: Rays and samples that a kernel works on at once; observers of a tile that a task takes.
SAMPLES_AT_ONCE, OBSERVERS_A_TASK = 2_000_000, 64


def _tile_heights(v: np.ndarray, scale: float, fx: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """Between the centres of the four cells around, if all are known, else of the cell itself, else the sea. At the edge the cells beyond count as those at it."""
    height, width = v.shape
    ix, iy = (np.maximum(0, np.minimum(np.floor(f), n - 2)).astype(np.int64) for f, n in ((fx, width), (fy, height)))
    gx, gy = np.clip(fx - ix, 0.0, 1.0), np.clip(fy - iy, 0.0, 1.0)
    a00, a01, a10, a11 = v[iy, ix], v[iy, ix + 1], v[iy + 1, ix], v[iy + 1, ix + 1]
    top, low = a00 + (a01 - a00) * gx, a10 + (a11 - a10) * gx
    between = top + (low - top) * gy
    own = v[np.clip(np.floor(fy + 0.5).astype(np.int64), 0, height - 1), np.clip(np.floor(fx + 0.5).astype(np.int64), 0, width - 1)]
    h = np.where(np.isnan(between), own, between) / scale
    return np.where(np.isnan(h), 0.0, h)


def _swept(distances: np.ndarray, edge: int):
    """What gives the partial staircases (id, bin, d, t) of the rays through one tile."""
    radius2 = 2 * geo.effective_radius()
    schema = pa.schema([("id", pa.int64()), ("bin", pa.int32()), ("d", pa.float64()), ("t", pa.float64())])

    def run(key: tuple, rays: pa.Table, tile: pa.Table) -> pa.Table:
        cell, tx, ty = (k.as_py() for k in key[:3])
        step = cell * edge
        c = {n: rays.column(n).to_numpy() for n in ("id", "bin", "hobs", "e0", "n0", "ue", "un", "near", "far", "reads", "above")}
        v = raster.numbers(tile.column("v")[0].values).reshape(tile.column("height")[0].as_py(), tile.column("width")[0].as_py()) if tile.num_rows else None
        scale = tile.column("scale")[0].as_py() if tile.num_rows else 1
        first, last = np.searchsorted(distances, c["near"], "left"), np.searchsorted(distances, c["far"], "right")
        most, made = int((last - first).max(initial=0)), []
        for i in range(0, rays.num_rows if most else 0, max(1, SAMPLES_AT_ONCE // max(1, most))):
            part = slice(i, i + max(1, SAMPLES_AT_ONCE // most))
            of = {n: x[part, None] for n, x in c.items()}
            at = first[part, None] + np.arange(most)
            d = distances[np.minimum(at, len(distances) - 1)]
            e, n = of["e0"] + of["ue"] * d, of["n0"] + of["un"] * d
            # A sample belongs to the tile that its own place says.
            inside = (at < last[part, None]) & (np.floor(e / step) == tx) & (np.floor((ANCHOR_NORTH - n) / step) == ty)
            h = np.zeros_like(d)
            known = inside & of["reads"]
            if v is not None and known.any():
                h[known] = _tile_heights(v, scale, (e[known] - tx * step) / cell - 0.5, (ANCHOR_NORTH - ty * step - n[known]) / cell - 0.5)
            t = np.where(inside, (h - of["hobs"] - d * d / radius2) / d, -np.inf)
            before = np.maximum.accumulate(np.concatenate([of["above"], t[:, :-1]], axis=1), axis=1)
            row, col = np.nonzero(inside & (t > before))
            made.append((c["id"][part][row], c["bin"][part][row], d[row, col], t[row, col]))
        columns = [np.concatenate(x) for x in zip(*made, strict=True)] if made else [np.zeros(0)] * 4
        return pa.Table.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def skylines(seen: DataFrame, rays: DataFrame, tiles: DataFrame, index: DataFrame, bands=BANDS, rings=RINGS, report: list | None = None) -> DataFrame:
    """(id, bin, d, t): the samples of each ray that rise above all before them, by the tangent t at which observers (id, e, n, hobs) see them.

    Tiles are taken one by one, with all rays that cross them: a ray's pass through a tile is a partial staircase, and the
    records among partial staircases are the whole one. A tile's cells are moved once for OBSERVERS_A_TASK of its observers,
    a ray once for each tile that it crosses. Tiles that are not there, or too low to be seen, are the sea.

    Ring by ring from the nearest: a ray that nothing of a tile can rise above any more, by the tile's highest cell, doesn't look
    into it, and a tile that no ray looks into isn't read. report gets (cell, tiles that are there, tiles that were read) of each ring.
    """
    cover = raster.tile_cover(seen.select("id", "e", "n"), rings)
    there = index.select(*(F.col(k).cast("long").alias(k) for k in ("cell", "tx", "ty")), F.greatest(F.coalesce("most_m", F.lit(0.0)), F.lit(0.0)).cast("double").alias("most_m"))
    read = tiles_to_read(seen, index, rings).where("NOT skipped").select("id", *(F.col(k).cast("long").alias(k) for k in ("cell", "tx", "ty")), F.lit(True).alias("reads"))
    cover = cover.select("id", *(F.col(k).cast("long").alias(k) for k in ("cell", "tx", "ty"))).join(read, ["id", "cell", "tx", "ty"], "left").join(there, ["cell", "tx", "ty"], "left")
    cover = checkpointed(cover.select("id", "cell", "tx", "ty", F.coalesce("reads", F.lit(False)).alias("reads"), F.when(F.col("reads"), F.col("most_m")).otherwise(F.lit(0.0)).alias("most_m")))
    crowd = cover.groupBy("cell", "tx", "ty").agg(F.ceil(F.count("*") / OBSERVERS_A_TASK).alias("parts"))
    aimed = checkpointed(rays.join(seen.select("id", "hobs"), "id").select("id", "bin", "hobs", "e0", "n0", "ue", "un"))
    have = tiles.select(*(F.col(k).cast("long").alias(k) for k in ("cell", "tx", "ty")), "width", "height", "scale", "v")
    schedule = np.array(skyline.distance_list(bands, rings[-1][0]), float)
    keys, found, high, inner = ["cell", "tx", "ty", "part"], None, None, 0.0
    for ring in rings:
        passes = crossings(aimed, cover, ring, inner).withColumn("above", F.lit(float("-inf")))
        if high is not None:
            bound = geo.best_tangent(F.col("most_m"), F.col("hobs"), F.greatest("near", F.lit(1e-9)), F.greatest("far", F.lit(1e-9)))
            passes = passes.drop("above").join(high, ["id", "bin"], "left").withColumn("above", F.coalesce("above", F.lit(float("-inf"))))
            passes = passes.where(bound + 1e-12 > F.col("above"))
        passes = passes.join(crowd, ["cell", "tx", "ty"]).withColumn("part", F.pmod(F.hash("id"), F.col("parts")))
        looked = passes.where("reads").select(*(F.col(k).alias(k) for k in keys)).distinct()
        left = passes.select(*keys, F.col("id").cast("long"), F.col("bin").cast("int"), *(F.col(x).cast("double").alias(x) for x in ("hobs", "e0", "n0", "ue", "un", "near", "far", "above")), "reads")
        distances = schedule[(schedule > inner) & (schedule <= ring[0])]
        swept = left.groupBy(*keys).cogroup(have.join(looked, ["cell", "tx", "ty"]).groupBy(*keys)).applyInArrow(_swept(distances, ring[2]), "id long, bin int, d double, t double")
        steps = checkpointed(swept)
        if report is not None:
            report.append((ring[1], cover.where((F.col("cell") == ring[1]) & F.col("reads")).select("tx", "ty").distinct().count(), looked.select("tx", "ty").distinct().count()))
        found = steps if found is None else found.unionByName(steps)
        high = found.groupBy("id", "bin").agg(F.max("t").alias("above"))
        inner = float(ring[0])
    return skyline.records(found.withColumn("ray", F.struct("id", "bin")), "ray", "d", "t").select("id", "bin", "d", "t")


def profile(steps: DataFrame) -> DataFrame:
    """(id, bin, angle, d): the top of each ray's steps, its skyline in degrees."""
    return steps.groupBy("id", "bin").agg(F.max_by(F.struct("t", "d"), "t").alias("b")).select("id", "bin", F.degrees(F.atan("b.t")).alias("angle"), F.col("b.d").alias("d"))


def staircase(steps: DataFrame) -> DataFrame:
    """(id, bin, d10, centi): the steps that are kept of each ray, in tens of metres and hundredths of a degree, halves up."""
    angles = steps.select(F.struct("id", "bin").alias("ray"), "d", F.degrees(F.atan("t")).alias("a"))
    kept = skyline.thinned(angles, "ray", "d", "a")
    return kept.select("ray.id", "ray.bin", F.floor(F.col("d") / 10).cast("int").alias("d10"), F.floor(F.col("a") * 100 + 0.5).cast("short").alias("centi"))


def between_bins(profile: DataFrame, bins: int = BINS) -> DataFrame:
    """profile with slope: how much the skyline changes to the next bin; the last bin's next one is the first."""
    after = profile.select("id", F.pmod(F.col("bin") - 1, F.lit(bins)).cast("int").alias("bin"), F.col("angle").alias("after"))
    return profile.join(after, ["id", "bin"], "left").withColumn("slope", F.coalesce(F.col("after") - F.col("angle"), F.lit(0.0))).drop("after")


def skyline_at(objects: DataFrame, profile: DataFrame, bins: int = BINS) -> DataFrame:
    """objects (observer, id, bearing, ...) with the skyline's angle at their bearing, between the two bins around."""
    place = F.pmod(F.col("bearing"), F.lit(360.0)) * (bins / 360.0)
    sloped = between_bins(profile, bins).select(F.col("id").alias("observer"), "bin", "angle", "slope")
    met = objects.withColumn("place", place).withColumn("bin", F.floor("place").cast("int")).join(sloped, ["observer", "bin"], "left")
    return met.withColumn("skyline", F.col("angle") + F.col("slope") * (F.col("place") - F.col("bin"))).drop("place", "bin", "angle", "slope")


def packed(profile: DataFrame, bins: int = BINS) -> DataFrame:
    """(id, profile): an observer's skyline as an array of hundredths of degrees, one for each bin; bins without one are null."""
    centi = profile.select("id", "bin", F.rint(F.col("angle") * 100).cast("short").alias("c"))
    return raster.scattered(centi, ["id"], "bin", "c", bins, "short", "profile")


#: Bins of the profiles that are kept for saved viewpoints.
VIEWPOINT_BINS = 1440


def viewpoints(observers: DataFrame, tiles: DataFrame, index: DataFrame, bins: int = VIEWPOINT_BINS, bands=BANDS, rings=RINGS) -> DataFrame:
    """(id, hobs, profile) of saved viewpoints (id, lat, lon, eye, override): all are swept at once, each ray a group of its own."""
    e, n = geo.to_grid(F.col("lat"), F.col("lon"))
    seen = checkpointed(eyes(checkpointed(observers).withColumn("e", e).withColumn("n", n), tiles, rings))
    steps = skylines(seen, bearings(seen, rings[-1][0], bins), tiles, index, bands, rings)
    return seen.select("id", "hobs").join(packed(profile(steps), bins), "id")
