"""Queries of terrain: tiles, ground, summits, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import catalogue, raster, sweep, terrain
from terravane.operators import prominence as prominence_of
from terravane.plans import views
from terravane.plans.registry import query
from terravane.plans.views import LAND, OBSERVERS, PLACES, SMALL_CELLS, table
from terravane.session import checkpointed
from terravane.sources import registers

_R = f"{geo.effective_radius()!r}::DOUBLE"
_N = f"{raster.ANCHOR_NORTH}.0::DOUBLE"


_EDGES, _REFINED = {10: 16, 20: 16}, {10: 5}
_CUT = f"""land AS ({LAND}), c10 AS (SELECT 10 AS cell, col // 2 AS c, row // 2 AS r, max(v) AS v FROM land GROUP BY ALL), c20 AS (SELECT 20 AS cell, col AS c, row AS r, v FROM land),
cut AS (SELECT cell, c // 16 AS tx, r // 16 AS ty, r % 16 AS row, c % 16 AS col, v FROM (SELECT * FROM c10 UNION ALL SELECT * FROM c20))"""


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The land as a level of 5 m, from which 10 m are pooled, and as one of 20 m."""
    return views.land(spark, sf_dir).select(F.explode(F.array(F.lit(5), F.lit(20))).alias("level"), "row", "col", "v")


def _built(spark: SparkSession, sf_dir: str, done: DataFrame) -> DataFrame:
    source = _source(spark, sf_dir)
    return terrain.build_tiles(terrain.tiles_of_source(source, _EDGES, _REFINED), done, source, _EDGES, _REFINED)


def _figures(built: DataFrame) -> DataFrame:
    decoded = raster.decode_tiles(built)
    live = F.filter("v", lambda x: x.isNotNull())
    return decoded.select("cell", "tx", "ty", "least", "most", F.size(live).cast("long").alias("live"), F.aggregate(live, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), "pooled")


_QUANTISED = f"WITH {_CUT}, q AS (SELECT cell, tx, ty, greatest(-32767, least(32767, round_even(v * 4, 0)))::BIGINT AS q FROM cut)"
_FIGURES = "cell::INT AS cell, tx::INT AS tx, ty::INT AS ty, min(q)::INT AS least, max(q)::INT AS most, count(*) AS live, sum(q)::BIGINT AS total, cell = 10 AS pooled FROM q"


@query("tile_build", f"{_QUANTISED} SELECT {_FIGURES} WHERE NOT (tx = 1 AND ty = 0) GROUP BY cell, tx, ty")
def tile_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles of the land that are not done yet, pooled, quantised and encoded, then decoded again: their headers and sums."""
    done = spark.range(1).select(F.explode(F.array(F.lit(10), F.lit(20))).alias("cell"), F.lit(1).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"))
    return _figures(_built(spark, sf_dir, done))


def _land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles that the land's extent meets, dealt to sixteen shards."""
    east, south = _source(spark, sf_dir).where("level = 20").agg(F.max("col"), F.max("row")).first()
    extent = (0, raster.ANCHOR_NORTH - 20 * ((south or 0) + 1), 20 * ((east or 0) + 1), raster.ANCHOR_NORTH)
    return terrain.full_cover(spark, extent, _EDGES, shards=16)


@query(
    "full_cover",
    f"""WITH land AS ({LAND}), e AS (SELECT 20 * (max(col) + 1) AS east, 20 * (max(row) + 1) AS south FROM land), k AS (SELECT cell, (east - 1) // (cell * 16) AS x1, (south - 1) // (cell * 16) AS y1 FROM e, (SELECT unnest([10, 20]) AS cell)),
    t AS (SELECT cell, x1, unnest(range(0, y1 + 1)) AS ty FROM k)
    SELECT cell, (ty * (x1 + 1) + tx) % 16 AS shard, count(*) AS n, sum(tx * 7 + ty)::BIGINT AS checksum FROM (SELECT cell, x1, ty, unnest(range(0, x1 + 1)) AS tx FROM t) GROUP BY 1, 2""",
)
def full_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles that meet the land, dealt to sixteen shards: how many each has."""
    tiles = _land_cover(spark, sf_dir)
    return tiles.groupBy("cell", F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.sum(F.col("tx") * 7 + F.col("ty")).alias("checksum"))


_NEAR = ((400, 10, 16), (1500, 20, 16))


def _cover_sql(outer: int, inner: int, cell: int) -> str:
    s = cell * 16
    near = f"greatest(tx * {s} - e, e - (tx + 1) * {s}, 0) ** 2 + greatest(ty * {s} - ({_N} - n), {_N} - n - (ty + 1) * {s}, 0) ** 2"
    far = f"greatest(abs(tx * {s} - e), abs((tx + 1) * {s} - e)) ** 2 + greatest(abs(ty * {s} - ({_N} - n)), abs((ty + 1) * {s} - ({_N} - n))) ** 2"
    return f"SELECT cell, tx, ty FROM held, o WHERE cell = {cell} AND {near} <= {outer} ** 2 AND {far} > {inner} ** 2"


@query(
    "observer_build",
    f"""{_QUANTISED}, o AS ({OBSERVERS}), held AS (SELECT DISTINCT cell, tx, ty FROM q), w AS (SELECT DISTINCT * FROM ({_cover_sql(400, 0, 10)} UNION ALL {_cover_sql(1500, 400, 20)}))
    SELECT {_FIGURES} JOIN w USING (cell, tx, ty) GROUP BY cell, tx, ty""",
)
def observer_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of the rings around observers, built from the land's own levels."""
    cover = terrain.observer_cover(views.observers(spark, sf_dir), _NEAR)
    empty = spark.createDataFrame([], "cell int, tx long, ty long")
    return _figures(terrain.build_tiles(cover, empty, _source(spark, sf_dir), _EDGES, _REFINED))


@query("national_build", f"{_QUANTISED}, t AS (SELECT {_FIGURES} GROUP BY cell, tx, ty) SELECT cell, count(*) AS tiles, sum(live)::BIGINT AS live, sum(total)::BIGINT AS total, min(least) AS least, max(most) AS most FROM t GROUP BY cell")
def national_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles that meet the land's extent, dealt to shards and built: figures by cell size."""
    cover = _land_cover(spark, sf_dir)
    empty = spark.createDataFrame([], "cell int, tx long, ty long")
    built = _figures(terrain.build_tiles(cover, empty, _source(spark, sf_dir), _EDGES, _REFINED))
    return built.groupBy("cell").agg(F.count("*").alias("tiles"), F.sum("live").alias("live"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


@query(
    "tile_index_totals",
    f"""WITH {_CUT}, t AS (SELECT DISTINCT cell, tx, ty FROM cut), w AS (SELECT DISTINCT cell, tx + d AS tx, ty FROM t, (SELECT unnest([0, 1]) AS d))
    SELECT w.cell, count(*) AS tiles, count(t.tx) AS held, count(t.tx) = (SELECT count(*) FROM t WHERE t.cell = w.cell OR w.cell IS NULL) AS complete FROM w LEFT JOIN t USING (cell, tx, ty) GROUP BY ROLLUP (w.cell)""",
)
def tile_index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tiles wanted, the land's and their eastern neighbours, how many of each cell size, and in all, an index of what was built holds."""
    index = _built(spark, sf_dir, spark.createDataFrame([], "cell int, tx long, ty long")).select("cell", "tx", "ty", F.octet_length("content").alias("bytes"))
    tiles = terrain.tiles_of_source(_source(spark, sf_dir), _EDGES, _REFINED)
    wanted = tiles.withColumn("tx", F.explode(F.array(F.col("tx"), F.col("tx") + 1))).distinct()
    totals = terrain.ring_totals(wanted, index)
    held = index.rollup("cell").agg(F.count("*").alias("n"))
    return totals.alias("t").join(held.alias("h"), F.col("t.cell").eqNullSafe(F.col("h.cell")), "left").select("t.cell", "tiles", "held", (F.col("held") == F.coalesce("n", F.lit(0))).alias("complete"))


_POINTS = f"(SELECT s_suppkey AS id, s_suppkey * 37.25::DOUBLE AS e, {_N} - (s_suppkey * 53.5::DOUBLE) % 900 AS n FROM supplier)"


@query(
    "ground_at_point",
    f"""WITH land AS ({LAND}), c AS ({SMALL_CELLS}), p AS {_POINTS},
    t AS (SELECT p.id, arg_min(q / 4.0::DOUBLE, cell) AS v FROM p JOIN c ON floor(e / cell) = tx * 64 + col AND floor(({_N} - n) / cell) = ty * 64 + row WHERE (row + col) % 3 <> 0 GROUP BY p.id),
    k AS (SELECT p.id, v, (1 - abs(({_N} - n) / 25 - 0.5 - row)) * (1 - abs(e / 25 - 0.5 - col)) AS w FROM p JOIN land ON row IN (floor(({_N} - n) / 25 - 0.5), floor(({_N} - n) / 25 - 0.5) + 1) AND col IN (floor(e / 25 - 0.5), floor(e / 25 - 0.5) + 1)),
    m AS (SELECT id, sum(v * w) / sum(w) AS v FROM k GROUP BY id)
    SELECT p.id, round(coalesce(t.v, m.v), 2) AS ground FROM p LEFT JOIN t USING (id) LEFT JOIN m USING (id)""",
)
def ground_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation at points: a tile's cell where one knows it, else a model of 25 m between its cells."""
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("id"), (k * F.lit(37.25)).alias("e"), (F.lit(float(raster.ANCHOR_NORTH)) - (k * F.lit(53.5)) % 900).alias("n"))
    tiles = views.small_tiles(spark, sf_dir)
    tiles = tiles.withColumn("v", F.transform("v", lambda v, i: F.when((F.floor(i / 64) + i % 64) % 3 != 0, v)))
    model = raster.blocks(views.land(spark, sf_dir).withColumn("level", F.lit(25)), 64)
    return terrain.ground_from_tiles(points, tiles, model, 25.0, 64, {10: 64, 20: 64})


@query(
    "ground_in_window",
    f"""WITH land AS ({LAND}), p AS {_POINTS}, w AS (SELECT p.id, e, n, row, col, CASE WHEN (row + col + p.id) % 2 = 0 THEN v END AS v FROM p JOIN land ON abs(row - floor(({_N} - n) / 10)) <= 1 AND abs(col - floor(e / 10)) <= 1)
    SELECT id, round(coalesce(max(v) FILTER (row = floor(({_N} - n) / 10) AND col = floor(e / 10)), avg(v)), 2) AS ground FROM w GROUP BY id""",
)
def ground_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation at points from a window of nine cells around each, half of them unknown: the cell's own, else the mean of those known."""
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("id"), (k * F.lit(37.25)).alias("e"), (F.lit(float(raster.ANCHOR_NORTH)) - (k * F.lit(53.5)) % 900).alias("n"))
    around = F.sequence(F.lit(-1), F.lit(1))
    at = points.withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    at = at.select("id", (F.floor((raster.ANCHOR_NORTH - F.col("n")) / 10) + F.col("i")).alias("row"), (F.floor(F.col("e") / 10) + F.col("j")).alias("col"))
    v = F.when((F.col("row") + F.col("col") + F.col("id")) % 2 == 0, F.col("v"))
    windows = at.join(views.land(spark, sf_dir), ["row", "col"]).select("id", F.lit(0.0).alias("west"), F.lit(float(raster.ANCHOR_NORTH)).alias("north"), "row", "col", v.alias("v"))
    return terrain.ground_in_window(points, windows, 10.0)


@query(
    "lidar_windows",
    f"""WITH land AS ({LAND}), p AS {_POINTS}
    SELECT p.id, max(v) * 0.1::DOUBLE AS h FROM p LEFT JOIN land ON row >= floor(({_N} - n - 40) / 10) AND row <= floor(({_N} - n + 40) / 10) - 1 AND col >= floor((e - 40) / 10) AND col <= floor((e + 40) / 10) - 1 AND v IS NOT NULL GROUP BY p.id""",
)
def lidar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest of the square around each point, in cells of 10 m; values are decimetres."""
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("id"), (k * F.lit(37.25)).alias("e"), (F.lit(float(raster.ANCHOR_NORTH)) - (k * F.lit(53.5)) % 900).alias("n"))
    return catalogue.window_heights(points, views.land(spark, sf_dir), 40.0, 10.0)


def _search(radius: int, places: str) -> str:
    d = f"sqrt(((col + 0.5::DOUBLE) * 10 - x) ** 2 + (({_N} - (row + 0.5::DOUBLE) * 10) - y) ** 2)"
    return f"""SELECT id, round(v, 1) AS top, round((col + 0.5::DOUBLE) * 10, 1) AS x, round({_N} - (row + 0.5::DOUBLE) * 10, 1) AS y, round(dd, 1) AS d, dd > {radius} - 15 AS open
    FROM (SELECT p.id, row, col, v, {d} AS dd, row_number() OVER (PARTITION BY p.id ORDER BY v DESC, row, col) AS k FROM {places} p JOIN land ON {d} <= {radius} WHERE v > -500 AND v < 2000) WHERE k = 1"""


_SNAP = f"""WITH land AS ({LAND}), places AS ({PLACES}), spot AS (SELECT p.id, round(v, 1) AS pt FROM places p JOIN land ON row = floor(({_N} - y) / 10) AND col = floor(x / 10)),
one AS (SELECT p.id, s.top, s.x, s.y, s.d, s.open FROM (SELECT * FROM places WHERE sr >= 100000) p LEFT JOIN ({_search(150, "(SELECT * FROM places WHERE sr >= 100000)")}) s USING (id)),
wide AS ({_search(500, "(SELECT p.* FROM places p JOIN one USING (id) WHERE one.open)")}),
closed AS (SELECT w.*, sqrt((w.x - p.x) ** 2 + (w.y - p.y) ** 2) AS own FROM wide w JOIN places p USING (id) WHERE NOT w.open),
claims AS (SELECT c.id, arg_min(q.id, sqrt((c.x - q.x) ** 2 + (c.y - q.y) ** 2)) AS rival FROM closed c JOIN places q ON q.id <> c.id AND sqrt((c.x - q.x) ** 2 + (c.y - q.y) ** 2) < own GROUP BY 1),
two AS (SELECT o.id, CASE WHEN r THEN c.top ELSE o.top END AS top, CASE WHEN r THEN c.x ELSE o.x END AS x, CASE WHEN r THEN c.y ELSE o.y END AS y, CASE WHEN r THEN c.d ELSE o.d END AS d, CASE WHEN r THEN false ELSE o.open END AS open,
 CASE WHEN o.open THEN true END AS wide, rival AS claimed FROM (SELECT o.*, coalesce(o.open AND c.id IS NOT NULL AND rival IS NULL, false) AS r FROM one o LEFT JOIN closed c USING (id) LEFT JOIN claims USING (id)) o LEFT JOIN closed c USING (id) LEFT JOIN claims USING (id)),
more AS (SELECT p.* FROM places p WHERE id IN (SELECT claimed FROM two) AND id NOT IN (SELECT id FROM two)),
three AS (SELECT p.id, s.top, s.x, s.y, s.d, s.open, NULL::BOOLEAN AS wide, NULL::BIGINT AS claimed FROM more p LEFT JOIN ({_search(150, "more")}) s USING (id)),
snapped AS (SELECT a.*, pt FROM (SELECT * FROM two UNION ALL SELECT * FROM three) a LEFT JOIN spot USING (id))"""


def _snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.snapped(views.places(spark, sf_dir), views.land(spark, sf_dir))


@query("summit_snap", _SNAP + " SELECT id, pt, top, x, y, d, open, wide, claimed FROM snapped")
def summit_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summits near names in three passes: near, wide where the ground still rises, and the names that own another's summit."""
    return _snapped(spark, sf_dir)


@query(
    "hill_assembly",
    _SNAP + """, keep AS (SELECT * FROM places WHERE sr >= 100000), sel AS (SELECT * FROM keep UNION ALL SELECT p.* FROM places p WHERE id IN (SELECT claimed FROM snapped WHERE id IN (SELECT id FROM keep)) AND id NOT IN (SELECT id FROM keep)),
    h AS (SELECT p.*, s.top, s.x AS sx, s.y AS sy, s.d, coalesce(s.pt, p.ele) AS pt2, s.claimed, s.top IS NOT NULL AND NOT s.open AS ok, s.top IS NOT NULL AND s.open AS no FROM sel p LEFT JOIN snapped s USING (id))
    SELECT id, name, sr AS rank, round(CASE WHEN ok THEN top WHEN no THEN pt2 ELSE ele END, 1) AS top_m, CASE WHEN ok OR no THEN 'dem10' ELSE 'nimisto' END AS src_top, CASE WHEN ok THEN sx ELSE x END AS x, CASE WHEN ok THEN sy ELSE y END AS y,
    CASE WHEN ok THEN d END AS snap_m, CASE WHEN ok THEN round(top - pt2, 1) END AS gain_m, CASE WHEN no THEN true END AS open, CASE WHEN no THEN claimed END AS claimed_by FROM h WHERE CASE WHEN ok THEN top WHEN no THEN pt2 ELSE ele END >= 300""",
)
def hill_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named hills of a scale with their claimants: accepted, refused or not sampled, and at least 300 m high."""
    names = F.array(F.struct(F.col("name").alias("n"), F.lit("fin").alias("lang"), F.lit("1").alias("off"), F.lit("1").alias("dom")))
    places = views.places(spark, sf_dir).withColumns({"typ": F.lit(registers.PLACE_TYPES[0]), "muni": F.lit("091"), "kind": F.lit(None).cast("string"), "names": names})
    summits = _snapped(spark, sf_dir)
    hills = registers.hills(registers.selected(places, summits), summits, least_top=300.0)
    return hills.select("id", "name", "rank", "top_m", "src_top", "x", "y", "snap_m", "gain_m", "open", "claimed_by")


@query(
    "max_pyramid",
    f"""WITH land AS ({LAND}), a AS (SELECT 0 AS level, row, col, v FROM land), b AS (SELECT 1 AS level, row // 2 AS row, col // 2 AS col, max(v) AS v FROM land GROUP BY ALL), c AS (SELECT 2 AS level, row // 4 AS row, col // 4 AS col, max(v) AS v FROM land GROUP BY ALL)
    SELECT level, count(*) AS n, round(sum(v), 3) AS total, max(v) AS most FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY level""",
)
def max_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = terrain.max_pyramid(views.land(spark, sf_dir), 2)
    return levels.groupBy("level").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"), F.max("v").alias("most"))


@query("prominence")
def prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the land with 30 m of prominence and more, by merge trees of its tiles; those at its edge are open."""
    return prominence_of.prominences(views.land(spark, sf_dir), 64, 30.0)


_BINS = 36
_SWEEP = f"""WITH c AS ({SMALL_CELLS}), o AS ({OBSERVERS}),
g AS (SELECT o.id, arg_min(q / 4.0::DOUBLE, cell) AS ground FROM o JOIN c ON floor(e / cell) = tx * 64 + col AND floor(({_N} - n) / cell) = ty * 64 + row GROUP BY o.id),
held AS (SELECT DISTINCT cell, tx, ty FROM c), cov AS (SELECT o.id, min(cell) AS cell FROM o JOIN held ON floor(e / (cell * 64)) = tx AND floor(({_N} - n) / (cell * 64)) = ty GROUP BY o.id),
seen AS (SELECT o.*, coalesce(override, CASE WHEN cov.cell IS NOT NULL THEN coalesce((SELECT min(q) / 4.0::DOUBLE FROM c WHERE c.cell = cov.cell AND floor(o.e / c.cell) = tx * 64 + col AND floor(({_N} - o.n) / c.cell) = ty * 64 + row), 0) END) + eye AS hobs FROM o LEFT JOIN cov USING (id)),
r AS (SELECT id, e, n, hobs, b AS bin, round(sin(radians(b * 10.0::DOUBLE)), 9) AS ue, round(cos(radians(b * 10.0::DOUBLE)), 9) AS un FROM seen, (SELECT unnest(range(0, {_BINS})) AS b) WHERE hobs IS NOT NULL),
d AS (SELECT unnest(range(10, 401, 10))::DOUBLE AS d, 10 AS cell UNION ALL SELECT unnest(range(450, 1501, 50))::DOUBLE, 20),
s AS (SELECT id, bin, hobs, d, cell, e + ue * d AS e, n + un * d AS n FROM r, d),
f AS (SELECT *, floor(e / (cell * 64)) AS tx, floor(({_N} - n) / (cell * 64)) AS ty FROM s),
x AS (SELECT *, (e - tx * cell * 64) / cell - 0.5::DOUBLE AS fx, ({_N} - ty * cell * 64 - n) / cell - 0.5::DOUBLE AS fy FROM f),
i AS (SELECT *, greatest(0, least(floor(fx), 62)) AS ix, greatest(0, least(floor(fy), 62)) AS iy FROM x),
u AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, fx - ix)) AS gx, greatest(0.0::DOUBLE, least(1.0::DOUBLE, fy - iy)) AS gy FROM i),
k AS (SELECT u.*, a.q AS a00, b.q AS a01, cc.q AS a10, dd.q AS a11, own.q AS q FROM u LEFT JOIN c a ON a.cell = u.cell AND a.tx = u.tx AND a.ty = u.ty AND a.row = iy AND a.col = ix LEFT JOIN c b ON b.cell = u.cell AND b.tx = u.tx AND b.ty = u.ty AND b.row = iy AND b.col = ix + 1
 LEFT JOIN c cc ON cc.cell = u.cell AND cc.tx = u.tx AND cc.ty = u.ty AND cc.row = iy + 1 AND cc.col = ix LEFT JOIN c dd ON dd.cell = u.cell AND dd.tx = u.tx AND dd.ty = u.ty AND dd.row = iy + 1 AND dd.col = ix + 1
 LEFT JOIN c own ON own.cell = u.cell AND own.tx = u.tx AND own.ty = u.ty AND own.row = floor(fy + 0.5::DOUBLE) AND own.col = floor(fx + 0.5::DOUBLE)),
h AS (SELECT id, bin, hobs, d, coalesce(coalesce((a00 + (a01 - a00) * gx) + ((a10 + (a11 - a10) * gx) - (a00 + (a01 - a00) * gx)) * gy, q) / 4, 0) AS h FROM k),
t AS (SELECT id, bin, d, (h - hobs - d * d / (2 * {_R})) / d AS t FROM h),
steps AS (SELECT id, bin, d, t FROM (SELECT *, max(t) OVER (PARTITION BY id, bin ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t) WHERE m IS NULL OR t > m),
prof AS (SELECT id, bin, degrees(atan(max(t))) AS angle, arg_max(d, t) AS d FROM steps GROUP BY id, bin)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = checkpointed(views.small_tiles(spark, sf_dir))
    seen = sweep.eyes(views.observers(spark, sf_dir), tiles, views.SMALL_RINGS)
    angle = F.radians(F.col("bin") * F.lit(360.0 / _BINS))
    rays = seen.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(_BINS - 1)))).select("id", "bin", F.col("e").alias("e0"), F.col("n").alias("n0"), F.round(F.sin(angle), 9).alias("ue"), F.round(F.cos(angle), 9).alias("un"))
    index = tiles.select("cell", "tx", "ty", (F.array_max("v") / F.col("scale")).alias("most_m"))
    return sweep.skylines(seen, rays, tiles, index, views.SMALL_BANDS, views.SMALL_RINGS)


@query("skyline_sweep", _SWEEP + " SELECT id, bin, round(angle, 6) AS angle, d FROM prof")
def skyline_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skylines around observers over tiles of two cell sizes: ground, rings, rays, heights between cells, the highest of each ray."""
    return sweep.profile(_steps(spark, sf_dir)).select("id", "bin", F.round("angle", 6).alias("angle"), "d")


@query("skyline_packed", _SWEEP + ", p AS (SELECT id, bin, round_even(angle * 100, 0)::INT AS c FROM prof) SELECT id, count(*) AS n, sum(c)::BIGINT AS total, min(c) AS least, max(c) AS most FROM p GROUP BY id")
def skyline_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skylines as arrays of hundredths of degrees: their sums."""
    p = sweep.packed(sweep.profile(_steps(spark, sf_dir)), _BINS).withColumn("p", F.transform("profile", lambda x: x.cast("int")))
    return p.select("id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_min("p").alias("least"), F.array_max("p").alias("most"))


@query(
    "skyline_occlusion",
    _SWEEP + f""", obj AS (SELECT s_suppkey AS id, s_suppkey % 5 AS observer, (s_suppkey * 7.3::DOUBLE) % 360 AS bearing FROM supplier),
    b AS (SELECT obj.*, floor(bearing * {_BINS / 360.0}::DOUBLE) AS bin, bearing * {_BINS / 360.0}::DOUBLE AS place FROM obj)
    SELECT b.id, b.observer, round(p.angle + (coalesce(q.angle, p.angle) - p.angle) * (place - b.bin), 6) AS skyline FROM b LEFT JOIN prof p ON p.id = observer AND p.bin = b.bin LEFT JOIN prof q ON q.id = observer AND q.bin = (b.bin + 1) % {_BINS}""",
)
def skyline_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skyline at objects' own bearings, between the two bins around."""
    k = F.col("s_suppkey")
    objects = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 5).alias("observer"), ((k * F.lit(7.3)) % 360).alias("bearing"))
    return sweep.skyline_at(objects, sweep.profile(_steps(spark, sf_dir)), _BINS).select("id", "observer", F.round("skyline", 6).alias("skyline"))


@query(
    "sweep_schedule",
    f"""WITH d AS (SELECT unnest(range(10, 5001, 10))::DOUBLE AS d UNION ALL SELECT unnest(range(5025, 20001, 25)) UNION ALL SELECT unnest(range(20050, 60001, 50)) UNION ALL SELECT unnest(range(60100, 90001, 100)))
    SELECT id, CASE WHEN d <= 12000 THEN 10 WHEN d <= 35000 THEN 20 WHEN d <= 60000 THEN 50 ELSE 100 END AS ring, count(*) AS n, max(d) AS most, round(max(e + d), 3) AS east FROM d, ({OBSERVERS}) GROUP BY 1, 2""",
)
def sweep_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of each observer's ray to the east by the cell size of their ring."""
    ray = views.observers(spark, sf_dir).select("id", F.lit(900).alias("bin"), F.lit(0.0).alias("hobs"), F.col("e").alias("e0"), F.col("n").alias("n0"), F.lit(1.0).alias("ue"), F.lit(0.0).alias("un"))
    return sweep.samples(ray).groupBy("id", F.col("cell").alias("ring")).agg(F.count("*").alias("n"), F.max("d").alias("most"), F.round(F.max("e"), 3).alias("east"))


@query("viewpoint_profiles")
def viewpoint_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skylines by geodesic bearings of all suppliers' places on the land as saved viewpoints, swept tile by tile; tests hold them against one observer at a time."""
    k = F.col("s_suppkey")
    e, n = F.lit(101.0) + (k * 29) % 1800, F.lit(float(raster.ANCHOR_NORTH)) - 33 - (k * 17) % 560
    lat, lon = geo.to_degrees(e, n)
    where = table(spark, sf_dir, "supplier").select(k.cast("long").alias("id"), lat.alias("lat"), lon.alias("lon"), F.lit(2.0).alias("eye"), F.when(k % 10 == 3, F.lit(150.0)).alias("override"))
    tiles = checkpointed(views.small_tiles(spark, sf_dir))
    index = tiles.select("cell", "tx", "ty", (F.array_max("v") / F.col("scale")).alias("most_m"))
    found = sweep.viewpoints(where, tiles, index, _BINS, views.SMALL_BANDS, views.SMALL_RINGS)
    return found.select("id", F.round("hobs", 6).alias("hobs"), F.transform("profile", lambda x: x.cast("int")).alias("profile"))
