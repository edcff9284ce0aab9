"""Queries of rasters, tiles and rays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import skyline, raster
from terravane.plans import views
from terravane.plans.registry import query
from terravane.plans.views import GRID, RAYS, table


@query("block_maxpool", f"WITH g AS ({GRID}) SELECT tile, row // 5 AS row, col // 5 AS col, max(v) AS v FROM g WHERE row < 60 AND col < 60 GROUP BY ALL")
def block_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.max_pool(views.grid(spark, sf_dir), 5, 64, 64)


@query("zone_map", f"WITH g AS ({GRID}) SELECT tile, min(v) AS least, max(v) AS most, count(v) AS live FROM g GROUP BY 1")
def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.zone_map(views.grid(spark, sf_dir))


@query(
    "disc_argmax",
    f"""WITH g AS ({GRID}), p AS (SELECT DISTINCT tile * 4 + k AS id, tile, 10 + k * 13 AS pr, 20 + k * 7 AS pc FROM g, (SELECT unnest([0, 1, 2, 3]) AS k))
    SELECT id, row, col, v, d2 FROM (SELECT p.id, g.row, g.col, g.v, (g.row - pr) ** 2 + (g.col - pc) ** 2 AS d2, row_number() OVER (PARTITION BY p.id ORDER BY g.v DESC, g.row, g.col) AS k
    FROM p JOIN g ON p.tile = g.tile AND (g.row - pr) * (g.row - pr) + (g.col - pc) * (g.col - pc) <= 81) WHERE k = 1""",
)
def disc_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.grid(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    points = cells.select("tile").distinct().withColumn("k", k).select((F.col("tile") * 4 + F.col("k")).alias("id"), "tile", (10 + F.col("k") * 13).alias("row"), (20 + F.col("k") * 7).alias("col"))
    return raster.disc_top(points, cells, 9).withColumn("d2", F.col("d2").cast("double"))


_Q = f"g AS ({GRID}), q AS (SELECT tile, row, col, (round_even((v / 10)::DOUBLE * 4, 0))::BIGINT AS q0 FROM g), w AS (SELECT tile, row, col, greatest(-32767, least(32767, q0)) AS q FROM q)"
_DELTA = f"WITH {_Q} SELECT tile, row, col, ((q - coalesce(lag(q) OVER (PARTITION BY tile, row ORDER BY col), 0) + 32768 + 131072) % 65536 - 32768)::BIGINT AS delta FROM w"


def _quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.grid(spark, sf_dir).select("tile", "row", "col", raster.quantise(F.col("v") / 10).cast("long").alias("q"))


@query("delta_encode", _DELTA)
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.delta_encoded(_quantised(spark, sf_dir)).select("tile", "row", "col", "delta")


@query("delta_decode", f"WITH {_Q} SELECT tile, row, col, q FROM w")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: the quantised values."""
    return raster.delta_decoded(raster.delta_encoded(_quantised(spark, sf_dir)).drop("q")).select("tile", "row", "col", "q")


@query(
    "bilinear_sample",
    f"""WITH g AS ({GRID}), p AS (SELECT DISTINCT tile AS id, tile, 3.25::DOUBLE + tile % 50 AS y, 7.75::DOUBLE + tile % 40 AS x FROM g),
    c AS (SELECT p.id, g.v, (1 - abs(y - 0.5 - g.row)) * (1 - abs(x - 0.5 - g.col)) AS w FROM p JOIN g ON p.tile = g.tile AND g.row IN (floor(y - 0.5), floor(y - 0.5) + 1) AND g.col IN (floor(x - 0.5), floor(x - 0.5) + 1))
    SELECT id, round(sum(v * w) / sum(w), 4) AS v FROM c GROUP BY id""",
)
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, t = views.grid(spark, sf_dir), F.col("tile")
    points = cells.select("tile").distinct().select(t.alias("id"), "tile", (F.lit(3.25) + t % 50).alias("y"), (F.lit(7.75) + t % 40).alias("x"))
    return raster.bilinear(points, cells).select("id", F.round("v", 4).alias("v"))


_OBSERVERS = "o AS (SELECT r_regionkey AS id, 300000.0::DOUBLE + r_regionkey * 40123 AS e, 6700000.0::DOUBLE + r_regionkey * 31337 AS n FROM region)"
_COVER = "WITH " + _OBSERVERS + ", r AS (" + " UNION ALL ".join(
    f"SELECT {outer} AS ro, {inner} AS ri, {cell} AS cell, {cell * edge} AS s" for (outer, cell, edge), inner in zip(raster.RINGS, [0, *(r[0] for r in raster.RINGS[:-1])], strict=True)
) + f"""), t AS (SELECT o.id, e, {raster.ANCHOR_NORTH} - n AS down, ro, ri, cell, s, floor(e / s)::BIGINT + i AS tx, floor(({raster.ANCHOR_NORTH} - n) / s)::BIGINT + j AS ty FROM o, r, (SELECT unnest(range(-8, 9)) AS i), (SELECT unnest(range(-8, 9)) AS j)),
d AS (SELECT *, greatest(tx * s - e, e - (tx + 1) * s, 0) AS dx, greatest(ty * s - down, down - (ty + 1) * s, 0) AS dy, greatest(abs(tx * s - e), abs((tx + 1) * s - e)) AS fx, greatest(abs(ty * s - down), abs((ty + 1) * s - down)) AS fy FROM t),
cover AS (SELECT id, cell, tx, ty, sqrt(dx * dx + dy * dy) AS nearest FROM d WHERE dx * dx + dy * dy <= ro::DOUBLE * ro AND fx * fx + fy * fy > ri::DOUBLE * ri)"""


def _observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(k.alias("id"), (F.lit(300000.0) + k * 40123).alias("e"), (F.lit(6700000.0) + k * 31337).alias("n"))


@query("tile_cover_ring", _COVER + " SELECT id, cell, tx, ty, round(nearest, 3) AS nearest FROM cover")
def tile_cover_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.tile_cover(_observers(spark, sf_dir)).withColumn("nearest", F.round("nearest", 3))


_R = f"{geo.effective_radius()!r}::DOUBLE"


@query(
    "tile_zone_skip",
    _COVER + f""", c AS (SELECT *, ((tx * 31 + ty * 17) % 300)::DOUBLE - 22.3::DOUBLE AS h, nearest + cell * 700.0::DOUBLE AS far FROM cover),
    b AS (SELECT *, CASE WHEN h < 0 THEN least(greatest(nearest, sqrt(2 * {_R} * -h)), far) ELSE nearest END AS spot FROM c)
    SELECT id, cell, count(*) AS n, count(*) FILTER (WHERE nearest <= 15000 OR round(h / spot - spot / (2 * {_R}), 9) >= round(-sqrt(2 * 22.3::DOUBLE / {_R}), 9)) AS n_read FROM b GROUP BY 1, 2""",
)
def tile_zone_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tiles of each ring the zone map lets a sweep skip."""
    tiles = raster.tile_cover(_observers(spark, sf_dir))
    ceiling, eye, near = ((F.col("tx") * 31 + F.col("ty") * 17) % 300).cast("double"), F.lit(22.3), F.col("nearest")
    read = skyline.can_hide(ceiling, eye, F.greatest(near, F.lit(1e-9)), near + F.col("cell") * 700.0)
    return tiles.groupBy("id", "cell").agg(F.count("*").alias("n"), F.count_if(read).alias("n_read"))


@query("record_high_staircase", f"WITH r AS ({RAYS}) SELECT bin, d, h FROM (SELECT *, max(h) OVER (PARTITION BY bin ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r) WHERE m IS NULL OR h > m")
def record_high_staircase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.records(views.rays(spark, sf_dir), "bin", "d", "h")


@query("ray_max", f"WITH r AS ({RAYS}) SELECT bin, max(h) AS top, min(d) FILTER (h = m) AS at FROM (SELECT *, max(h) OVER (PARTITION BY bin) AS m FROM r) GROUP BY bin")
def ray_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.ray_top(views.rays(spark, sf_dir), "bin", "d", "h")


@query(
    "staircase_thinned",
    f"""WITH RECURSIVE r AS ({RAYS}), s AS (SELECT bin, d, h / 100 AS a FROM (SELECT *, max(h) OVER (PARTITION BY bin ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r) WHERE m IS NULL OR h > m),
    n AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY d) AS k, count(*) OVER (PARTITION BY bin) AS most FROM s WHERE a > -6),
    fold AS (SELECT bin, k, most, d, a, a AS held, true AS kept FROM n WHERE k = 1 UNION ALL SELECT n.bin, n.k, n.most, n.d, n.a, CASE WHEN n.a > f.held + 0.2::DOUBLE THEN n.a ELSE f.held END, n.a > f.held + 0.2::DOUBLE FROM fold f JOIN n ON n.bin = f.bin AND n.k = f.k + 1)
    SELECT bin, d::DOUBLE AS d, a FROM fold WHERE kept OR (k = most AND round_even(a * 100, 0) <> round_even(held * 100, 0))""",
)
def staircase_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = skyline.records(views.rays(spark, sf_dir), "bin", "d", "h").select("bin", "d", (F.col("h") / 100).alias("a"))
    return skyline.thinned(steps, spacing=0.2, even=True)


@query(
    "asof_staircase",
    f"""WITH r AS ({RAYS}), s AS (SELECT bin, d, h FROM (SELECT *, max(h) OVER (PARTITION BY bin ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r) WHERE m IS NULL OR h > m)
    SELECT r.bin, r.d, s.h AS skyline, coalesce(r.h > s.h, true) AS visible FROM r ASOF LEFT JOIN s ON r.bin = s.bin AND r.d > s.d""",
)
def asof_staircase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each object meets: the last step of the skyline before it, and whether it is above that."""
    rays = views.rays(spark, sf_dir)
    steps = skyline.records(rays, "bin", "d", "h")
    return skyline.as_of(rays, steps, "bin", "d", "h").select("bin", "d", F.col("step_value").alias("skyline"), F.coalesce(F.col("h") > F.col("step_value"), F.lit(True)).alias("visible"))


_SAMPLES = f"""WITH g AS ({GRID}), obs AS (SELECT DISTINCT tile FROM g), s AS (SELECT tile, b AS bin, k * 100.0::DOUBLE AS d, floor(round(32.5::DOUBLE - k * cos(radians(b * 10.0::DOUBLE)), 6))::BIGINT AS row, floor(round(32.5::DOUBLE + k * sin(radians(b * 10.0::DOUBLE)), 6))::BIGINT AS col
FROM obs, (SELECT unnest(range(0, 36)) AS b), (SELECT unnest(range(1, 31)) AS k)),
h AS (SELECT s.tile * 36 + bin AS ray, d, coalesce(g.v / 400, 0) AS h FROM s LEFT JOIN g USING (tile, row, col)),
t AS (SELECT ray, d, (h - 22.3::DOUBLE - d * d / (2 * {_R})) / d AS t FROM h)
SELECT ray, round(degrees(atan(t)), 6) AS angle, d FROM (SELECT *, row_number() OVER (PARTITION BY ray ORDER BY round(t, 9) DESC, d) AS k FROM t) WHERE k = 1"""


@query("skyline_profile", _SAMPLES)
def skyline_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skylines of 36 rays from the middle of every tile: rays and distances are joined with cells by tile, row and column."""
    cells = views.grid(spark, sf_dir)
    rays = cells.select("tile").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(35)))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(30))))
    angle = F.radians(F.col("bin") * F.lit(10.0))
    samples = rays.select(
        "tile", (F.col("tile") * 36 + F.col("bin")).alias("ray"), (F.col("k") * 100.0).alias("d"), F.lit(22.3).alias("eye"),
        F.floor(F.round(32.5 - F.col("k") * F.cos(angle), 6)).alias("row"), F.floor(F.round(32.5 + F.col("k") * F.sin(angle), 6)).alias("col"),
    )
    met = samples.join(cells, ["tile", "row", "col"], "left").withColumn("h", F.col("v") / 400)
    return skyline.profile(met, "ray").select("ray", F.round("angle", 6).alias("angle"), "d")
