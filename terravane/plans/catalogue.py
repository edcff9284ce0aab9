"""Queries of the catalogue: its build, and the rules that fill and check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import catalogue, raster, spatial
from terravane.plans import views
from terravane.plans.registry import query
from terravane.plans.scalars import GRID_FORWARD
from terravane.plans.views import GEO_BASE, GEO_IN, METRES, table
from terravane.sources import registers

KINDS = ("mast", "chimney", "obstower", "lighthouse", "building", "turbine")


def _kind(k):
    return F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int"))


_KIND = "list_extract([" + ", ".join(f"'{k}'" for k in KINDS) + "], ({} % 6 + 1)::INT)"


def layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A base layer of 1,500 sites at sf0.01 and four that are merged into it."""
    base, sites, k = views.geo_base(spark, sf_dir), views.geo_in(spark, sf_dir), F.col("id")
    moved = lambda north, east: sites.withColumn("lat", F.col("lat") + north).withColumn("lon", F.col("lon") + east)
    tall = lambda by: F.abs(F.col("height_m")) / by
    first = base.select(k.alias("seq"), _kind(k).alias("cat"), "lat", "lon", F.when(k % 3 != 0, tall(50)).alias("height_m"), F.lit("mtk").alias("src_pos"), F.lit("mtk").alias("src_h"), F.when(k % 4 == 0, "").otherwise(F.col("name")).alias("name"))
    aip = sites.select(k.alias("seq"), _kind(k).alias("cat"), "lat", "lon", tall(40).alias("height_m"), F.when(k % 2 == 0, F.lit(12.0)).alias("ground_m"), F.lit("aip").alias("src_pos"), F.lit("aip").alias("src_h"), F.concat(F.lit("A"), k).alias("obst_id"))
    osm = moved(0.0004, 0.0006).select(k.alias("seq"), _kind(k).alias("cat"), "lat", "lon", F.when(k % 2 == 0, tall(60)).alias("height_m"), F.lit("osm").alias("src_pos"), F.when(k % 2 == 0, "osm").alias("src_h"), "name")
    buildings = moved(-0.0001, 0.0002).where(k % 3 == 1).select(k.alias("seq"), F.lit("building").alias("cat"), "lat", "lon", tall(70).alias("height_m"), F.lit("osm").alias("src_pos"), F.lit("osm").alias("src_h"), "name")
    marks = moved(0.0002, -0.0003).where(k % 3 == 0).select(
        k.alias("seq"), F.lit("lighthouse").alias("cat"), "lat", "lon", F.lit("vayla").alias("src_pos"), (k % 40).cast("double").alias("focal_m"), F.when(k % 2 == 0, F.lit(9.0)).alias("focal_agl_m"),
        F.lit("Merimajakka").alias("vayla_type"), k.alias("vayla_id"), F.lit(True).alias("in_service"), F.lit("state").alias("owner"),
    )
    start = 1 << 40
    return catalogue.layer(first, 0), {n: catalogue.layer(rows, start * i) for i, (n, rows) in enumerate((("aip", aip), ("osm", osm), ("buildings", buildings), ("vayla", marks)), 1)}


def surveys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Heights at positions, of a newest survey with gaps and an older one."""
    base, k = views.geo_base(spark, sf_dir), F.col("id")
    key = catalogue.position_key(F.col("lat"), F.col("lon")).alias("key")
    return base.where(k % 2 == 0).select(key, (k % 50 / 2.0).alias("h")), base.where(k % 3 == 0).select(key, (k % 70 / 2.0).alias("h"))


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, v): an elevation model of the sites' area in cells of 100 m, with gaps and wild values."""
    k = F.col("o_orderkey")
    v = F.when(k % 7 == 0, F.lit(-9999.0)).when(k % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice") / 1000)
    return table(spark, sf_dir, "orders").select(F.floor(k / 120).alias("row"), (k % 120).alias("col"), v.alias("v"))


MODEL_CELL, MODEL_WEST, MODEL_NORTH = 100.0, 388_000.0, 6_664_000.0


@query("catalogue_build")
def catalogue_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue from five layers, end to end; a test holds it against the rules in sequence."""
    base, incoming = layers(spark, sf_dir)
    built = catalogue.build(base, incoming, catalogue.lidar_samples(*surveys(spark, sf_dir)), model(spark, sf_dir), MODEL_CELL, MODEL_WEST, MODEL_NORTH)
    return built.select("id", "cat", F.round("height_m", 3).alias("height_m"), "src_h", "ground_m", "src_g", F.round("top_m", 1).alias("top_m"), "conf", "name", "obst_id", "focal_m", "h_basis", "srcs")


@query(
    "lidar_fold_in",
    f"""WITH base AS ({GEO_BASE}), o AS (SELECT id, lat, lon, CASE WHEN id % 3 <> 0 THEN abs(height_m) / 50 END AS h FROM base),
    s AS (SELECT printf('%.6f,%.6f', lat, lon) AS key, max(CASE WHEN id % 2 = 0 AND id % 50 / 2.0 >= 3 THEN id % 50 / 2.0 END) AS a, max(CASE WHEN id % 3 = 0 AND id % 70 / 2.0 >= 3 THEN id % 70 / 2.0 END) AS b FROM base WHERE id % 2 = 0 OR id % 3 = 0 GROUP BY 1)
    SELECT o.id, round(coalesce(h, round(coalesce(a, b), 1)), 3) AS height_m, CASE WHEN h IS NULL AND coalesce(a, b) >= 3 THEN 'ndsm' ELSE 'mtk' END AS src_h, CASE WHEN h IS NULL AND coalesce(a, b) >= 3 THEN 'lidar' END AS conf FROM o LEFT JOIN s ON s.key = printf('%.6f,%.6f', o.lat, o.lon)""",
)
def lidar_fold_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown heights from the newest survey that tells one at the position; known ones stay."""
    base, _ = layers(spark, sf_dir)
    return catalogue.with_lidar(base, catalogue.lidar_samples(*surveys(spark, sf_dir))).select("id", F.round("height_m", 3).alias("height_m"), "src_h", "conf")


@query(
    "ground_fill",
    GRID_FORWARD
    + f""", m AS (SELECT o_orderkey // 120 AS row, o_orderkey % 120 AS col, CASE WHEN o_orderkey % 7 = 0 THEN -9999.0::DOUBLE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 1000 END AS v FROM orders),
    k AS (SELECT g.id, {_KIND.format("g.id")} AS cat, m.v FROM g LEFT JOIN m ON row = floor(({MODEL_NORTH}::DOUBLE - n) / 100) AND col = floor((e - {MODEL_WEST}::DOUBLE) / 100) AND v BETWEEN -1000 AND 1500)
    SELECT id, coalesce(round(v, 1), CASE WHEN cat = 'lighthouse' THEN 0 END) AS ground_m, CASE WHEN v IS NOT NULL THEN 'dem100' WHEN cat = 'lighthouse' THEN 'sea' END AS src_g FROM k""",
)
def ground_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown ground from an elevation model; lighthouses outside it stand at the sea."""
    base, _ = layers(spark, sf_dir)
    blocks = raster.blocks(model(spark, sf_dir).withColumn("level", F.lit(100)), 256)
    return catalogue.with_ground(base, blocks, MODEL_CELL, MODEL_WEST, MODEL_NORTH, 256).select("id", "ground_m", "src_g")


@query(
    "catalogue_counts",
    f"""WITH base AS ({GEO_BASE}), o AS (SELECT {_KIND.format("id")} AS cat, CASE WHEN id % 3 <> 0 THEN height_m END AS h, CASE WHEN id % 4 = 0 THEN '' ELSE name END AS name FROM base)
    SELECT CASE WHEN grouping(cat) = 1 THEN 'TOTAL' ELSE cat END AS cat, count(*) AS n, count(h) AS n_height_m, 0::BIGINT AS n_ground_m, count(*) FILTER (name <> '') AS n_named FROM o GROUP BY ROLLUP (cat)""",
)
def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = layers(spark, sf_dir)
    return catalogue.report(base, "cat", ("height_m", "ground_m"))


@query(
    "closest_pairs",
    f"""WITH inc AS ({GEO_IN}), p AS (SELECT a.id AS a_id, b.id AS b_id, round({METRES}, 3) AS d FROM inc a JOIN inc b ON a.id <> b.id AND {METRES} <= 1000),
    n AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) AS k FROM p) SELECT a_id, b_id, d FROM n WHERE k = 1 ORDER BY d, a_id, b_id LIMIT 6""",
)
def closest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six points with the nearest neighbours."""
    return catalogue.closest_pairs(views.geo_in(spark, sf_dir).select("id", "lat", "lon"), 1000.0)


@query(
    "tier_medians",
    """WITH p AS (SELECT p_size AS tier, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS v FROM part), t AS (SELECT DISTINCT tier FROM p),
    j AS (SELECT t.tier, v, row_number() OVER (PARTITION BY t.tier ORDER BY v NULLS LAST) - 1 AS k, count(v) OVER (PARTITION BY t.tier) // 2 AS m FROM t JOIN p ON p.tier >= t.tier)
    SELECT tier AS rank, count(*) AS n, max(v) FILTER (k = m) AS median FROM j GROUP BY tier""",
)
def tier_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tier and all above it the number of rows and the upper median."""
    rows = table(spark, sf_dir, "part").select("p_size", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("v"))
    return catalogue.tier_medians(rows, "p_size", "v")


@query(
    "imputed_heights",
    """WITH o AS (SELECT c_custkey AS id, c_mktsegment AS cat, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS h FROM customer), m AS (SELECT cat, median(h) AS m FROM o GROUP BY 1)
    SELECT id, round(coalesce(h, m), 4) AS height_m, h IS NULL AND m IS NOT NULL AS estimated FROM o JOIN m USING (cat)""",
)
def imputed_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown heights by the median of the class, marked as estimated."""
    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("cat"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("height_m"))
    return catalogue.imputed(objects).select("id", F.round("height_m", 4).alias("height_m"), "estimated")


_SITES = f"WITH base AS ({GEO_BASE}), inc AS ({GEO_IN})"


@query(
    "composite_stacks",
    f"""{_SITES}, p AS (SELECT a.id AS a_id, a.height_m AS h, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY round({METRES}, 3), b.id) AS k FROM inc a JOIN base b ON {METRES} <= 60),
    m AS (SELECT b_id, max(h) AS more FROM p WHERE k = 1 GROUP BY 1)
    SELECT id, false AS mast, round(height_m + coalesce(more, 0), 3) AS height_m, more IS NOT NULL AS composite FROM base LEFT JOIN m ON id = b_id
    UNION ALL SELECT id, true, round(height_m, 3), false FROM inc WHERE id NOT IN (SELECT a_id FROM p)""",
)
def composite_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masts that stand on a tower are one object with it, as high as both."""
    shift = 1 << 40
    towers = views.geo_base(spark, sf_dir).select("id", F.lit("obstower").alias("cat"), "lat", "lon", "height_m")
    masts = views.geo_in(spark, sf_dir).select((F.col("id") + shift).alias("id"), F.lit("mast").alias("cat"), "lat", "lon", "height_m")
    out = catalogue.stacked(towers.unionByName(masts), 60.0)
    mast = F.col("cat") == "mast"
    return out.select(F.when(mast, F.col("id") - shift).otherwise(F.col("id")).alias("id"), mast.alias("mast"), F.round("height_m", 3).alias("height_m"), "composite")


_NEAR = f"n AS (SELECT a.id, b.id AS b_id, b.name AS name, b.height_m AS h, round({METRES}, 3) AS d, row_number() OVER (PARTITION BY a.id ORDER BY round({METRES}, 3), b.id) AS k FROM inc a JOIN base b ON {METRES} <= 100)"


@query("attached_texts", f"{_SITES}, {_NEAR} SELECT inc.id, n.name AS text, n.d FROM inc LEFT JOIN n ON inc.id = n.id AND k = 1")
def attached_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest text within 100 m of each object."""
    texts = views.geo_base(spark, sf_dir).withColumnRenamed("name", "text")
    return catalogue.attached(views.geo_in(spark, sf_dir), texts, 100.0)


@query("fallback_labels", f"{_SITES}, {_NEAR} SELECT inc.id, CASE WHEN inc.id % 2 = 0 THEN inc.name WHEN n.name IS NULL THEN 'Mast' ELSE 'Mast, ' || n.name END AS label FROM inc LEFT JOIN n ON inc.id = n.id AND k = 1")
def fallback_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's name, else its class and the nearest place."""
    objects = views.geo_in(spark, sf_dir).select("id", "lat", "lon", F.lit("mast").alias("cat"), F.when(F.col("id") % 2 == 0, F.col("name")).otherwise("").alias("name"))
    return catalogue.labelled(objects, views.geo_base(spark, sf_dir).select("id", "lat", "lon", "name"), 100.0).select("id", "label")


@query("spot_heights", f"{_SITES}, {_NEAR} SELECT inc.id, coalesce(n.h, inc.height_m) AS top_m, CASE WHEN n.h IS NULL THEN 'dem10' ELSE 'spot' END AS src FROM inc LEFT JOIN n ON inc.id = n.id AND k = 1")
def spot_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surveyed height near a summit counts before the model's."""
    summits = views.geo_in(spark, sf_dir).select("id", "lat", "lon", F.col("height_m").alias("top_m"))
    return catalogue.spot_preferred(summits, views.geo_base(spark, sf_dir).select("id", "lat", "lon", F.col("height_m").alias("h")), 100.0)


@query(
    "near_conflicts",
    f"{_SITES} SELECT a.id AS a_id, b.id AS b_id, round({METRES}, 3) AS d FROM inc a JOIN base b ON {METRES} <= 60 WHERE NOT (abs(a.height_m - b.height_m) <= greatest(10.0::DOUBLE, 0.15::DOUBLE * greatest(a.height_m, b.height_m))) AND {METRES} <= 55",
)
def near_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs so near that they are one object although their heights disagree."""
    pairs = spatial.range_join(views.geo_in(spark, sf_dir), views.geo_base(spark, sf_dir), 60.0)
    return pairs.where(spatial.near_conflict(F.col("a_height_m"), F.col("b_height_m"), F.col("d"), 55.0)).select("a_id", "b_id", F.round("d", 3).alias("d"))


_KINDS = ("mast", "obstower", "lighthouse", "building", "pylon")


@query(
    "category_matrix",
    f"""WITH k AS (SELECT {list(_KINDS)!r} AS kinds), x AS (SELECT a.c AS a, b.c AS b FROM (SELECT c_nationkey AS n, kinds[c_custkey % 5 + 1] AS c FROM customer, k) a JOIN (SELECT s_nationkey AS n, kinds[s_suppkey % 5 + 1] AS c FROM supplier, k) b USING (n)),
    y AS (SELECT *, (a = b AND a <> 'pylon') OR (a <> b AND a IN ('obstower', 'lighthouse', 'building') AND b IN ('obstower', 'lighthouse', 'building')) AS fits FROM x)
    SELECT a, b, fits, count(*) AS n FROM y GROUP BY ALL""",
)
def category_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of objects of a nation by their categories, and whether these may be one object; a category that isn't listed merges with none."""
    kinds = F.array(*map(F.lit, _KINDS))
    of = lambda name, key, nation, c: table(spark, sf_dir, name).select(F.col(nation).alias("nation"), F.get(kinds, (F.col(key) % 5).cast("int")).alias(c))
    # By nation and category first, so that pairs are counted, not made.
    left, right = (of(*x).groupBy("nation", x[3]).agg(F.count("*").alias(f"n_{x[3]}")) for x in (("customer", "c_custkey", "c_nationkey", "a"), ("supplier", "s_suppkey", "s_nationkey", "b")))
    pairs = left.join(right, "nation").groupBy("a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))
    return pairs.select("a", "b", spatial.compatible(F.col("a"), F.col("b")).alias("fits"), "n")


@query(
    "tier_assignment",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN 1 WHEN p_brand LIKE '%1' THEN 2 WHEN p_size >= 25 THEN 3 ELSE 4 END AS tier FROM part",
)
def tier_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), catalogue.tier(F.col("p_partkey") % 50 == 0, F.col("p_brand").endswith("1"), F.col("p_size") >= 25).alias("tier"))


@query(
    "building_heights",
    """WITH p AS (SELECT l_partkey AS id, TRY_CAST(CASE WHEN l_orderkey % 13 = 0 THEN 'n/a' ELSE (l_quantity + 100)::VARCHAR END AS DOUBLE) AS roof, nullif(CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE ELSE l_quantity END, 0) AS plinth FROM lineitem)
    SELECT id, round(max(roof) - min(plinth), 4) AS height_m FROM p GROUP BY id""",
)
def building_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest roof over lowest plinth of a building's parts; numbers are texts, a plinth of zero is unknown."""
    roof = F.when(F.col("l_orderkey") % 13 == 0, "n/a").otherwise((F.col("l_quantity") + 100).cast("string"))
    plinth = F.when(F.col("l_linenumber") == 1, "0").otherwise(F.col("l_quantity").cast("string"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), roof.alias("roof"), plinth.alias("plinth"))
    return catalogue.heights_by_building(parts, "id", "roof", "plinth").select("id", F.round("height_m", 4).alias("height_m"))


@query(
    "plausible_rows",
    """SELECT p_partkey AS id, p_size <> p_partkey % 50 AS levels_fit, CASE WHEN p_partkey % 3 = 0 OR p_size >= 0.6::DOUBLE * 20 THEN p_size END AS sample, p_name ILIKE '%red%' OR p_type LIKE 'PROMO%' AS hide, p_size >= 25 AS notable FROM part""",
)
def plausible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that aren't a floor area, samples that aren't far under a known height, bird hides by name or build, islands of a map scale."""
    p = table(spark, sf_dir, "part").withColumns({"name": F.regexp_replace("p_name", "(?i)red", "lintutorni"), "build": F.when(F.col("p_type").startswith("PROMO"), "Bird_hide")})
    known = F.when(F.col("p_partkey") % 3 != 0, F.lit(20.0))
    return p.select(
        F.col("p_partkey").alias("id"), catalogue.plausible_levels(F.col("p_size"), F.col("p_partkey") % 50).alias("levels_fit"), catalogue.trusted_sample(F.col("p_size"), known).alias("sample"),
        catalogue.is_bird_hide(F.col("name"), F.col("build")).alias("hide"), registers.notable(F.col("p_size"), 25).alias("notable"),
    )

