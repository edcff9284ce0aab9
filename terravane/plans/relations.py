"""Queries of joins, aggregates, set operations and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions import geo, text
from terravane.operators import catalogue, fuse, labels, order, spatial, terrain
from terravane.plans import views
from terravane.plans.registry import query
from terravane.plans.views import GEO_BASE, GEO_IN, METRES, PAIRS, table
from terravane.sources import registers, sinks


def _pairs(spark: SparkSession, sf_dir: str, radius: float = 150.0) -> DataFrame:
    return spatial.range_join(views.geo_in(spark, sf_dir), views.geo_base(spark, sf_dir), radius)


_FITS = "(ah IS NULL OR bh IS NULL OR abs(ah - bh) <= greatest(10.0::DOUBLE, 0.15::DOUBLE * greatest(ah, bh)))"


@query(
    "catalogue_report",
    f"""WITH {PAIRS}, hit AS (SELECT a_id, min(round(dd, 3)) AS d FROM pairs WHERE {_FITS} GROUP BY a_id)
    SELECT coalesce(b.nation::VARCHAR, 'TOTAL') AS cat, count(*) AS n, count(height_m) AS n_height, count(h.d) AS n_matched, round(min(h.d), 3) AS closest
    FROM inc b LEFT JOIN hit h ON b.id = h.a_id GROUP BY ROLLUP (b.nation)""",
)
def catalogue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming objects by category with a total: how many there are and how many have a compatible neighbour."""
    fits = _pairs(spark, sf_dir).where(spatial.heights_agree(F.col("a_height_m"), F.col("b_height_m")))
    hit = spatial.nearest(fits).select(F.col("a_id").alias("id"), "d")
    rows = views.geo_in(spark, sf_dir).join(hit, "id", "left")
    total = rows.rollup("nation").agg(F.count("*").alias("n"), F.count("height_m").alias("n_height"), F.count("d").alias("n_matched"), F.min("d").alias("closest"))
    return total.select(F.coalesce(F.col("nation").cast("string"), F.lit("TOTAL")).alias("cat"), "n", "n_height", "n_matched", "closest")


@query("grid_range_join", f"WITH {PAIRS} SELECT a_id, b_id, round(dd, 3) AS d FROM pairs WHERE {_FITS}")
def grid_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = spatial.heights_agree(F.col("a_height_m"), F.col("b_height_m"))
    return _pairs(spark, sf_dir).where(fits).select("a_id", "b_id", F.round("d", 3).alias("d"))


@query("nearest_neighbour", f"WITH {PAIRS} SELECT a_id, b_id, d FROM (SELECT a_id, b_id, round(dd, 3) AS d, row_number() OVER (PARTITION BY a_id ORDER BY round(dd, 3), b_id) AS k FROM pairs) WHERE k = 1")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(_pairs(spark, sf_dir))


@query(
    "rival_claim",
    f"""WITH p AS ({views.PLACES}), f AS (SELECT id, x + 40 AS x, y - 30 AS y, 50.0::DOUBLE + id % 80 AS own FROM p), g AS (SELECT f.id, q.id AS rival, sqrt((f.x - q.x) ** 2 + (f.y - q.y) ** 2) AS gap, own FROM f JOIN p q ON q.id <> f.id)
    SELECT id, arg_min(rival, gap) AS rival FROM g WHERE gap < own GROUP BY id""",
)
def rival_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other name that is strictly closer to a summit than its own."""
    places = views.places(spark, sf_dir)
    found = places.select("id", (F.col("x") + 40).alias("x"), (F.col("y") - 30).alias("y"), (F.lit(50.0) + F.col("id") % 80).alias("own"))
    return terrain.rivals(found, places)


@query("pair_threshold_counts", f"WITH {PAIRS} SELECT r AS radius, count(*) FILTER (dd < r) AS n FROM pairs, (SELECT unnest([30, 50, 60, 100, 150]) AS r) GROUP BY r")
def pair_threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    radii = [30, 50, 60, 100, 150]
    counts = _pairs(spark, sf_dir).agg(*(F.count_if(F.col("d") < r).alias(str(r)) for r in radii))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("radius"), F.col(f"`{r}`").alias("n")) for r in radii))).alias("x")).select("x.*")


@query(
    "wrap32_join",
    """WITH h AS (SELECT l_partkey AS id, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS height FROM lineitem GROUP BY 1)
    SELECT p_partkey AS id, p_name AS name, height FROM part LEFT JOIN h ON p_partkey = id""",
)
def wrap32_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with signed ids and heights with unsigned ones: the last height of an id counts."""
    signed = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") - 2**31).otherwise(F.col("p_partkey"))
    unsigned = F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey") - 2**31 + 2**32).otherwise(F.col("l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select(text.wrap32(unsigned).alias("k"), F.col("l_quantity").alias("height"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), signed.alias("k"))
    return points.join(fuse.last_by(rows, "k", "height", "seq"), "k", "left").select("id", "name", "height")


@query("anti_resume", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that has no result yet."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return sinks.resume(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), done, "id")


@query(
    "semi_claimants",
    """WITH keep AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 5000), claims AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 1500 IN (SELECT id FROM keep))
    SELECT id, false AS claimant FROM keep UNION ALL SELECT c_custkey, true FROM customer WHERE c_custkey IN (SELECT id FROM claims) AND c_custkey NOT IN (SELECT id FROM keep)""",
)
def semi_claimants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the chosen tier, then those below it that own the summit of one that is chosen."""
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor("c_acctbal").alias("sr"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    summits = urgent.select((F.col("o_orderkey") % 1500).alias("id"), F.col("o_custkey").alias("claimed"))
    return registers.selected(places, summits, 5000).select("id", (F.col("sr") < 5000).alias("claimant"))


@query("position_key_join", f"WITH base AS ({GEO_BASE}) SELECT a.id AS id, count(*) AS n_same FROM base a JOIN base b ON printf('%.6f,%.6f', a.lat, a.lon) = printf('%.6f,%.6f', b.lat, b.lon) GROUP BY 1")
def position_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = views.geo_base(spark, sf_dir).select("id", catalogue.position_key(F.col("lat"), F.col("lon")).alias("key"))
    counts = base.groupBy("key").agg(F.count("*").alias("n_same"))
    return base.join(counts, "key").select("id", "n_same")


_TYPES = "['tower', 'mast', 'communications_tower', 'chimney', 'water_tower', 'lighthouse', 'flagpole']"
_TOWER_TYPES = "['observation', 'bell_tower', 'communication', 'lighting', 'cooling']"


@query(
    "category_map",
    f"""WITH t AS (SELECT p_partkey AS id, p_size, list_extract({_TYPES}, (p_partkey % 7 + 1)::INT) AS kind, list_extract({_TOWER_TYPES}, (p_partkey % 5 + 1)::INT) AS tower, p_partkey % 11 = 0 AS wind FROM part),
    c AS (SELECT *, CASE WHEN wind THEN 'turbine' WHEN kind = 'tower' THEN CASE tower WHEN 'observation' THEN 'obstower' WHEN 'bell_tower' THEN 'belltower' WHEN 'communication' THEN 'mast' ELSE 'obstower' END
     WHEN kind IN ('mast', 'communications_tower') THEN 'mast' WHEN kind = 'chimney' THEN 'chimney' WHEN kind = 'water_tower' THEN 'watertower' WHEN kind = 'lighthouse' THEN 'lighthouse' END AS cat FROM t WHERE tower <> 'lighting')
    SELECT id, cat, CASE WHEN id % 2 = 0 THEN p_size * 1.0::DOUBLE WHEN cat = 'turbine' AND p_size > 0 THEN round((p_size + 0.3::DOUBLE) * 1.43::DOUBLE, 1) END AS height FROM c WHERE cat IS NOT NULL""",
)
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and heights from an object's tags: lighting towers go, a turbine's hub stands for its missing height."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    tags = {
        "man_made": pick(("tower", "mast", "communications_tower", "chimney", "water_tower", "lighthouse", "flagpole"), 7), "tower:type": pick(("observation", "bell_tower", "communication", "lighting", "cooling"), 5),
        "generator:source": F.when(k % 11 == 0, "wind"), "height": F.when(k % 2 == 0, F.concat(size, F.lit(" m"))), "height:hub": F.when(F.col("p_size") > 0, F.concat(size, F.lit(".3"))),
    }
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.create_map(*(x for n, v in tags.items() for x in (F.lit(n), v))).alias("tags"))
    return registers.categorised(rows).select("id", "cat", F.round("height", 2).alias("height"))


@query("histogram_topk", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent values; equal counts by value."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(8)


@query("upper_median", "SELECT seg AS cat, max(v) AS median FROM (SELECT c_mktsegment AS seg, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS k, count(*) OVER (PARTITION BY c_mktsegment) // 2 AS m FROM customer WHERE c_acctbal IS NOT NULL) WHERE k = m GROUP BY 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at place n / 2 of the sorted ones, by ranges that are looked into again and again."""
    rows = table(spark, sf_dir, "customer").where("c_acctbal IS NOT NULL").select(F.col("c_mktsegment").alias("cat"), F.col("c_acctbal").alias("median"))
    places = rows.groupBy("cat").agg(F.floor(F.count("*") / 2).alias("place"))
    return order.selected(rows, ["cat"], "median", places).select("cat", "median")


@query("cumulative_tiers", "SELECT p_size AS tier, sum(count(*)) OVER (ORDER BY p_size DESC)::BIGINT AS n FROM part GROUP BY p_size")
def cumulative_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each tier and all above it; the window is over tiers, not rows."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("tier")).agg(F.count("*").alias("c"))
    return counts.select("tier", F.sum("c").over(Window.orderBy(F.desc("tier"))).alias("n"))


@query("group_having_cells", f"WITH base AS ({GEO_BASE}) SELECT round(lat * 1000)::BIGINT AS i, round(lon * 1000)::BIGINT AS j, count(*) AS n, min(id) AS first_id FROM base GROUP BY 1, 2 HAVING count(*) > 1 OR min(id) % 2 = 0")
def group_having_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = views.geo_base(spark, sf_dir).select("id", F.round(F.col("lat") * 1000).cast("long").alias("i"), F.round(F.col("lon") * 1000).cast("long").alias("j"))
    return base.groupBy("i", "j").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1 OR first_id % 2 = 0")


@query("lang_explode_count", "SELECT lang, count(*) AS n FROM (SELECT unnest(list_concat([lang], CASE WHEN n_chars % 2 = 0 THEN [source] ELSE [] END)) AS lang FROM documents) GROUP BY lang")
def lang_explode_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all names; places have one or two."""
    one, two = F.struct(F.col("lang")), F.struct(F.col("source").alias("lang"))
    names = F.when(F.col("n_chars") % 2 == 0, F.array(one, two)).otherwise(F.array(one))
    return registers.languages(table(spark, sf_dir, "documents").select(names.alias("names")))


@query("mark_order", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey END, c_custkey)::BIGINT AS place FROM customer WHERE c_custkey <= 9 OR c_custkey % 9 <> 0")
def mark_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks by collection and id, a missing id first: their places."""
    rows = table(spark, sf_dir, "customer").where("c_custkey <= 9 OR c_custkey % 9 <> 0")
    marks = rows.select("c_custkey", F.col("c_mktsegment").alias("_collection"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey")).alias("id"))
    placed = order.numbered(registers.in_order(marks), "_collection", F.coalesce("id", F.lit(0)), "c_custkey", number="place")
    return placed.select(F.col("c_custkey").alias("id"), F.col("place").cast("long").alias("place"))


@query("sparse_records", """SELECT s_suppkey AS id, '{"id":' || s_suppkey || ',"name":"' || s_name || '"' || CASE WHEN s_suppkey % 2 = 0 THEN ',"rank":' || s_nationkey ELSE '' END || '}' AS record FROM supplier""")
def sparse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without their nulls, as JSON."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("rank"))
    return rows.select("id", sinks.sparse(["id", "name", "rank"]).alias("record"))


@query(
    "name_ranking",
    """WITH n AS (SELECT s_nationkey AS nat, s_name AS name, s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN '1' END AS dom, CASE WHEN s_acctbal > 0 THEN '1' ELSE '2' END AS off, CASE WHEN s_suppkey % 2 = 0 THEN 'fin' ELSE 'swe' END AS lang FROM supplier)
    SELECT nat AS nation, string_agg(name, '|' ORDER BY coalesce(dom <> '1', true), off <> '1', lang <> 'fin', k) AS names FROM n GROUP BY 1""",
)
def name_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of a place in the order of preference: dominant, official, Finnish, as they came."""
    k = F.col("s_suppkey")
    name = F.struct(k.alias("i"), F.col("s_name").alias("n"), F.when(k % 2 == 0, "fin").otherwise("swe").alias("lang"), F.when(F.col("s_acctbal") > 0, "1").otherwise("2").alias("off"), F.when(k % 3 == 0, "1").alias("dom"))
    held = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(name)).alias("names"))
    return held.select("nation", F.array_join(F.transform(registers.ranked(F.col("names")), lambda x: x["n"]), "|").alias("names"))


@query("union_missing_columns", "SELECT s_suppkey AS id, 'supplier' AS src, s_acctbal AS height_m, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, 'customer', NULL, c_mktsegment FROM customer")
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("src"), F.col("s_acctbal").alias("height_m"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("src"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("provenance_union", "SELECT o_custkey AS id, string_agg(DISTINCT o_orderstatus, '+' ORDER BY o_orderstatus) AS srcs FROM orders WHERE o_orderstatus <> '' GROUP BY 1")
def provenance_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderstatus").alias("s"))
    return sets.select("id", fuse.provenance(F.col("s")).alias("srcs"))


@query(
    "focal_fallback_chain",
    """WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 * 4.5::DOUBLE END AS agl, CASE WHEN s_suppkey % 5 = 0 THEN 9.25::DOUBLE END AS day, s_suppkey * 0.5::DOUBLE AS water, s_suppkey % 4 * 1.0::DOUBLE AS ground FROM supplier),
    f AS (SELECT *, coalesce(nullif(agl, 0), day) AS above, CASE WHEN ground <= 2 THEN water END AS low FROM s)
    SELECT id, round(coalesce(above, low), 1) AS height, CASE WHEN above IS NOT NULL THEN 'agl' WHEN low IS NOT NULL THEN 'water' END AS basis FROM f""",
)
def focal_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    agl, day = F.when(k % 3 == 0, k % 2 * F.lit(4.5)), F.when(k % 5 == 0, F.lit(9.25))
    height, basis = fuse.focal_height(agl, day, k * F.lit(0.5), (k % 4).cast("double"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), height.alias("height"), basis.alias("basis"))


@query(
    "height_priority_fuse",
    """SELECT o_custkey AS id, arg_max(o_totalprice, rank * 1000000000::BIGINT - o_orderkey) AS height, max(rank) AS trust FROM
    (SELECT o_custkey, o_totalprice, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS rank FROM orders) GROUP BY 1""",
)
def height_priority_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The height of the most trusted source, of equals the first."""
    source = F.when(F.col("o_orderstatus") == "F", "mtk").when(F.col("o_orderstatus") == "O", "vayla").when(F.col("o_orderstatus") == "P", "osm")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_totalprice", "o_orderkey", fuse.trust(source).alias("trust"))
    return rows.groupBy("id").agg(F.max_by("o_totalprice", F.struct("trust", -F.col("o_orderkey"))).alias("height"), F.max("trust").alias("trust"))


def _layer(df: DataFrame, cat: str, source: str, start: int) -> DataFrame:
    return df.select(
        (F.col("id") + start).alias("id"), (F.col("id") + start).alias("seq"), F.lit(cat).alias("cat"), "lat", "lon",
        (F.col("height_m") / 50).alias("height_m"), F.lit(source).alias("src_h"), "name", F.array(F.lit(source)).alias("srcs"),
    )


@query("spatial_merge")
def spatial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of objects merged; tests hold it against the sequential rule."""
    base = _layer(views.geo_base(spark, sf_dir), "obstower", "osm", 0)
    incoming = _layer(views.geo_in(spark, sf_dir), "building", "aip", 1 << 40)
    out = fuse.merge(base, incoming, 150.0)
    return out.select("id", "cat", F.round("height_m", 2).alias("height_m"), "src_h", "name", fuse.provenance(F.col("srcs")).alias("srcs"))


@query("merge_conflicts")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows merged because they are nearer than 15 m although heights disagree, with what they went into; tests hold it against the sequential rule."""
    base = _layer(views.geo_base(spark, sf_dir), "obstower", "osm", 0)
    incoming = _layer(views.geo_in(spark, sf_dir).withColumn("lat", F.col("lat") + F.lit(0.00003)), "building", "aip", 1 << 40)
    _, noted = fuse.merge_noting(base, incoming, 150.0)
    return noted.select("id", "into", F.round("d", 3).alias("d"), F.round("height_m", 2).alias("height_m"), F.round("into_height_m", 2).alias("into_height_m"))


@query("colocated_collapse")
def colocated_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, fuse.MARK_RANK))
    k = F.col("id")
    marks = views.geo_base(spark, sf_dir).select(
        "id", "lat", "lon", F.element_at(kinds, (k % len(fuse.MARK_RANK) + 1).cast("int")).alias("vayla_type"),
        F.when(k % 2 == 0, F.col("height_m")).alias("focal_m"), F.when(k % 3 == 0, F.col("height_m")).alias("focal_agl_m"), F.lit(None).cast("double").alias("daymark_agl_m"), "name", k.alias("vayla_id"),
    )
    return fuse.collapse(marks).select("id", "vayla_type", "focal_m", "focal_agl_m", "name")


@query(
    "farm_components",
    f"""WITH RECURSIVE inc AS ({GEO_IN}), pos AS (SELECT lat, lon, min(id) AS id FROM inc GROUP BY ALL), near AS (SELECT a.id AS x, b.id AS y FROM pos a JOIN pos b ON {METRES} <= 150),
    reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x),
    low AS (SELECT x, min(y) AS farm FROM reach GROUP BY x)
    SELECT i.id, farm FROM inc i JOIN pos p ON i.lat = p.lat AND i.lon = p.lon JOIN low ON p.id = x""",
)
def farm_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-link clusters of sites; sites at one position are one point."""
    sites = views.geo_in(spark, sf_dir)
    spots = sites.groupBy("lat", "lon").agg(F.min("id").alias("spot"))
    farms = labels.farms(spots.select(F.col("spot").alias("id"), "lat", "lon"), 150.0, spatial.CELL_DEG)
    return sites.join(spots, ["lat", "lon"]).join(farms.withColumnRenamed("id", "spot"), "spot").select("id", "farm")


_TURN = "((x - n.b + 180) % 360 + 360) % 360 - 180"


@query(
    "label_budget",
    f"""WITH RECURSIVE base AS ({GEO_BASE}), n AS (SELECT nation AS observer, id, (id * 37 % 360)::DOUBLE AS b, height_m AS size, row_number() OVER (PARTITION BY nation ORDER BY height_m DESC, id) AS k FROM base),
    f AS (SELECT observer, 0::BIGINT AS k, CAST([] AS DOUBLE[]) AS kept, NULL::BIGINT AS id, true AS crammed FROM (SELECT DISTINCT observer FROM n) UNION ALL
      SELECT observer, k, CASE WHEN crammed THEN kept ELSE list_append(kept, b) END, id, crammed FROM (
        SELECT *, len(list_filter(list_concat(list_filter(near, lambda x: x <= 0), list_transform(list_filter(near, lambda x: x >= 0), lambda x: x - 10)), lambda lo: len(list_filter(near, lambda a: a >= lo AND a <= lo + 10)) >= 3)) > 0 AS crammed FROM (
          SELECT n.observer, n.k, n.id, n.b, f.kept, list_filter([{_TURN} for x in f.kept], lambda x: abs(x) <= 10) AS near FROM f JOIN n ON n.observer = f.observer AND n.k = f.k + 1)))
    SELECT n.observer, n.id, n.b AS bearing, n.size FROM f JOIN n ON n.observer = f.observer AND n.id = f.id WHERE NOT f.crammed""",
)
def label_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three labels in any ten degrees around each of a few observers."""
    seen = views.geo_base(spark, sf_dir).select(F.col("nation").alias("observer"), "id", F.pmod(F.col("id") * 37, F.lit(360)).cast("double").alias("bearing"), F.col("height_m").alias("size"))
    return labels.budget(seen)


@query(
    "flat_metres",
    f"WITH inc AS ({GEO_IN}), base AS ({GEO_BASE}) SELECT a.id AS id, round({METRES}, 3) AS d FROM inc a JOIN base b ON a.id = b.id",
)
def flat_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = views.geo_in(spark, sf_dir).alias("a"), views.geo_base(spark, sf_dir).alias("b")
    d = geo.flat_metres(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, F.col("a.id") == F.col("b.id")).select(F.col("a.id").alias("id"), F.round(d, 3).alias("d"))
