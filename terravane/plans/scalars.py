"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geo, text
from terravane.operators import raster
from terravane.plans import views
from terravane.plans.registry import query
from terravane.plans.views import table


def _sum(terms, kind: str, x: str, y: str, sign: str = "+") -> str:
    f, g = ("sin", "cosh") if kind == "n" else ("cos", "sinh")
    return "".join(f" {sign} {t!r}::DOUBLE * {f}({2 * j} * {x}) * {g}({2 * j} * {y})" for j, t in enumerate(terms, 1))


GRID_FORWARD = f"""WITH base AS ({views.GEO_BASE}), a AS (SELECT id, radians(lat) AS phi, radians(lon - 27.0::DOUBLE) AS dl FROM base),
b AS (SELECT *, sinh(atanh(sin(phi)) - {geo.E!r}::DOUBLE * atanh({geo.E!r}::DOUBLE * sin(phi))) AS t FROM a),
c AS (SELECT id, atan(t / cos(dl)) AS x, atanh(sin(dl) / sqrt(1 + t * t)) AS y FROM b),
g AS (SELECT id, 500000.0::DOUBLE + {geo.SCALE * geo.RECTIFYING!r}::DOUBLE * (y{_sum(geo.ALPHA, "e", "x", "y")}) AS e, {geo.SCALE * geo.RECTIFYING!r}::DOUBLE * (x{_sum(geo.ALPHA, "n", "x", "y")}) AS n FROM c)"""


@query("tm35_forward", GRID_FORWARD + " SELECT id, round(e, 3) AS e, round(n, 3) AS n FROM g")
def tm35_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = geo.to_grid(F.col("lat"), F.col("lon"))
    return views.geo_base(spark, sf_dir).select("id", F.round(e, 3).alias("e"), F.round(n, 3).alias("n"))


_INVERSE = f"""WITH pos AS (SELECT c_custkey AS id, 300000.0::DOUBLE + (c_custkey % 97) * 1500 AS e, 6700000.0::DOUBLE + (c_custkey % 89) * 2500 AS n FROM customer),
a AS (SELECT id, n / {geo.SCALE * geo.RECTIFYING!r}::DOUBLE AS xi, (e - 500000.0::DOUBLE) / {geo.SCALE * geo.RECTIFYING!r}::DOUBLE AS eta FROM pos),
b AS (SELECT id, xi{_sum(geo.BETA, "n", "xi", "eta", "-")} AS x, eta{_sum(geo.BETA, "e", "xi", "eta", "-")} AS y FROM a),
c AS (SELECT id, x, y, asin(greatest(-1, least(1, sin(x) / cosh(y)))) AS chi FROM b)
SELECT id, round(degrees(chi{"".join(f" + {t!r}::DOUBLE * sin({2 * j} * chi)" for j, t in enumerate(geo.DELTA, 1))}), 6) AS lat, round(27.0::DOUBLE + degrees(atan(sinh(y) / cos(x))), 6) AS lon FROM c"""


@query("tm35_inverse", _INVERSE)
def tm35_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    e, n = F.lit(300000.0) + k % 97 * 1500, F.lit(6700000.0) + k % 89 * 2500
    lat, lon = geo.to_degrees(e, n)
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


_F, _B = f"{geo.FLATTENING!r}::DOUBLE", f"{geo.A * (1 - geo.FLATTENING)!r}::DOUBLE"
_ARC = "bb * sin(s) * (cos(2 * start + s) + bb / 4 * (cos(s) * (2 * cos(2 * start + s) ** 2 - 1) - bb / 6 * cos(2 * start + s) * (4 * sin(s) ** 2 - 3) * (4 * cos(2 * start + s) ** 2 - 3)))"
_GEODESIC = f"""WITH base AS ({views.GEO_BASE}), a AS (SELECT id, lat, lon, radians((id * 7 % 360)::DOUBLE) AS az, atan((1 - {_F}) * tan(radians(lat))) AS u1, 1000.0::DOUBLE + id * 10 AS len FROM base),
b AS (SELECT *, atan2(tan(u1), cos(az)) AS start, cos(u1) * sin(az) AS sa, 1 - (cos(u1) * sin(az)) ** 2 AS c2 FROM a), c AS (SELECT *, c2 * ({geo.A!r}::DOUBLE ** 2 - {_B} ** 2) / {_B} ** 2 AS u2 FROM b),
d AS (SELECT *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) AS aa, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) AS bb FROM c), s0 AS (SELECT *, len / ({_B} * aa) AS plain, len / ({_B} * aa) AS s FROM d),
{", ".join(f"s{k} AS (SELECT * REPLACE (plain + {_ARC} AS s) FROM s{k - 1})" for k in range(1, 9))},
e AS (SELECT *, sin(u1) * sin(s) - cos(u1) * cos(s) * cos(az) AS x, cos(2 * start + s) AS m, {_F} / 16 * c2 * (4 + {_F} * (4 - 3 * c2)) AS c FROM s8)
SELECT id, round(degrees(atan2(sin(u1) * cos(s) + cos(u1) * sin(s) * cos(az), (1 - {_F}) * sqrt(sa * sa + x * x))), 6) AS lat,
round(lon + degrees(atan2(sin(s) * sin(az), cos(u1) * cos(s) - sin(u1) * sin(s) * cos(az)) - (1 - c) * {_F} * sa * (s + c * sin(s) * (m + c * cos(s) * (2 * m * m - 1)))), 6) AS lon, 0.0::DOUBLE AS off_m FROM e"""


@query("geodesic_round_trip", _GEODESIC)
def geodesic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vincenty's direct and inverse solution; the differences are zero to the micrometre and the microdegree."""
    base = views.geo_base(spark, sf_dir).withColumn("bearing", F.pmod(F.col("id") * 7, F.lit(360)).cast("double")).withColumn("length", 1000.0 + F.col("id") * 10)
    ends = base.withColumn("end", geo.direct("lat", "lon", "bearing", "length"))
    back = ends.withColumn("back", geo.inverse("lat", "lon", "end.lat", "end.lon"))
    return back.select("id", F.round("end.lat", 6).alias("lat"), F.round("end.lon", 6).alias("lon"), F.round(F.abs(F.col("back.metres") - F.col("length")), 5).alias("off_m"))


_R = f"{geo.effective_radius()!r}::DOUBLE"


@query(
    "elevation_angle",
    f"""WITH o AS (SELECT o_orderkey AS id, 1000.0::DOUBLE + o_custkey * 37 AS d, o_totalprice / 400 AS h FROM orders),
    e AS (SELECT *, {", ".join(f"degrees(atan2(h - 22.3::DOUBLE - d * d / (2 * {geo.effective_radius(k)!r}::DOUBLE), d)) AS a{i}" for i, k in enumerate((0.07, 0.13, 0.25)))} FROM o)
    SELECT id, round(d * d / (2 * {_R}), 4) AS fall, round(a1, 6) AS angle, CASE WHEN a0 > 0.05::DOUBLE THEN 'solid' WHEN a1 > 0.05::DOUBLE THEN 'normal' WHEN a2 > 0.05::DOUBLE THEN 'marginal' ELSE 'mirage' END AS state FROM e""",
)
def elevation_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.lit(1000.0) + F.col("o_custkey") * 37).alias("d"), (F.col("o_totalprice") / 400).alias("h"))
    eye, d, h = F.lit(22.3), F.col("d"), F.col("h")
    return o.select("id", F.round(geo.drop(d), 4).alias("fall"), F.round(geo.elevation(h, eye, d), 6).alias("angle"), geo.refraction_state(h, eye, d, F.lit(0.05)).alias("state"))


@query(
    "best_tangent_bound",
    f"""WITH e AS (SELECT event_id AS id, value - 50 AS c, 500.0::DOUBLE + event_id % 1000 * 20 AS near FROM events)
    SELECT id, round(CASE WHEN c < 0 THEN c / least(greatest(near, sqrt(2 * {_R} * -c)), near + 5000) - least(greatest(near, sqrt(2 * {_R} * -c)), near + 5000) / (2 * {_R}) ELSE c / near - near / (2 * {_R}) END, 9) AS bound,
           round(-sqrt(2 * greatest(0.5::DOUBLE, c) / {_R}), 9) AS dip FROM e""",
)
def best_tangent_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") - 50).alias("c"), (F.lit(500.0) + F.col("event_id") % 1000 * 20).alias("near"))
    bound = geo.best_tangent(F.col("c"), F.lit(0.0), F.col("near"), F.col("near") + 5000)
    return e.select("id", F.round(bound, 9).alias("bound"), F.round(geo.dip_tangent(F.col("c")), 9).alias("dip"))


@query(
    "parse_leading_number",
    r"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_size || ',5 m' WHEN 1 THEN p_retailprice::VARCHAR WHEN 2 THEN 'NIL' WHEN 3 THEN '-' || p_size || ';61' ELSE p_name END AS s FROM part)
    SELECT id, TRY_CAST(nullif(regexp_extract(replace(s, ',', '.'), '^\s*(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS leading,
           CASE WHEN regexp_matches(trim(replace(s, ',', '.')), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST(trim(replace(s, ',', '.')) AS DOUBLE) END AS whole FROM t""",
)
def parse_leading_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    s = F.when(kind == 0, F.concat(F.lit(" "), size, F.lit(",5 m"))).when(kind == 1, F.col("p_retailprice").cast("string")).when(kind == 2, "NIL").when(kind == 3, F.concat(F.lit("-"), size, F.lit(";61"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.leading_number(s).alias("leading"), text.strict_number(s).alias("whole"))


@query(
    "kv_first_wins",
    """SELECT p_partkey AS id, p_size::VARCHAR AS height, nullif(p_brand, '') AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS late, 3 + (p_partkey % 2 = 0)::INT AS n FROM part""",
)
def kv_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(", late : "), F.col("p_type"))).otherwise(F.lit(""))
    s = F.concat(F.lit("height: "), F.col("p_size"), F.lit(", brand : "), F.col("p_brand"), F.lit("\\nheight: 0, empty: , no colon"), late)
    kv = text.key_values(s)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.try_element_at(kv, F.lit(k)).alias(k) for k in ("height", "brand", "late")), F.size(kv).alias("n"))


_ENDINGS = sorted(text.KIND_ENDINGS, key=len, reverse=True)


@query(
    "kind_suffix",
    f"""WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'Pukinparta' ELSE 'Kallio' || list_extract([{", ".join(f"'{e}'" for e in text.KIND_ENDINGS)}], (p_partkey % {len(text.KIND_ENDINGS)} + 1)::INT) || '.' END AS name FROM part)
    SELECT id, CASE {" ".join(f"WHEN ends_with(rtrim(lower(name), '.'), '{e}') THEN '{e}'" for e in _ENDINGS)} END AS kind FROM n""",
)
def kind_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ending = F.element_at(F.array(*map(F.lit, text.KIND_ENDINGS)), (k % len(text.KIND_ENDINGS) + 1).cast("int"))
    name = F.when(k % 7 == 0, "Pukinparta").otherwise(F.concat(F.lit("Kallio"), ending, F.lit(".")))
    return table(spark, sf_dir, "part").select(k.alias("id"), text.kind_of(name).alias("kind"))


@query("regex_tag_extract", r"SELECT page_id AS id, nullif(regexp_extract(html, '<(?:\w+:)?title(?:\s[^>]*)?>(.*?)</(?:\w+:)?title>', 1, 's'), '') AS title, len(regexp_extract_all(html, '<p[ >]')) AS n_p FROM pages")
def regex_tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.tag(F.col("html"), "title").alias("title"), F.coalesce(F.regexp_count("html", F.lit("<p[ >]")), F.lit(0)).cast("long").alias("n_p"))


@query("json_tags_filter", "SELECT event_id AS id, event_type, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT >= 25 AND event_type <> 'click'")
def json_tags_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").where(k >= 25).where("event_type <> 'click'").select(F.col("event_id").alias("id"), "event_type", k.alias("k"))


@query("source_age_days", "SELECT event_id AS id, round((epoch(TIMESTAMP '2030-01-01') - floor(epoch(ts))) / 86400.0::DOUBLE, 7) AS days FROM events")
def source_age_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    now = F.to_timestamp(F.lit("2030-01-01 00:00:00"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(text.age_days(stamp, now), 7).alias("days"))


@query("quantise_saturate", "SELECT o_orderkey AS id, greatest(-32767, least(32767, round_even((o_totalprice / 10)::DOUBLE * 4, 0)))::INT AS q FROM orders")
def quantise_saturate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raster.quantise(F.col("o_totalprice") / 10).alias("q"))
