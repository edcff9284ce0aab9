"""Registers of objects and place names, read into one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geo, text
from terravane.operators import fuse
from terravane.sources import archive

FOOT_M = 0.3048
# Categories of the registers' types.
OBSTACLES = {"Mast": "mast", "Chimney": "chimney", "Wind turbine": "turbine", "Tower": "obstower", "Building": "building"}
MAN_MADE = {"mast": "mast", "communications_tower": "mast", "chimney": "chimney", "water_tower": "watertower", "lighthouse": "lighthouse", "tower": "obstower"}
TOWERS = {"observation": "obstower", "lookout": "obstower", "communication": "mast", "bell_tower": "belltower"}
HUB_TO_TIP = 1.43
TOWER_MARKS = ("Merimajakka", "Tunnusmajakka", "Reunamerkki")
TAIL_MARKS = ("Linjamerkki", "Sektoriloisto", "Tutkamerkki", "Apuloisto", "Suuntaloisto")
TAIL_LEAST_M = 20.0
# Elements that an extract of structures or of buildings has at least, and its greatest age in days.
LEAST_STRUCTURES, LEAST_BUILDINGS, MOST_DAYS = 1000, 200, 45.0
WATER, LIGHT_AGL, MARK_AGL = "Korkeus vedestä", "Korkeus maasta", "Korkeus maasta (m)"
PLACE_TYPES = ("1010210", "1010205")
PLACE_END = "</gml:featureMember>"


def _mapped(value, names: dict[str, str]):
    return F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in names.items()))


def obstacles(spark: SparkSession, path: str) -> DataFrame:
    """The obstacle register: a file of semicolons, in feet. Rows of other types or without numbers are left out."""
    rows = spark.read.csv(path, sep=";", header=True)
    number = lambda c: F.trim(F.col(f"`{c}`")).try_cast("double")
    agl, msl = number("HGT AGL (FT)") * FOOT_M, number("ELEV MSL (FT)") * FOOT_M
    found = rows.select(
        _mapped(F.trim("TYPE"), OBSTACLES).alias("cat"), number("LAT").alias("lat"), number("LONG").alias("lon"),
        F.round(agl, 1).alias("height_m"), F.round(msl - agl, 1).alias("ground_m"), F.lit("aip").alias("src_h"), F.lit("aip").alias("src_pos"),
        text.leading_number(F.col("`Horizontal accuracy (m)`")).alias("acc_m"), F.coalesce(F.trim("`OBST ID`"), F.lit("")).alias("obst_id"),
    )
    return found.dropna(subset=["cat", "lat", "lon", "height_m", "ground_m"])


OSM_SCHEMA = """osm3s struct<timestamp_osm_base: string>, elements array<struct<lat: double, lon: double,
 center: struct<lat: double, lon: double>, tags: map<string, string>>>"""


def _elements(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(OSM_SCHEMA).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    # A latitude of zero counts as missing, as an absent one does.
    place = lambda c: F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit(0.0)), F.col(f"e.center.{c}"))
    return rows.select(place("lat").alias("lat"), place("lon").alias("lon"), F.coalesce("e.tags", F.create_map().cast("map<string, string>")).alias("tags")).dropna(subset=["lat", "lon"])


def checked(spark: SparkSession, path: str, least: int = 0, most_days: float | None = None) -> None:
    """Raise if a map extract has fewer elements than expected, or is older than so many days; one that doesn't say its age counts as old."""
    found = _elements(spark, path).count()
    if found < least:
        raise ValueError(f"{path}: {found} elements with a position, at least {least} are expected")
    if most_days is not None:
        age = snapshot_age(spark, path)
        if age is None or age > most_days:
            raise ValueError(f"{path}: {'of unknown age' if age is None else f'{age:.1f} days old'}, at most {most_days} are allowed")


def _tag(name: str):
    return F.try_element_at("tags", F.lit(name))


def categorised(rows: DataFrame) -> DataFrame:
    """rows with tags, of structures alone, with cat and height: lighting towers are left out, wind counts before the kind, and a turbine's hub stands for its missing height."""
    kind, tower = _tag("man_made"), F.coalesce(_tag("tower:type"), F.lit(""))
    cat = F.when(_tag("generator:source") == "wind", "turbine").when(kind == "tower", F.coalesce(_mapped(tower, TOWERS), F.lit("obstower"))).otherwise(_mapped(kind, MAN_MADE))
    found = rows.where(tower != "lighting").withColumn("cat", cat).where("cat IS NOT NULL")
    hub = F.nullif(text.leading_number(_tag("height:hub")), F.lit(0.0))
    return found.withColumn("height", F.coalesce(text.leading_number(_tag("height")), F.when(F.col("cat") == "turbine", F.round(hub * HUB_TO_TIP, 1))))


def structures(spark: SparkSession, path: str, least: int = 0, most_days: float | None = None) -> DataFrame:
    """Tall structures of a map extract, see categorised; the extract is checked first."""
    checked(spark, path, least, most_days)
    height = F.col("height")
    return categorised(_elements(spark, path)).select("cat", "lat", "lon", height.alias("height_m"), F.when(height != 0, "osm").alias("src_h"), _tag("name").alias("name"), F.lit("osm").alias("src_pos"))


def buildings(spark: SparkSession, path: str, least: int = 0, most_days: float | None = None) -> DataFrame:
    """Buildings of at least 25 m or 8 levels; the extract is checked first."""
    checked(spark, path, least, most_days)
    height = text.leading_number(F.coalesce(F.nullif(_tag("height"), F.lit("")), _tag("building:height")))
    levels = text.leading_number(_tag("building:levels"))
    rows = _elements(spark, path).where(_tag("building").isNotNull()).where(F.coalesce(height >= 25, F.lit(False)) | F.coalesce(levels >= 8, F.lit(False)))
    return rows.select(F.lit("building").alias("cat"), "lat", "lon", height.alias("height_m"), F.when(height != 0, "osm").alias("src_h"), _tag("name").alias("name"), F.lit("osm").alias("src_pos"), levels.alias("levels"))


def snapshot_age(spark: SparkSession, path: str) -> float | None:
    """Days since a map extract was made; null if it doesn't say."""
    stamp = spark.read.schema(OSM_SCHEMA).json(path, multiLine=True).select("osm3s.timestamp_osm_base")
    return stamp.select(text.age_days(F.col("timestamp_osm_base"), F.current_timestamp()).alias("d")).first()["d"]


SEA_MARKS = """id bigint, turvalaitenumero bigint, turvalaitetyyppifi string, nimifi string, nimisv string, loistojen_tiedot string,
 paivatunnusten_tiedot string, toimintatilakoodi int, omistajafi string, _collection string, _lonlat array<double>"""


FEATURES = """features array<struct<properties: struct<id: bigint, turvalaitenumero: bigint, turvalaitetyyppifi: string, nimifi: string, nimisv: string,
 loistojen_tiedot: string, paivatunnusten_tiedot: string, toimintatilakoodi: int, omistajafi: string>, geometry: struct<type: string, coordinates: string>>>"""


def sea_mark_features(spark: SparkSession, collections: dict[str, str], kinds: tuple[str, ...] = TOWER_MARKS + TAIL_MARKS) -> DataFrame:
    """Feature collections (name to path) as rows of SEA_MARKS: those of the kinds, at their point or the first of their points.

    Features without a position are left out. In the order of collection and id, a missing id first.
    """
    found = None
    for name, path in collections.items():
        rows = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f")).where(F.col("f.properties.turvalaitetyyppifi").isin(*kinds))
        # A point has two numbers, several points have lists of them.
        one, many = F.from_json("f.geometry.coordinates", "array<double>"), F.from_json("f.geometry.coordinates", "array<array<double>>")
        at = F.when(F.col("f.geometry.type") == "MultiPoint", F.get(many, 0)).otherwise(one)
        rows = rows.select("f.properties.*", F.lit(name).alias("_collection"), at.alias("_lonlat")).where(F.size("_lonlat") >= 2)
        found = rows if found is None else found.unionByName(rows)
    return in_order(found)


def sea_marks(spark: SparkSession, path: str, least: float = TAIL_LEAST_M) -> DataFrame:
    """Sea marks of a file of SEA_MARKS that are towers, see tower_marks; one for each place (fuse.collapse)."""
    return fuse.collapse(tower_marks(spark.read.schema(SEA_MARKS).json(path), least))


def tower_marks(rows: DataFrame, least: float = TAIL_LEAST_M) -> DataFrame:
    """Sea marks (SEA_MARKS) that are towers: some kinds always, others from a height above their own ground."""
    light, day = text.key_values(F.col("loistojen_tiedot")), text.key_values(F.col("paivatunnusten_tiedot"))
    number = lambda m, k: text.strict_number(F.try_element_at(m, F.lit(k)))
    kind = F.col("turvalaitetyyppifi")
    rows = rows.withColumn("focal_m", F.coalesce(number(light, WATER), number(day, WATER))).withColumn("focal_agl_m", number(light, LIGHT_AGL)).withColumn("daymark_agl_m", number(day, MARK_AGL))
    stands = F.greatest("focal_agl_m", "daymark_agl_m")
    chosen = rows.where(kind.isin(*TOWER_MARKS) | (kind.isin(*TAIL_MARKS) & (stands >= least))).where(F.size("_lonlat") >= 2)
    name = F.nullif(F.trim(F.coalesce(F.nullif("nimifi", F.lit("")), F.col("nimisv"))), F.lit(""))
    return chosen.select(
        F.lit("lighthouse").alias("cat"), F.round(F.col("_lonlat")[1], 7).alias("lat"), F.round(F.col("_lonlat")[0], 7).alias("lon"), name.alias("name"),
        "focal_m", "focal_agl_m", "daymark_agl_m", kind.alias("vayla_type"), F.coalesce("turvalaitenumero", "id").alias("vayla_id"),
        (F.col("toimintatilakoodi") == 1).alias("in_service"), F.col("omistajafi").alias("owner"), F.lit("vayla").alias("src_pos"), "id",
    )


def with_focal_heights(objects: DataFrame) -> DataFrame:
    """objects whose missing heights are filled from their lights, with h_basis saying which."""
    height, basis = fuse.focal_height(F.col("focal_agl_m"), F.col("daymark_agl_m"), F.col("focal_m"), F.col("ground_m"))
    fills = F.col("vayla_id").isNotNull() & F.col("height_m").isNull() & height.isNotNull()
    filled = objects.withColumn("fills", fills).withColumn("h_basis", F.when(fills, basis)).withColumn("height_m", F.when(fills, height).otherwise(F.col("height_m")))
    return filled.withColumn("src_h", F.when(F.col("fills"), "vayla").otherwise(F.col("src_h"))).drop("fills")


def ranked(names: Column) -> Column:
    """Names (n, lang, off, dom) in the order of preference: locally dominant, official, Finnish, as they came."""
    rank = lambda a: F.struct(~a["dom"].eqNullSafe("1"), ~a["off"].eqNullSafe("1"), ~a["lang"].eqNullSafe("fin"))
    return F.transform(F.array_sort(F.transform(names, lambda a, i: F.struct(rank(a).alias("rank"), i.alias("i"), a.alias("name")))), lambda o: o["name"])


def places(spark: SparkSession, path: str) -> DataFrame:
    """The gazetteer, plain or zipped: one row for each place of the chosen types with a position and a name; the first name counts most."""
    zipped = path.endswith(".zip")
    raw = archive.zip_records(spark, path, PLACE_END, ".xml", PLACE_TYPES) if zipped else spark.read.text(path, lineSep=PLACE_END)
    raw = raw.select(F.col("value").alias("x"))
    x, field = F.col("x"), lambda n: text.tag(F.col("x"), n)
    raw = raw.where(x.contains(PLACE_TYPES[0]) | x.contains(PLACE_TYPES[1])).where(field("placeType").isin(*PLACE_TYPES))
    parts = F.regexp_extract_all(x, F.lit(r"(?s)<(?:\w+:)?Name(?:\s[^>]*)?>(.*?)</(?:\w+:)?Name>"), F.lit(1))
    name = lambda p: F.struct(text.tag(p, "spelling").alias("n"), text.tag(p, "language").alias("lang"), text.tag(p, "languageOfficiality").alias("off"), text.tag(p, "languageDominance").alias("dom"))
    ordered = ranked(F.filter(F.transform(parts, name), lambda a: a["n"].isNotNull()))
    at = F.split(F.trim(field("pos")), r"\s+")
    rows = raw.select(
        field("placeId").try_cast("long").alias("id"), field("placeType").alias("typ"), F.get(at, 0).try_cast("double").alias("x"), F.get(at, 1).try_cast("double").alias("y"),
        field("placeElevation").try_cast("double").alias("ele"), field("municipality").alias("muni"), field("region").alias("region"),
        F.coalesce(field("scaleRelevance").try_cast("int"), F.lit(0)).alias("sr"), ordered.alias("names"),
    )
    return rows.where("x IS NOT NULL AND y IS NOT NULL AND size(names) > 0").withColumn("name", F.col("names")[0]["n"]).withColumn("kind", text.kind_of(F.col("name")))


def languages(names: DataFrame, column: str = "names") -> DataFrame:
    """(lang, n): how many names (n, lang, ...) of all places are in each language."""
    return names.select(F.explode(column).alias("x")).groupBy(F.col("x.lang").alias("lang")).agg(F.count("*").alias("n"))


def in_order(marks: DataFrame, collection: str = "_collection", key: str = "id") -> DataFrame:
    """marks in the order of collection and id, a missing id as zero."""
    return marks.orderBy(collection, F.coalesce(key, F.lit(0)))


def notable(scale: Column, least: int) -> Column:
    """Whether a name is meant for maps of a scale, or coarser ones."""
    return F.coalesce(scale >= least, F.lit(False))


def selected(all_places: DataFrame, summits: DataFrame, least_scale: int = 100_000) -> DataFrame:
    """Places of a map scale, and those below it that another place's summit belongs to (claimed), each once."""
    keep = all_places.where(notable(F.col("sr"), least_scale))
    claimed = summits.where("claimed IS NOT NULL").join(keep.select("id"), "id", "left_semi").select(F.col("claimed").alias("id")).distinct()
    return keep.unionByName(all_places.join(claimed, "id", "left_semi").join(keep.select("id"), "id", "left_anti"))


def hills(chosen: DataFrame, summits: DataFrame, least_top: float | None = None) -> DataFrame:
    """chosen with the heights of their summits (id, top, pt, x, y, d, open, wide, claimed): accepted, refused or not sampled.

    Accepted ones stand at their summit, with the name's own place beside; refused ones stay at their name. Where the
    model is unknown at a name the register's elevation counts. With least_top lower hills, and those of unknown
    height, are left out. In the order of ids.
    """
    s = summits.select("id", "top", "pt", F.col("x").alias("sx"), F.col("y").alias("sy"), "d", F.col("open").alias("s_open"), F.col("wide").alias("s_wide"), F.col("claimed").alias("s_claimed"))
    j = chosen.join(s, "id", "left")
    known = F.col("top").isNotNull()
    refused, accepted = known & F.coalesce("s_open", F.lit(False)), known & ~F.coalesce("s_open", F.lit(False))
    at_name = F.coalesce("pt", "ele")
    top = F.when(accepted, F.col("top")).when(refused, at_name).otherwise(F.col("ele"))
    lat, lon = geo.to_degrees(F.when(accepted, F.col("sx")).otherwise(F.col("x")), F.when(accepted, F.col("sy")).otherwise(F.col("y")))
    name_lat, name_lon = geo.to_degrees(F.col("x"), F.col("y"))
    if_accepted = lambda v: F.when(accepted, v)
    rows = j.select(
        "id", F.when(F.col("typ") == PLACE_TYPES[0], "hill").otherwise("hillgroup").alias("cat"), "name", "kind", "muni", F.col("sr").alias("rank"), F.round(top, 1).alias("top_m"),
        F.when(accepted | refused, "dem10").otherwise("nimisto").alias("src_top"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), if_accepted(F.round(name_lat, 6)).alias("name_lat"),
        if_accepted(F.round(name_lon, 6)).alias("name_lon"), F.coalesce(if_accepted(F.col("sx")), F.col("x")).alias("x"), F.coalesce(if_accepted(F.col("sy")), F.col("y")).alias("y"), if_accepted(F.col("d")).alias("snap_m"),
        if_accepted(F.round(F.col("top") - at_name, 1)).alias("gain_m"), if_accepted(F.when(F.col("s_wide"), True)).alias("wide"), F.when(refused, True).alias("open"), F.when(refused, F.col("s_claimed")).alias("claimed_by"),
        F.when(F.size("names") > 1, F.slice("names", 2, F.size("names"))).alias("names"),
    )
    kept = rows if least_top is None else rows.where(F.col("top_m") >= least_top)
    return kept.orderBy("id")
