"""Results as files."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)


def catalogue(objects: DataFrame, path: str, licence: str = "CC BY 4.0") -> None:
    """Objects as compressed JSON lines, highest first (unknown as zero, then by id), with a header beside them."""
    with_top = objects.withColumn("top_m", F.round(F.col("ground_m") + F.col("height_m"), 1))
    # Counted in the pass that writes, behind the sort, whose sampling would count too.
    written = Observation()
    in_order = with_top.orderBy(F.desc(F.coalesce("top_m", F.lit(0.0))), "id")
    in_order.observe(written, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(f"{path}/objects", compression="gzip")
    header = objects.sparkSession.range(1).select(F.lit(1).alias("format"), F.current_date().alias("made"), F.lit(licence).alias("licence"), F.lit(written.get["n"]).cast("long").alias("n"))
    header.coalesce(1).write.json(f"{path}/header")


def tiers(objects: DataFrame, path: str, tier: str = "tier") -> None:
    """Objects in columns, a folder for each tier."""
    objects.write.partitionBy(tier).parquet(path)


def resume(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The work whose key has no result yet; append its results to the folder that done is read from."""
    return work.join(done.select(key), key, "left_anti")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is stored at a path; nothing, with the schema, where there is nothing yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def extend(work: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame], schema: str, parts: int = 1) -> DataFrame:
    """All results of work: those stored at a path, and those of the keys that have none, computed and appended there.

    The work is done in parts by the hash of its key, each stored before the next one begins: a run that breaks off loses
    one part at most, and the next run goes on with what has no result yet. What a part wrote is logged, counted as it is written.
    """
    spark = work.sparkSession
    for k in range(parts):
        todo = work.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k) if parts > 1 else work
        written = Observation()
        compute(resume(todo, stored(spark, path, schema), key)).observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
        LOG.info("part %d of %d: %d rows", k + 1, parts, written.get["n"])
    return stored(spark, path, schema)


def sparse(columns: list[str]) -> Column:
    """A row as JSON without its nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def hills(rows: DataFrame, path: str, least_scale: int, source: str = "CC BY 4.0") -> dict[str, int]:
    """Hills as compressed JSON lines without nulls, in the order of ids, with a header; (rows, bytes, compressed bytes)."""
    spark = rows.sparkSession
    lines = rows.orderBy("id").select(sparse(rows.columns).alias("value"))
    lines.write.mode("errorifexists").text(f"{path}/hills", compression="gzip")
    header = spark.range(1).select(F.lit(source).alias("source"), F.lit(least_scale).alias("min_scale"))
    header.coalesce(1).write.json(f"{path}/header")
    raw = spark.read.text(f"{path}/hills").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("b")).first()
    packed = spark.read.format("binaryFile").load(f"{path}/hills").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    return {"rows": raw["n"], "bytes": raw["b"], "compressed": packed["b"]}


def profiles(profile: DataFrame, seen: DataFrame, path: str) -> None:
    """Skylines (id, profile) with what they were made from (id, hobs, ...), a row for each observer."""
    profile.join(seen, "id").write.mode("errorifexists").parquet(path)


def blocks(cells: DataFrame, path: str, size: int = 256) -> None:
    """A raster's cells (row, col, v) in a folder for each block of cells, so that a window reads only its blocks."""
    placed = cells.withColumn("brow", F.floor(F.col("row") / size).cast("int")).withColumn("bcol", F.floor(F.col("col") / size).cast("int"))
    placed.repartition("brow", "bcol").write.partitionBy("brow", "bcol").parquet(path)


def window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], size: int = 256, low: float = -500.0, high: float = 2000.0) -> DataFrame:
    """(row, col, v) of the cells of blocks from rows[0] to rows[1] and cols[0] to cols[1], both inside; values outside (low, high) are null."""
    found = spark.read.parquet(path)
    for name, (a, b) in (("row", rows), ("col", cols)):
        found = found.where(F.col(f"b{name}").between(a // size, b // size) & F.col(name).between(a, b))
    return found.select("row", "col", F.when((F.col("v") > low) & (F.col("v") < high), F.col("v")).alias("v"))


def tile_files(tiles: DataFrame, path: str) -> None:
    """Encoded tiles (cell, tx, ty, content) as rows, a folder for each cell size; tiles that are there already stay as they are."""
    have = stored(tiles.sparkSession, path, "tx int, ty int, content binary, cell int").select("cell", "tx", "ty")
    tiles.join(have, ["cell", "tx", "ty"], "left_anti").write.mode("append").partitionBy("cell").parquet(path)


INDEX = "origin array<int>, rings array<array<int>>, tiles map<string, map<string, array<double>>>"


def write_index(index: DataFrame, path: str) -> None:
    """A tile index (cell, tiles) as one JSON text: for each cell size its tiles with bytes, least and greatest metres."""
    entry = F.transform_values("tiles", lambda _, t: F.array(t["bytes"].cast("double"), t["least_m"], t["most_m"]))
    every = index.select(F.col("cell").cast("string").alias("cell"), entry.alias("tiles"))
    one = every.agg(F.map_from_entries(F.collect_list(F.struct("cell", "tiles"))).alias("tiles"))
    one.coalesce(1).write.mode("errorifexists").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(cell, tx, ty, bytes, least_m, most_m) of a tile index; an error that says so if the file is none, as a web page in its place."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", INDEX).alias("i"))
    if raw.where("i.tiles IS NOT NULL").isEmpty():
        raise ValueError(f"{path} is not a tile index")
    cells = raw.select(F.explode("i.tiles").alias("cell", "of")).select("cell", F.explode("of").alias("tile", "x"))
    at = F.split("tile", "_")
    return cells.select(F.col("cell").cast("int").alias("cell"), at[0].cast("long").alias("tx"), at[1].cast("long").alias("ty"), F.col("x")[0].cast("long").alias("bytes"), F.col("x")[1].alias("least_m"), F.col("x")[2].alias("most_m"))
