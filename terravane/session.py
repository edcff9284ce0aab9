"""A session with the settings the library is written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("terravane")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder of spark.checkpoint.dir.

    Where none is set, a session of one machine uses a temporary one; on a cluster that is an error.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="terravane-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark knows; one that is not there is fine."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """The state of an iteration, written as Parquet in the shared folder in each round and read again.

    Unlike a checkpoint, a table that is read again has the size of its files in the next round's plan; the sizes that
    Spark guesses for joins of joins multiply from round to round. Only the last two rounds' files are kept; `last`
    turns the last state into a checkpoint and removes them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.k = spark, f"{_shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.k += 1
        path = f"{self.folder}/{self.k}"
        df.write.parquet(path)
        if self.k > 2:
            remove(self.spark, f"{self.folder}/{self.k - 2}")
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        held = checkpointed(df)
        remove(self.spark, self.folder)
        return held
