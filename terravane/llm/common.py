"""What the operators of this package share: checkpoints, Arrow row loops, words and folds."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that a Python worker turns into Python objects at once.
CHUNK_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared checkpoint folder.

    The folder is the session's own (`spark.checkpoint.dir`). Where none is set, a session of one machine
    uses a temporary one; on a cluster that is an error, as executors don't share such a folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="terravane-checkpoint-"))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (capitals aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_held: dict[str, tuple[tuple, object]] = {}


def held(make: Callable, *of):
    """make(*of), kept by the Python process until another one is asked for.

    Workers outlive a query: with one vocabulary or model at a time they don't gather those of all stages.
    """
    key = (make.__module__, make.__qualname__, of)
    if _held.get("one", (None,))[0] != key:
        _held.clear()
        _held["one"] = (key, make(*of))
    return _held["one"][1]


def map_columns(df: DataFrame, columns: list[str], outputs: dict[str, str], rows: Callable[..., dict[str, pa.Array]], without: tuple[str, ...] = ()) -> DataFrame:
    """df with outputs (name: type) appended; rows gets columns of a few rows as Arrow arrays and returns arrays.

    Columns of df that have the name of an output are replaced; those in `without` are not sent back. Rows go
    through in chunks, so that a Python worker holds Python objects of few rows at a time.
    """
    kept = df.drop(*outputs, *without)
    schema = kept.limit(0).select("*", *(F.lit(None).cast(t).alias(c) for c, t in outputs.items())).schema
    names = kept.columns
    selected = kept if set(columns) <= set(names) else df.select(*(f"`{c}`" for c in dict.fromkeys([*names, *columns])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(start, CHUNK_ROWS)
                made = rows(*(batch.column(batch.schema.get_field_index(c)) for c in columns))
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, *(made[c] for c in outputs)], [*names, *outputs])

    return selected.mapInArrow(run, schema)


def fold(key: str, folds: int) -> Column:
    """The fold of a row: crc32 of the key as text, modulo folds. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)
