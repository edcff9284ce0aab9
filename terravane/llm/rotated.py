"""Near-duplicate embeddings by randomised-rotation binary codes.

Vectors are scaled to length one and turned by random rotations; the signs are the code. With the
correction factor f = <code, turned vector> stored beside it, <code, turned query> / f is an unbiased
estimate of the cosine, off by more than `EPSILONS` * sqrt((1 - f^2) / f^2 / (d - 1)) hardly ever. Only pairs
whose upper bound reaches the threshold are computed exactly.

Which pairs are looked at: bits of the codes make bands; vectors of a label that agree in a band meet in a
bucket. Bits and bands follow the label's size, so that buckets stay small and a pair at the threshold is
missed with a chance of at most `MISSED`; small labels are one bucket and miss none. Large buckets are
cut into blocks that meet pair by pair, each in a task of its own. Tasks return sums and a spanning
forest, not pairs; equal vectors are one class with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import checkpointed
from terravane.llm.graph import components

#: Standard errors of the estimate that a bound allows for.
EPSILONS = 4.0
#: The chance that a pair right at the threshold shares no band.
MISSED = 0.002
#: Vectors of a label that meet in one bucket at most on average, rows of a block, pairs computed at once.
BUCKET, BLOCK, PAIRS = 1024, 1024, 1 << 16
SEED = 20_24


def bands(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a band, bands) for a label of n vectors."""
    bits = max(0, ceil(log2(n / BUCKET))) if n > 2 * BUCKET else 0
    if not bits:
        return 0, 1
    together = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(MISSED) / log(1 - together))


@lru_cache(maxsize=8)
def rotation(dimension: int, number: int) -> np.ndarray:
    """A random orthogonal matrix; the same for a number in every task."""
    normal = np.random.default_rng([SEED, dimension, number]).standard_normal((dimension, dimension))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, which keeps squares in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def band_keys(units: np.ndarray, bits: int, number: int) -> np.ndarray:
    """The key of each row in each band, from the signs of as many rotations as it needs."""
    if not bits:
        return np.zeros((len(units), 1), np.int64)
    d = units.shape[1]
    signs = np.concatenate([units @ rotation(d, k).T > 0 for k in range(-(-bits * number // d))], axis=1)[:, : bits * number]
    return signs.reshape(len(units), number, bits) @ (1 << np.arange(bits, dtype=np.int64))


def linked(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with cosine >= threshold, in arrays; of same blocks each pair once."""
    d = left.shape[1]
    turn = rotation(d, 0).T
    turned = left @ turn
    codes = np.where(turned > 0, 1.0, -1.0) / np.sqrt(d)
    factor = (codes * turned).sum(axis=1)
    slack = EPSILONS * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1)) + 1e-6
    estimate = (codes / factor[:, None]) @ (right @ turn).T
    hopeful = estimate + slack[:, None] >= threshold
    if same:
        hopeful = np.triu(hopeful, 1)
    a, b = np.nonzero(hopeful)
    for i in range(0, len(a), PAIRS):
        x, y = a[i : i + PAIRS], b[i : i + PAIRS]
        exact = np.einsum("ij,ij->i", left[x], right[y]) >= threshold
        if exact.any():
            yield x[exact], y[exact]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n rows reaches by pairs (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _floats(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _with_keys(df: DataFrame, threshold: float) -> DataFrame:
    """(class, copies, label, embedding, n) to a row for each band, with all keys of the class."""

    def run(batches):
        for whole in batches:
            sizes = whole.column("n").to_numpy()
            lengths = whole.column("embedding").value_lengths().to_numpy()
            for n, d in sorted(set(zip(sizes.tolist(), lengths.tolist(), strict=True))):
                batch = whole.take(pa.array(np.flatnonzero((sizes == n) & (lengths == d))))
                keys = band_keys(unit(_floats(batch.column("embedding"))), *bands(n, threshold))
                number = keys.shape[1]
                for band in range(number):
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c) for c in ("class", "copies", "label", "dimension", "embedding")), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * number, pa.int32()), pa.array(keys.ravel())), pa.array(np.full(len(keys), band, np.int32)), pa.array(keys[:, band])],
                        ["class", "copies", "label", "dimension", "embedding", "keys", "band", "key"],
                    )

    schema = f"class long, copies long, label {df.schema['label'].dataType.simpleString()}, dimension int, embedding array<double>, keys array<long>, band int, key long"
    return df.mapInArrow(run, schema)


def _meet(table: pa.Table, threshold: float) -> pa.Table:
    """Of two blocks of a bucket: what each class gains in links, and where its block's links lead."""
    first, second, band = (table.column(c)[0].as_py() for c in ("first", "second", "band"))
    block = table.column("block").to_numpy()
    ids, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
    units = unit(_floats(table.column("embedding").combine_chunks()))
    keys = _floats(table.column("keys").combine_chunks()).astype(np.int64)
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    gained, a_all, b_all = np.zeros(len(ids), np.int64), [], []
    for x, y in linked(units[left], units[right], threshold, first == second):
        a, b = left[x], right[y]
        # A pair counts in the first band that brings it together.
        new = ~(keys[a, :band] == keys[b, :band]).any(axis=1)
        a, b = a[new], b[new]
        np.add.at(gained, a, copies[b])
        np.add.at(gained, b, copies[a])
        a_all.append(a)
        b_all.append(b)
    if not a_all:
        return pa.table({"class": pa.array([], pa.int64()), "gained": pa.array([], pa.int64()), "reached": pa.array([], pa.int64())})
    low = forest(np.concatenate(a_all), np.concatenate(b_all), len(ids))
    some = np.flatnonzero(gained)
    return pa.table({"class": ids[some], "gained": gained[some], "reached": ids[low[some]]})


def links(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row (key, n_links, component_id, kept) for each row of vectors.

    Vectors link if their labels are equal and not null, their lengths equal, and their cosine in double
    precision is at least threshold. Those that are null, empty, zero, without a key, or hold a null, NaN or infinite
    component link with nothing, not even a copy. Rows that repeat key, label and vector are one vector and
    all come back. An empty table gives an empty result.
    """
    rows = checkpointed(vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("embedding")))
    sound = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    good = rows.where(sound)
    classes = good.distinct().groupBy("label", "embedding").agg(F.min("id").alias("low_id"), F.count("*").alias("copies"))
    # Classes have numbers of their own, given to stored rows: an id may stand under several labels.
    classes = checkpointed(classes.withColumn("dimension", F.size("embedding"))).withColumn("class", F.monotonically_increasing_id())
    sizes = classes.groupBy(F.col("label").alias("l"), F.col("dimension").alias("d")).agg(F.count("*").alias("n"))
    sized = classes.drop("low_id").join(sizes, (F.col("label") == F.col("l")) & (F.col("dimension") == F.col("d"))).drop("l", "d")
    keyed = _with_keys(sized, threshold)
    bucket = ["label", "dimension", "band", "key"]
    full = keyed.groupBy(*bucket).agg(F.count("*").alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    placed = keyed.join(full, bucket).withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
    others = F.sequence(F.lit(0), blocks - 1)
    met = placed.withColumn("other", F.explode(others)).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    found = met.groupBy(*bucket, "first", "second").applyInArrow(lambda t: _meet(t, threshold), "class long, gained long, reached long")
    found = checkpointed(found)
    gained = found.groupBy("class").agg(F.sum("gained").alias("gained"))
    roots = components(found, "class", "reached").withColumnRenamed("node", "class")
    rooted = classes.select("class", "low_id").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    # Stored, so that a component of very many classes is joined from two plain inputs, which adaptive execution can split.
    lowest = checkpointed(rooted.groupBy("root").agg(F.min("low_id").alias("component")))
    ends = checkpointed(rooted.join(lowest, "root").select("class", "component"))
    known = classes.join(gained, "class", "left").join(ends, "class")
    known = known.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("copies") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"), "component")
    joined = rows.withColumn("sound", sound).join(known, F.col("sound") & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN low l ON e.vec_id = l.x LEFT JOIN counts c ON e.vec_id = c.x
"""
