"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is cut into
pieces and each is compressed with either; the difference of the sizes over their sum says which kind
it resembles. A logistic curve, fitted on labelled texts that built no dictionary, makes it a
probability. The fit takes a bounded sample of labelled rows (see Sample); every row is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import checkpointed, map_columns

#: Bytes of a piece. Each is compressed for itself, so that long texts feel the dictionary throughout.
PIECE = 2048
DICTIONARY = 65536
LEVEL = 3


@dataclass(frozen=True)
class Sample:
    """The bound of what is fitted on: labelled rows of each label, and pieces for each dictionary."""

    rows: int = 4000
    pieces: int = 6000


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples. Too few to train one are taken as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Difference:
    """Normalised difference of a text's compressed sizes; positive if the good dictionary fits better."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.compressors = []
        for data in (good, bad):
            known = _dictionary(data)
            if data:
                known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=known, **plain).compress)

    def __call__(self, text: str) -> float:
        data = text.encode("utf-8")
        good, bad = (sum(len(f(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for f in self.compressors)
        return (bad - good) / max(1, bad + good)


def differences(df: DataFrame, good: bytes, bad: bytes, text: str = "text", out: str = "difference") -> DataFrame:
    made: list[Difference] = []

    def rows(texts: pa.Array) -> dict[str, pa.Array]:
        if not made:
            made.append(Difference(good, bad))
        return {out: pa.array([made[0](t or "") for t in texts.to_pylist()], pa.float64())}

    return map_columns(df, [text], {out: "double"}, rows)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the likeliest logistic curve, by damped Newton steps on standardised x."""
    scale = float(x.std()) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    weights = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + ridge * len(x) * weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * len(x) * np.eye(2) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights -= step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: Sample = Sample()) -> Model:
    """A model of label (1 good, 0 bad) from docs and their labels; give only rows that may be learnt from.

    Of each label the `sample.rows` keys of smallest hash are taken, so the broadcast and what reaches
    the driver are bounded. Half of them build dictionaries (at most `sample.pieces` pieces each), the other
    half fits the curve. Keys with differing labels, null keys and null labels are left out. Where one
    label is missing the model knows only the share of ones, and without labels it says a half.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("other"))
    known = known.where("label = other").select(key, F.col("label").cast("int").alias("label"), F.xxhash64(key, F.lit(7)).alias("order"))
    chosen = known.where("label = 0").orderBy("order", key).limit(sample.rows).unionByName(known.where("label = 1").orderBy("order", key).limit(sample.rows))
    chosen = chosen.select(key, "label", "order", (F.pmod("order", F.lit(2)) == 0).alias("builds"))
    # Stored once: the dictionaries and the curve read the sample, not the corpus.
    texts = checkpointed(docs.select(key, F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), key))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length("text") - 1), F.lit(PIECE))
    pieces = texts.where("builds").select("label", "order", F.col("text").cast("binary").alias("data"), F.posexplode(starts).alias("at", "start"))
    pieces = pieces.select("label", F.xxhash64("order", "at").alias("order"), F.substring(F.col("data"), F.col("start") + 1, F.lit(PIECE)).alias("piece"))
    dictionaries = []
    for value in (1, 0):
        rows = pieces.where(F.col("label") == value).orderBy("order", "piece").limit(sample.pieces).collect()
        dictionaries.append(train_dictionary([bytes(r["piece"]) for r in rows if r["piece"]]))
    others = texts.where("NOT builds").select("text", "label", "order", F.xxhash64("text").alias("own"))
    measured = differences(others, *dictionaries).drop("text").orderBy("order", "own").limit(4 * sample.rows).toPandas()
    return calibrated(*dictionaries, measured["difference"].to_numpy(float), measured["label"].to_numpy(float), known)


def calibrated(good: bytes, bad: bytes, x: np.ndarray, y: np.ndarray, known: DataFrame) -> Model:
    """The model whose curve follows x and y, moved from the sample's share of ones to that of all labels."""
    ones, rows = (int(v or 0) for v in known.agg(F.sum("label"), F.count("*")).first())
    prior = np.log((ones + 0.5) / (rows - ones + 0.5))
    if not 0 < y.sum() < len(y) or not good or not bad:
        return Model(good, bad, 0.0, float(prior))
    slope, intercept = logistic(x, y)
    return Model(good, bad, slope, intercept + float(prior - np.log(y.sum() / (len(y) - y.sum()))))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the probability that a text is good. A null or empty text has difference zero."""
    measured = differences(df, model.good, model.bad, text, out)
    return measured.withColumn(out, 1 / (1 + F.exp(-(F.col(out) * model.slope + model.intercept))))
