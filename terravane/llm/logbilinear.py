"""Scores texts by a log-bilinear neural language model, trained with noise-contrastive estimation.

The model predicts a unit from the vectors of the units before it: their sum, weighed by position and
dimension, times the vectors of all units plus biases, normalised over the units. Units are the most
frequent words, the end of a text, and classes of all other words by their last three bytes. Within a class
the same sum, times the vectors of the class's slots, is normalised over these: its most frequent words, and
one slot for all others. Of that slot a word has the share (c + 1) / (sum + 1), c being its count and sum the sum over
the slot's known words of c + 1; what is left is the share of unknown words. So the token probabilities add up to one.
As context a word counts as itself if it is a unit or has a slot, else as its class.

Counts are taken over all training tokens. A first model is fitted on a bounded sample of texts, so that
all tasks start alike; then every task trains it on all of its texts, and the models are averaged, weighed
by their tokens, in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import checkpointed, free_name
from terravane.llm.words import words

#: The token that ends a text; no word has this hash but by chance of one in 2^64.
END = np.uint64(1)
#: Units: frequent words, and classes of the rest.
WORDS, CLASSES = 128, 383
UNITS = WORDS + CLASSES
#: Slots of a class: its most frequent words, and the last one for the others.
SLOTS = 32
REST = SLOTS - 1
#: Numbers of contexts: units, what is before a text, slots.
CONTEXTS = UNITS + 1 + CLASSES * SLOTS
DIMENSION, CONTEXT = 16, 6
#: Tokens of a step; noise samples that a step shares, and those that each token has within its class.
BATCH, NOISE, INNER_NOISE, RATE = 2048, 32, 2, 0.1
#: Frequent words whose counts every task has; the others' counts are joined.
FREQUENT = 1 << 18
#: Texts of the first fit; rows of a chunk; models that are averaged in a task.
FIRST_TEXTS, CHUNK, FAN = 1000, 512, 8


def classes(endings: np.ndarray) -> np.ndarray:
    return ((endings * 2654435761 >> 7) % CLASSES).astype(np.int16)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, number of tokens of each text): the words of each text, then its end."""
    h, e, n = words(texts)
    total = len(h) + len(n)
    ends = np.cumsum(n + 1) - 1
    inner = np.ones(total, bool)
    inner[ends] = False
    hashes, of = np.full(total, END, np.uint64), np.zeros(total, np.int16)
    hashes[inner], of[inner] = h, classes(e)
    return hashes, of, n + 1


def _chunks(batches, columns: tuple[str, ...]) -> Iterator[tuple[list, ...]]:
    for whole in batches:
        for i in range(0, whole.num_rows, CHUNK):
            yield tuple(whole.column(c).slice(i, CHUNK).to_pylist() for c in columns)


def counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(hash, class, n) of every distinct token of texts."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, of, n = (np.concatenate(x) for x in zip(*held, strict=True))
            known, first, at = np.unique(h, return_index=True, return_inverse=True)
            return known, of[first], np.bincount(at, weights=n).astype(np.int64)

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), pa.array(rows[1]), pa.array(rows[2])], ["hash", "class", "n"])

        for (chunk,) in _chunks(batches, (text,)):
            h, of, _ = tokens(chunk)
            held.append((h, of, np.ones(len(h))))
            size += len(h)
            if size > 2_000_000:
                held = [flush()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield table(held[0])
                    held, size = [], 0
        if held:
            yield table(flush())

    partial = texts.select(text).mapInArrow(run, "hash long, class short, n long")
    return partial.groupBy("hash").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


#: The logarithm of the share of slots that no word has.
ABSENT = -60.0


@dataclass
class Vocabulary:
    """What every task knows: sorted hashes of frequent words with counts, units and slots (-1: none), and the sums of the classes' last slots."""

    frequent: np.ndarray
    count: np.ndarray
    unit: np.ndarray
    slot: np.ndarray
    sums: np.ndarray
    log_noise: np.ndarray
    inner_noise: np.ndarray
    n_tokens: int
    n_distinct: int

    def places(self, hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the context, count or -1 where the word isn't frequent) of tokens."""
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        hit = self.frequent[at] == hashes
        unit, slot = np.where(hit, self.unit[at], -1), np.where(hit, self.slot[at], -1)
        inner = np.where(slot >= 0, UNITS + 1 + of.astype(np.int64) * SLOTS + slot, WORDS + of)
        return np.where(unit >= 0, unit, inner).astype(np.uint16), np.where(hit, self.count[at], -1)


def parted(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, slot among those of all classes, -1 for words that are units) of contexts' numbers."""
    places = places.astype(np.int64)
    inner = places - (UNITS + 1)
    slotted, classed = inner >= 0, (places >= WORDS) & (places < UNITS)
    unit = np.where(slotted, WORDS + inner // SLOTS, places)
    return unit, np.where(slotted, inner, np.where(classed, (places - WORDS) * SLOTS + REST, -1))


def vocabulary(known: DataFrame) -> Vocabulary:
    """The vocabulary of a table of counts; what reaches the driver is bounded by FREQUENT and CLASSES.

    Of equally frequent words those with smaller hashes become units and slots.
    """
    totals = known.agg(F.sum("n"), F.count("*")).first()
    most = known.orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    hashes, of, n = (most.column(c).to_numpy() for c in ("hash", "class", "n"))
    hashes = hashes.view(np.uint64)
    unit = np.full(len(hashes), -1)
    unit[:WORDS] = np.arange(min(WORDS, len(hashes)))
    if not (hashes[:WORDS] == END).any() and (hashes == END).any():
        unit[WORDS - 1], unit[hashes == END] = -1, WORDS - 1
    sums, mass = np.zeros(CLASSES), np.zeros(UNITS)
    for row in known.groupBy("class").agg(F.sum(F.col("n") + 1).alias("s"), F.sum("n").alias("m")).collect():
        sums[row["class"]], mass[WORDS + row["class"]] = row["s"], row["m"]
    top = unit >= 0
    np.subtract.at(sums, of[top], n[top] + 1)
    np.subtract.at(mass, WORDS + of[top].astype(int), n[top])
    mass[unit[top]] = n[top]
    # The place of each word among its class's, by count.
    tail = np.flatnonzero(~top)
    by_class = tail[np.argsort(of[tail], kind="stable")]
    starts = np.flatnonzero(np.concatenate([[True], of[by_class][1:] != of[by_class][:-1]])) if len(by_class) else np.zeros(0, int)
    rank = np.arange(len(by_class)) - np.repeat(starts, np.diff([*starts, len(by_class)]))
    slot = np.full(len(hashes), -1)
    slot[by_class] = np.where(rank < REST, rank, -1)
    own = slot >= 0
    inner = np.zeros((CLASSES, SLOTS))
    inner[of[own].astype(int), slot[own]] = n[own] + 1
    inner[:, REST] = mass[WORDS:] - inner[:, :REST].sum(axis=1) + (inner > 0).sum(axis=1) + 1
    np.subtract.at(sums, of[own].astype(int), n[own] + 1)
    with np.errstate(divide="ignore"):
        inner_noise = np.maximum(np.log(inner / inner.sum(axis=1, keepdims=True)), ABSENT).astype(np.float32)
    order = np.argsort(hashes)
    noise = np.log((mass + 1) / (mass + 1).sum()).astype(np.float32)
    return Vocabulary(hashes[order], n[order], unit[order], slot[order], sums, noise, inner_noise, int(totals[0] or 0), totals[1])


class Model:
    """Context vectors, weights by position, vectors and biases of units and of slots."""

    def __init__(self, log_noise: np.ndarray, inner_noise: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        normal = lambda rows: (rng.standard_normal((rows, DIMENSION)) * 0.1).astype(np.float32)
        self.context, self.weights = normal(CONTEXTS), np.full((CONTEXT, DIMENSION), 0.5, np.float32)
        self.vectors, self.biases = normal(UNITS), log_noise.copy()
        self.inner_vectors, self.inner_biases = normal(CLASSES * SLOTS), inner_noise.ravel().copy()
        self.log_noise, self.inner_noise = log_noise, inner_noise

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.weights, self.vectors, self.biases, self.inner_vectors, self.inner_biases]

    def packed(self) -> bytes:
        return b"".join(p.tobytes() for p in self.parameters)

    def unpack(self, data: bytes) -> Model:
        flat, at = np.frombuffer(data, np.float32), 0
        for p in self.parameters:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return np.einsum("bnd,nd->bd", self.context.take(before, axis=0), self.weights)

    def log10(self, places: np.ndarray, before: np.ndarray, block: int = 512) -> np.ndarray:
        """The normalised log10 probability of each token's unit and, within a class, its slot after its context."""
        out, predicted = np.empty(len(places)), np.empty((len(places), DIMENSION), np.float32)
        units, slots = parted(places)
        # The biases are one more dimension; logits are clipped only where the lengths of vectors let them be large.
        # They are in units of log(2): powers of two take half the time of powers of e.
        log2 = np.float32(np.log(2))
        across = np.ascontiguousarray(np.concatenate([self.vectors, self.biases[:, None]], axis=1).T) / log2
        logits, ones, longest = np.empty((block, UNITS), np.float32), np.ones(UNITS, np.float32), np.sqrt((across * across).sum(axis=0).max())
        extended = np.ones((block, DIMENSION + 1), np.float32)
        for i in range(0, len(units), block):
            own = units[i : i + block]
            some, left = logits[: len(own)], extended[: len(own)]
            left[:, :DIMENSION] = predicted[i : i + block] = self.predicted(before[i : i + block])
            np.matmul(left, across, out=some)
            if longest * np.sqrt((left * left).sum(axis=1).max()) > 60 / log2:
                np.clip(some, -60 / log2, 60 / log2, out=some)
            chosen = some[np.arange(len(own)), own] * log2
            np.exp2(some, out=some)
            out[i : i + block] = chosen - np.log(some @ ones)
        # Class by class, so that each class's slots are one matrix product.
        inner = np.flatnonzero(slots >= 0)
        inner = inner[np.argsort(slots[inner] // SLOTS, kind="stable")]
        ends = np.searchsorted(slots[inner] // SLOTS, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(ends)):
            at = inner[ends[c] : ends[c + 1]]
            rows = slice(c * SLOTS, (c + 1) * SLOTS)
            inside = np.clip(predicted[at] @ self.inner_vectors[rows].T + self.inner_biases[rows], 2 * ABSENT, 60)
            out[at] += inside[np.arange(len(at)), slots[at] % SLOTS] - np.log(np.exp(inside).sum(axis=1))
        return out / np.log(10)


def contexts(units: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CONTEXT tokens before each one in its text, nearest first; UNITS stands for before the text."""
    place = np.arange(len(units)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    padded = np.concatenate([np.full(CONTEXT, UNITS, np.uint16), units])
    back = [np.where(place >= k, padded[CONTEXT - k : CONTEXT - k + len(units)], UNITS) for k in range(1, CONTEXT + 1)]
    return np.stack(back, axis=1).astype(np.uint16)


def _summed(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # Of 16 bits, which are sorted by radix; CONTEXTS fits.
    index = index.astype(np.uint16)
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[starts], np.add.reduceat(values.take(order, axis=0), starts, axis=0)


class Trainer:
    """Adaptive gradient steps on the noise-contrastive objective.

    The noise of units is shared by a batch; within its class each token has noise of its own.
    """

    def __init__(self, model: Model, rate: float, seed: int) -> None:
        self.model, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        self.squares = [np.full_like(p, 1e-2) for p in model.parameters]
        self.cumulated = np.cumsum(np.exp(model.log_noise.astype(np.float64)))
        shares = np.exp(model.inner_noise.astype(np.float64))
        self.inner_cumulated = (np.minimum(np.cumsum(shares, axis=1), 1)[:, :-1] + np.arange(CLASSES)[:, None]).ravel()
        self.seen = 0
        self.left: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint16), np.zeros((0, CONTEXT), np.uint16))

    def feed(self, places: np.ndarray, before: np.ndarray, last: bool = False) -> None:
        places, before = np.concatenate([self.left[0], places]), np.concatenate([self.left[1], before])
        whole = len(places) if last else len(places) // BATCH * BATCH
        for i in range(0, whole, BATCH):
            self.step(places[i : min(i + BATCH, whole)], before[i : min(i + BATCH, whole)])
        self.left = places[whole:], before[whole:]

    def _inner(self, slots: np.ndarray, predicted: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Gradients within the classes: of what is predicted, and (slots, their vectors and biases)."""
        m = self.model
        # One search for all classes: the shares of class c are cumulated from c to c + 1.
        classes = slots // SLOTS
        drawn = np.searchsorted(self.inner_cumulated, classes[:, None] + self.rng.random((len(slots), INNER_NOISE))) - (classes * REST)[:, None]
        every = np.concatenate([slots[:, None], (slots - slots % SLOTS)[:, None] + drawn], axis=1)
        vectors = m.inner_vectors.take(every, axis=0)
        shift = np.float32(np.log(INNER_NOISE))
        found = np.einsum("bkd,bd->bk", vectors, predicted) + m.inner_biases[every] - m.inner_noise.ravel()[every] - shift
        found = np.clip(found, -60, 60)
        pull = -1 / (1 + np.exp(-found))
        pull[:, 0] += 1
        values = np.concatenate([pull[:, :, None] * predicted[:, None, :], pull[:, :, None]], axis=2)
        return np.einsum("bk,bkd->bd", pull, vectors), _summed(every.ravel(), values.reshape(-1, DIMENSION + 1))

    def step(self, places: np.ndarray, before: np.ndarray) -> None:
        m = self.model
        units, slots = parted(places)
        inputs = m.context.take(before, axis=0)
        predicted = np.einsum("bnd,nd->bd", inputs, m.weights)
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1]), UNITS - 1)
        shift, own_vectors = np.float32(np.log(NOISE)), m.vectors.take(units, axis=0)
        own = np.clip(np.einsum("bd,bd->b", predicted, own_vectors) + m.biases[units] - m.log_noise[units] - shift, -60, 60)
        other = np.clip(predicted @ m.vectors[noise].T + m.biases[noise] - m.log_noise[noise] - shift, -60, 60)
        up, down = 1 / (1 + np.exp(own)), -1 / (1 + np.exp(-other))
        to_predicted = up[:, None] * own_vectors + down @ m.vectors[noise]
        at, values = _summed(units, np.concatenate([up[:, None] * predicted, up[:, None]], axis=1))
        to_units = np.zeros((UNITS, DIMENSION + 1), np.float32)
        to_units[at] = values
        np.add.at(to_units, noise, np.concatenate([down.T @ predicted, down.sum(axis=0)[:, None]], axis=1))
        some = np.flatnonzero(slots >= 0)
        inner, to_inner = np.zeros(0, np.int64), np.zeros((0, DIMENSION + 1), np.float32)
        if len(some):
            pulled, (inner, to_inner) = self._inner(slots[some], predicted[some])
            to_predicted[some] += pulled
        to_weights = np.einsum("bnd,bd->nd", inputs, to_predicted)
        rows, to_context = _summed(before.ravel(), (to_predicted[:, None, :] * m.weights[None]).reshape(-1, DIMENSION))
        n = np.float32(len(units))
        gradients = (to_context, to_weights, to_units[:, :DIMENSION], to_units[:, DIMENSION], to_inner[:, :DIMENSION], to_inner[:, DIMENSION])
        whole = slice(None)
        for p, s, g, where in zip(m.parameters, self.squares, gradients, (rows, whole, whole, whole, inner, inner), strict=True):
            g = g / np.sqrt(n)
            own = s[where] + g * g
            s[where] = own
            p[where] += self.rate * g / np.sqrt(own)
        self.seen += len(units)


def _fed(trainer: Trainer, texts: list, vocab: Vocabulary) -> None:
    h, of, n = tokens(texts)
    places, _ = vocab.places(h, of)
    trainer.feed(places, contexts(places, n))


def train(texts: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text") -> Model:
    """A model trained on all rows of texts; see the module for how. Without tokens it stays as it begins.

    The texts of the first fit are those of smallest hashes: chosen by hash alone, so that no more of them are moved;
    rows that repeat key and text count there once.
    """
    noise = vocab.log_noise, vocab.inner_noise
    model = Model(*noise)
    if not vocab.n_tokens:
        return model
    known = Vocabulary(**vars(vocab))
    named = (vocab.unit >= 0) | (vocab.slot >= 0)
    known.frequent, known.count, known.unit, known.slot = (x[named] for x in (vocab.frequent, vocab.count, vocab.unit, vocab.slot))
    hashed = texts.select(F.xxhash64(key, F.lit(5)).alias("by_key"), F.xxhash64(text).alias("by_text"), F.col(text).alias("text"))
    chosen = hashed.select("by_key", "by_text").distinct().orderBy("by_key", "by_text").limit(FIRST_TEXTS)
    first = hashed.join(F.broadcast(chosen), ["by_key", "by_text"]).dropDuplicates(["by_key", "by_text"]).orderBy("by_key", "by_text")

    def warm(batches):
        trainer = Trainer(Model(*noise), RATE, 0)
        for (chunk,) in _chunks(batches, ("text",)):
            _fed(trainer, chunk, known)
        trainer.feed(np.zeros(0, np.uint16), np.zeros((0, CONTEXT), np.uint16), last=True)
        yield pa.RecordBatch.from_arrays([pa.array([trainer.model.packed()], pa.binary())], ["model"])

    start = first.select("text").coalesce(1).mapInArrow(warm, "model binary").first()[0]

    def run(batches):
        number = TaskContext.get().partitionId()
        trainer = Trainer(Model(*noise).unpack(start), RATE / 4, number + 1)
        for (chunk,) in _chunks(batches, (text,)):
            _fed(trainer, chunk, known)
        trainer.feed(np.zeros(0, np.uint16), np.zeros((0, CONTEXT), np.uint16), last=True)
        if trainer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([trainer.seen]), pa.array([trainer.model.packed()], pa.binary())], ["number", "weight", "model"])

    def average(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        total = sum(r["weight"] for r in rows)
        mean = sum(np.frombuffer(r["model"], np.float32).astype(np.float64) * (r["weight"] / total) for r in rows)
        return pa.table({"number": pa.array([rows[0]["number"] // FAN]), "weight": pa.array([total]), "model": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    schema = "number long, weight long, model binary"
    source = texts.select(text)
    tasks = source.rdd.getNumPartitions()
    models = checkpointed(source.mapInArrow(run, schema))
    while tasks > 1:
        models = models.groupBy(F.floor(F.col("number") / FAN)).applyInArrow(average, schema)
        tasks = -(-tasks // FAN)
    return model.unpack(models.first()["model"])


def score(docs: DataFrame, vocab: Vocabulary, known: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without text, with n_tokens, n_known, base_score and score (log10) of each text.

    Null texts are empty: their one token is the end. Repeated rows each come back. Columns named like
    a result are replaced, all others stay.
    """
    made = ["n_tokens", "n_known", "base_score", "score"]
    kept = [c for c in docs.columns if c not in (text, *made)]
    rare_name, row = free_name(docs, "rare"), free_name(docs, "row_")
    log_class = np.log10(vocab.sums + 1)
    log_all = np.log10(vocab.n_tokens + vocab.n_distinct + 1)
    packed, noise = model.packed(), (vocab.log_noise, vocab.inner_noise)

    def run(batches):
        of_task = Model(*noise).unpack(packed)
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(i, CHUNK)
                h, of, n = tokens(batch.column(text).to_pylist())
                places, count = vocab.places(h, of)
                rare, rest = count < 0, (places >= WORDS) & (places < UNITS)
                own = np.where(rare, 0.0, np.log10(np.maximum(count, 0) + 1))
                each = of_task.log10(places, contexts(places, n)) + np.where(rest, own - log_class[of], 0.0)
                starts = np.cumsum(n) - n
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(rare, starts, dtype=np.int64))]), pa.int32()), pa.array(h[rare].view(np.int64)))
                sums = (n, np.add.reduceat(count > 0, starts, dtype=np.int64), np.add.reduceat(own - log_all, starts), np.add.reduceat(each, starts))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, sums), lists], [*kept, *made, rare_name])

    schema = docs.select(*kept, *(F.lit(None).cast(t).alias(c) for c, t in zip(made, ("long", "long", "double", "double"), strict=True)), F.lit(None).cast("array<long>").alias(rare_name)).schema
    # Row numbers are given to stored rows: they stay the same when a task runs again.
    rows = checkpointed(docs.select(*kept, text).mapInArrow(run, schema)).withColumn(row, F.monotonically_increasing_id())
    met = rows.select(row, F.explode(rare_name).alias("hash")).join(known.select("hash", "n"), "hash")
    extra = met.groupBy(row).agg(F.sum(F.log10(F.col("n").cast("double") + 1)).alias("more"), F.count("*").alias("found"))
    joined = rows.drop(rare_name).join(extra.select(F.col(row).alias("at"), F.struct("more", "found").alias("e")), F.col(row) == F.col("at"), "left")
    more = F.coalesce(F.col("e.more"), F.lit(0.0))
    sums = {"n_tokens": F.col("n_tokens"), "n_known": F.col("n_known") + F.coalesce(F.col("e.found"), F.lit(0)), "base_score": F.col("base_score") + more, "score": F.col("score") + more}
    return joined.select(*(F.col(f"`{c}`") for c in kept), *(v.alias(c) for c, v in sums.items()))


def scored(docs: DataFrame, learn: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Vocabulary]:
    """docs scored by a model that learns from the rows of learn, and what was counted.

    With nothing to learn from every token is unknown. Empty docs give an empty result.
    """
    known = checkpointed(counts(learn, text))
    vocab = vocabulary(known)
    if not len(vocab.frequent):
        vocab.frequent, vocab.count, vocab.unit, vocab.slot = np.zeros(1, np.uint64), np.full(1, -1), np.full(1, -1), np.full(1, -1)
    return score(docs, vocab, known, train(learn, vocab, key, text), text), vocab
