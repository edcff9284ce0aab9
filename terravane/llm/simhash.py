"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most `bits` bits are cut into so few segments that in one of them they
differ in at most one bit. Each segment is indexed once for each of its bits with that bit left out: two
segments that differ in one bit share the variant without it, equal ones share all. An equality join on
the variants, with the difference checked in the join condition, finds every pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import checkpointed, free_name, map_columns
from terravane.llm.graph import components
from terravane.llm.words import mixed

BITS = 64
#: Hashes that are unpacked into bits at once.
BLOCK = 1 << 15


def _hashes(text: str, words: int, distinct: bool, seed: int) -> np.ndarray:
    """The XXH64 values of a text's word shingles, A-Z lower-cased; fewer words are one shingle."""
    found = text.encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    width = min(words, len(found))
    shingles = [line[a : b - 1] for a, b in zip(starts, starts[width:], strict=False)]
    if distinct:
        shingles = list(set(shingles))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), "<u8", len(shingles))


def _majority(values: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(values), BLOCK):
        counts += np.unpackbits(values[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int, distinct: bool = False, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: a bit is 1 if it is set in over half of their XXH64 values."""
    return _majority(_hashes(text, words, distinct, seed))


def fingerprints(df: DataFrame, text: str = "text", words: int = 4, distinct: bool = False, out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each text, in place of the text, as a signed long. Null and wordless texts have fingerprint zero."""

    def rows(texts: pa.Array) -> dict[str, pa.Array]:
        values = np.array([fingerprint(t or "", words, distinct) for t in texts.to_pylist()], np.uint64)
        return {out: pa.array(values.view(np.int64))}

    return map_columns(df, [text], {out: "long"}, rows, without=(text,))


def _set_bits(values: np.ndarray) -> np.ndarray:
    """How many values of each row have each bit set: full adders turn three numbers into a sum and a carry."""
    counts, weight = np.zeros((len(values), BITS), np.int64), 0
    while values.shape[1]:
        carries = [values[:, :0]]
        while (third := values.shape[1] // 3) > 0:
            a, b, c = (values[:, k * third : (k + 1) * third] for k in range(3))
            half = a ^ b
            carries.append((a & b) | (half & c))
            values = np.concatenate([half ^ c, values[:, 3 * third :]], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1, 8), axis=2, bitorder="little")
        counts += bits.sum(axis=1, dtype=np.int64) << weight
        values, weight = np.concatenate(carries, axis=1), weight + 1
    return counts


def _majorities(values: np.ndarray, number: int) -> np.ndarray:
    """The SimHashes of `number` ways to mix the values anew."""
    ways = np.arange(1, number + 1, dtype=np.uint64)[:, None]
    counts = np.zeros((number, BITS), np.int64)
    for i in range(0, len(values), BLOCK):
        counts += _set_bits(mixed(values[None, i : i + BLOCK] ^ ways))
    return np.packbits(counts * 2 > len(values), axis=1, bitorder="little").view("<u8")[:, 0]


#: Longs of a set's parities: for each residue of its hashes, whether an odd number of them has it.
PARITIES = ("odd_0", "odd_1", "odd_2", "odd_3")


def _parities(values: np.ndarray) -> np.ndarray:
    residues = (values >> np.uint64(7)).astype(np.int64) % (BITS * len(PARITIES))
    return np.packbits(np.bincount(residues, minlength=BITS * len(PARITIES)).astype(np.uint8) & 1, bitorder="little").view("<i8")


def several_fingerprints(df: DataFrame, number: int, text: str = "text", words: int = 5) -> DataFrame:
    """df with what is compared of each text's set of shingles, in place of the text.

    prints: `number` fingerprints, of hashes that are mixed anew for each; size: the number of shingles; PARITIES.
    """

    def rows(texts: pa.Array) -> dict[str, pa.Array]:
        values = [_hashes(t or "", words, True, 42) for t in texts.to_pylist()]
        flat = np.concatenate([np.zeros(0, np.uint64), *(_majorities(v, number) for v in values)]).view(np.int64)
        prints = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * number, pa.int32()), pa.array(flat))
        odd = np.array([_parities(v) for v in values], np.int64).reshape(-1, len(PARITIES))
        return {"prints": prints, "size": pa.array([len(v) for v in values], pa.int32()), **{c: pa.array(np.ascontiguousarray(odd[:, k])) for k, c in enumerate(PARITIES)}}

    return map_columns(df, [text], {"prints": "array<long>", "size": "int", **dict.fromkeys(PARITIES, "long")}, rows, without=(text,))


def shingle_sets(df: DataFrame, text: str = "text", words: int = 5, out: str = "shingles") -> DataFrame:
    """df with the distinct hashes of each text's word shingles, in place of the text; wordless texts have none."""

    def rows(texts: pa.Array) -> dict[str, pa.Array]:
        made = [np.unique(_hashes(t or "", words, False, 7)).view(np.int64) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, made)])
        return {out: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *made])))}

    return map_columns(df, [text], {out: "array<long>"}, rows, without=(text,))


def segments(bits: int) -> list[tuple[int, int]]:
    """(start, length) of the fewest segments of which one must differ in at most one bit: 2 * number > bits."""
    number = bits // 2 + 1
    ends = [round(BITS * k / number) for k in range(number + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _mask(start: int, length: int) -> Column:
    value = ((1 << length) - 1) << start
    return F.lit(value - (1 << BITS) if value >> (BITS - 1) else value)


def links(prints: DataFrame, bits: int = 4, column: str = "fingerprint") -> DataFrame:
    """All pairs (low, high) of different fingerprints that differ in at most `bits` bits, each once.

    prints needs each fingerprint once; it is dealt out anew, as each row becomes one for every bit. A pair is reported in the first segment that differs in at most
    one bit; where the segments are equal, at their first bit.
    """
    pieces = segments(bits)
    value = F.col(column)
    variants = [
        F.struct(F.lit(position).alias("position"), F.shiftrightunsigned(value.bitwiseAND(_mask(start, length)).bitwiseAND(F.bitwise_not(_mask(position, 1))), start).alias("rest"))
        for start, length in pieces
        for position in range(start, start + length)
    ]
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select(column).repartition(tasks, column).select(value.alias("value"), F.explode(F.array(*variants)).alias("v"))
    packs = max(length for _, length in pieces) <= BITS - 7  # rest and position fit a long
    if packs:
        rows = rows.select("value", (F.col("v.rest") * BITS + F.col("v.position")).alias("variant"))
    else:
        rows = rows.select("value", F.col("v.rest").alias("variant"), F.col("v.position").alias("position"))
    # Spark sizes the rows as if the explode made none, and would broadcast what is 64 times as large.
    rows = rows.hint("merge")
    a, b = rows.alias("a"), rows.alias("b")
    differ = F.col("a.value").bitwiseXOR(F.col("b.value"))
    few = [F.bit_count(differ.bitwiseAND(_mask(*s))) <= 1 for s in pieces]
    # The greatest of two equal columns names both sides: no part of the condition goes to one side alone,
    # so the sides stay the same plan and are shuffled once.
    position = F.pmod(F.greatest("a.variant", "b.variant"), F.lit(BITS)) if packs else F.greatest("a.position", "b.position")
    first = F.lit(False)
    for k, (start, length) in enumerate(pieces):
        earlier = reduce(and_, (~f for f in few[:k]), F.lit(True))
        same = differ.bitwiseAND(_mask(start, length)) == 0
        first = first | ((position >= start) & (position < start + length) & earlier & (~same | (position == start)))
    met = (F.col("a.variant") == F.col("b.variant")) & (F.col("a.value") < F.col("b.value")) & (F.bit_count(differ) <= bits) & first
    if not packs:
        met = met & (F.col("a.position") == F.col("b.position"))
    return a.join(b, met).select(F.col("a.value").alias("low"), F.col("b.value").alias("high"))


def classes(prints: DataFrame, key: str = "doc_id", column: str = "fingerprint", bits: int = 4) -> DataFrame:
    """One row (fingerprint, component) for each fingerprint of prints: the smallest key its links reach.

    Equal fingerprints are one class, so copies are never paired. Null keys don't count as smallest; a
    class that has no other key has a null component.
    """
    found = checkpointed(prints.groupBy(F.col(column).alias("value")).agg(F.min(key).alias("low_key")))
    roots = components(links(found, bits, "value"), "low", "high")
    joined = found.join(roots.select(F.col("node").alias("value"), "root"), "value", "left")
    # Stored, so that the join with a root of very many fingerprints reads two plain inputs, which adaptive execution can split.
    lowest = checkpointed(joined.groupBy(F.coalesce("root", "value").alias("root")).agg(F.min("low_key").alias("component"), F.count("*").alias("n")).where("n > 1"))
    linked = joined.where("root IS NOT NULL").join(lowest.select("root", "component"), "root").select(F.col("value").alias(column), "component")
    # The root itself has no row in the graph's result.
    known = lowest.select(F.col("root").alias("value"), F.col("component").alias("own"), F.lit(True).alias("is_root"))
    rest = joined.where("root IS NULL").join(known, "value", "left")
    return linked.unionByName(rest.select(F.col("value").alias(column), F.when(F.col("is_root"), F.col("own")).otherwise(F.col("low_key")).alias("component")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4, distinct: bool = False) -> DataFrame:
    """One row (key, fingerprint, component_id) for each row of df, in no order.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows come back as
    often as they are given. An empty table gives an empty result. Other columns aren't carried.
    """
    prints = checkpointed(fingerprints(df.select(key, text), text, words, distinct, "fingerprint").select(key, "fingerprint"))
    found = classes(prints, key, "fingerprint", bits)
    return prints.join(found, "fingerprint").select(key, "fingerprint", F.col("component").alias("component_id"))


def _sizes_near(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be so alike (Jaccard)."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (low, high) of texts whose sets of shingles are at least so alike (Jaccard)."""
    n = lambda side: F.size(f"{side}_set")
    of = lambda side: sets.select(F.col("id").alias(side), F.col("shingles").alias(f"{side}_set"))
    small = (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_SHINGLES
    placed = F.broadcast if small else (lambda x: x)
    both = pairs.join(placed(of("high")), "high").join(placed(of("low")), "low")
    shared = F.size(F.array_intersect("low_set", "high_set"))
    near = _sizes_near(n("low"), n("high"), similarity)
    alike = shared / F.greatest(F.lit(1), n("low") + n("high") - shared) >= similarity
    # Equal sets are alike, empty ones included.
    return both.where(near & (alike | (n("low") + n("high") == 0))).select("low", "high")


#: Texts up to which a list of those wanted is broadcast (16 bytes each); longer lists are joined by shuffling.
BROADCAST_TEXTS = 200_000
#: Shingles of sets that are broadcast (8 bytes each); more are joined by shuffling.
BROADCAST_SHINGLES = 2_000_000


def _sets(named: DataFrame, texts: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles) of the texts in pairs, each read from the row of its smallest key, so that its copies don't meet."""
    ids = pairs.select(F.explode(F.array("low", "high")).alias("id")).distinct()
    wanted = checkpointed(texts.join(ids, "id", "left_semi").select("id", "tid", F.xxhash64("tid", "low_key").alias("spot")))
    found = named.select("tid", "text", F.xxhash64("tid", "key").alias("spot"))
    if wanted.count() <= BROADCAST_TEXTS:
        found = found.join(F.broadcast(wanted.select("spot")), "spot", "left_semi")
    # Rows that repeat key and text are left.
    chosen = found.join(wanted, ["tid", "spot"]).dropDuplicates(["tid", "spot"])
    return checkpointed(shingle_sets(chosen.select("id", "text"), "text", shingle).select("id", "shingles"))


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair once as (low, high); hub is the one that was in b."""
    return pairs.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.max(b).alias("hub"))


def _contracted(links: DataFrame) -> DataFrame:
    """Links (node, root) with the same components as links (low, high, hub): each text's hubs and itself hang on the smallest of them.

    A text has few hubs (those of its buckets); a hub's texts aren't gathered.
    """
    node = F.when(F.col("hub") == F.col("high"), F.col("low")).otherwise(F.col("high"))
    around = links.groupBy(node.alias("id")).agg(F.collect_set("hub").alias("hubs")).select(F.array_append("hubs", F.col("id")).alias("all"))
    hung = around.select(F.explode(F.array_except("all", F.array(F.array_min("all")))).alias("node"), F.array_min("all").alias("root"))
    return hung.distinct()


#: Bits by which the first pass widens segments.
WIDER = 5
#: A candidate's segments: of fingerprints that differ in up to so many bits one differs in at most one bit.
SEGMENTS = segments(5)
#: Bits of a half segment, at most.
HALF = max(length - length // 2 for _, length in SEGMENTS)
#: (start, length) of what is equal, of what may lack a bit, and of both, for each half of each segment.
HALVES = [(half, rest, (start, length)) for start, length in SEGMENTS for low in [(start, length // 2)] for high in [(start + length // 2, length - length // 2)] for half, rest in ((low, high), (high, low))]
#: Rows that a task looks at once, whole buckets aside; pairs that it compares at once.
ROWS, PAIRS = 1 << 16, 1 << 20


def _dealt(slots: DataFrame, pieces: list[tuple[int, int]], width: int) -> DataFrame:
    """slots with a row for each piece: `bucket` has its slot's number, its own and, in `width` bits, the fingerprint's there."""
    found = [
        F.shiftrightunsigned(F.col("value").bitwiseAND(_mask(start, length)), start) + (F.col("slot").cast("long") * len(pieces) + k) * (1 << width)
        for k, (start, length) in enumerate(pieces)
    ]
    return slots.withColumn("bucket", F.explode(F.array(*found)))


def _stars(slots: DataFrame, bits: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of candidates (see groups): each text with at most one other.

    A bucket holds the texts of which a segment and the bits beside it are equal, so its pairs are candidates. Its
    centre is the text that shares buckets with most texts, hence the one that copies with different edits were
    made from; a text is paired with the centre of its buckets that shares with most.
    """
    wide = [(min(start, BITS - length - WIDER), length + WIDER) for start, length in SEGMENTS]
    rows = _dealt(slots, wide, max(length for _, length in wide)).select("id", "size", "value", "bucket")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(rows.join(sizes, "bucket"))
    scores = shared.groupBy("id").agg(F.sum("n").alias("score"))
    first = shared.join(scores, "id").groupBy("bucket").agg(F.max(F.struct("score", "id", "value", "size")).alias("first"))
    near = (F.bit_count(F.col("value").bitwiseXOR(F.col("first.value"))) <= bits) & _sizes_near(F.col("size"), F.col("first.size"), similarity)
    met = shared.join(first, "bucket").where(near & (F.col("id") != F.col("first.id")))
    return met.groupBy(F.col("id").alias("a")).agg(F.max(F.struct("first.score", "first.id")).alias("first")).select("a", F.col("first.id").alias("b"))


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) for each element of sorted columns: of the run of equal ones that it is in."""
    new = reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
    starts = np.flatnonzero(np.concatenate([[True], new]))
    lengths = np.diff(starts, append=len(columns[0]))
    return np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)


def _apart(key: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of places with equal keys and different roots, in blocks; those with the same root are not walked."""
    order = np.argsort(key)
    start, end = _runs(key[order])
    order = order[end - start > 1]
    order = order[np.lexsort((root[order], key[order]))]
    if not len(order):
        return
    others = _runs(key[order], root[order])[1]
    number = _runs(key[order])[1] - others
    at = np.flatnonzero(number)
    for block in np.split(at, np.flatnonzero(np.diff(np.cumsum(number[at]) // PAIRS)) + 1):
        n = number[block]
        second = np.repeat(others[block] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield order[np.repeat(block, n)], order[second]


def _met(rows: dict[str, np.ndarray], bits: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids in whole buckets of half segments: with different roots, deletion variants of the segment in common, at most
    `bits` bits apart, and not ruled out by sizes or parities."""
    kinds = (rows["bucket"] >> HALF) % len(HALVES)
    for kind, (_, (start, length), (whole, both)) in enumerate(HALVES):
        own = {c: v[kinds == kind] for c, v in rows.items()}
        value = own["value"].view(np.uint64)
        rest = (value >> np.uint64(start)).astype(np.int64) & ((1 << length) - 1)
        for position in range(length):
            for a, b in _apart(own["bucket"] << HALF | rest & ~(1 << position), own["root"]):
                differ = value[a] ^ value[b]
                near = np.bitwise_count(differ) <= bits
                if position or kind % 2:
                    # Equal segments have every variant in common and count at the first.
                    near &= (differ >> np.uint64(whole)) & np.uint64((1 << both) - 1) != 0
                a, b = a[near], b[near]
                x, y = own["size"][a].astype(np.int64), own["size"][b].astype(np.int64)
                odd = sum(np.bitwise_count(own[c][a].view(np.uint64) ^ own[c][b].view(np.uint64)).astype(np.int64) for c in PARITIES)
                may = (np.minimum(x, y) >= similarity * np.maximum(x, y)) & (odd <= (1 - similarity) / (1 + similarity) * (x + y) + 1e-9)
                yield own["id"][a[may]], own["id"][b[may]]


def _candidates(slots: DataFrame, bits: int, similarity: float) -> DataFrame:
    """All pairs (a, b) of candidates (see groups) with different roots that may be similar, as often as they share a variant.

    Of segments that differ in at most one bit a half is equal. So rows are dealt out by slot and half, two for a
    segment, and the variants of the other half, each of its bits left out once, are made and met where they are:
    half and variant are the segment's deletion variant, as `links` has it. A task holds ROWS rows and one bucket at a time.
    """
    columns = ["bucket", "id", "root", "value", "size", *PARITIES]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, number
            rows = {c: np.concatenate([h.column(k).to_numpy() for h in held]) for k, c in enumerate(columns)}
            # The last bucket may go on in the next batch.
            whole = number if last else int(np.searchsorted(rows["bucket"], rows["bucket"][-1]))
            for a, b in _met({c: v[:whole] for c, v in rows.items()}, bits, similarity) if whole else ():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held = [pa.RecordBatch.from_arrays([pa.array(rows[c][whole:]) for c in columns], columns)]
            number -= whole

        due = ROWS
        for batch in batches:
            held.append(batch)
            number += batch.num_rows
            if number >= due:
                yield from flush(last=False)
                due = max(ROWS, 2 * number)
        if number:
            yield from flush(last=True)

    rows = _dealt(slots, [half for half, _, _ in HALVES], HALF).select(columns)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 11, prints: int = 10, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row (tid, root, low_key) for each different text: its id, its group's, and the smallest key that has it.

    Texts are candidates if in one of `prints` fingerprints they share a deletion variant of one of SEGMENTS, that is,
    differ there in at most one bit, and differ in at most `bits` bits in all; candidates link if their sets of `shingle`-word shingles are at least `similarity`
    alike; groups are what links reach. The fingerprints are of the same sets. Sets of Jaccard similarity s
    have cosine 2 s / (1 + s) at least, and a bit differs with a chance of acos(cosine) / pi whatever the edit:
    at most 0.152 at 0.8, where 98.7 % of pairs are candidates. Pairs at most five bits apart in any fingerprint always are.

    First each text is compared with one of those that share a segment; then all candidates that are still
    in different groups, but those whose parities prove that they are not similar. A large group is thus joined by at most
    as many comparisons as it has texts, and no link between different groups is lost: the first pass compares only
    candidates too, and parities rule out only pairs that the comparison would.
    """
    named = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tid"))
    seen = several_fingerprints(named, prints, "text", shingle).select("tid", "key", "prints", "size", *PARITIES)
    # Numbers are given to stored rows: they stay the same when a task runs again.
    texts = checkpointed(seen.groupBy("tid").agg(F.min("key").alias("low_key"), F.min("prints").alias("prints"), F.min("size").alias("size"), *(F.min(c).alias(c) for c in PARITIES))).withColumn("id", F.monotonically_increasing_id())
    slots = texts.select("id", "size", *PARITIES, F.posexplode("prints").alias("slot", "value"))
    first = checkpointed(_ordered(_stars(slots, bits, similarity), "a", "b"))
    linked = _similar(first, _sets(named, texts, first, shingle), similarity).join(first, ["low", "high"])
    roots = components(_contracted(linked), "node", "root").select(F.col("node").alias("id"), "root")

    placed = slots.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    second = checkpointed(_ordered(_candidates(placed, bits, similarity), "a", "b").join(first, ["low", "high"], "left_anti"))
    more = _similar(second, _sets(named, texts, second, shingle), similarity)
    # Between groups only: the first pass's links are not walked again.
    for side in ("low", "high"):
        more = more.join(roots.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    final = components(more.select(F.coalesce("low_root", "low").alias("a"), F.coalesce("high_root", "high").alias("b")), "a", "b")
    grouped = texts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    found = grouped.join(final.select(F.col("node").alias("root"), F.col("root").alias("final")), "root", "left")
    return found.select("tid", F.coalesce("final", "root").alias("root"), "low_key")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of df that stand for their near-duplicate group (see groups): that of the smallest key.

    Null and wordless texts are one group. Of rows that repeat the key and text one stays; a null key counts
    as larger than any; of equal keys the text with the smallest MD5 counts. An empty table gives an empty
    result. All columns stay as they are, whatever their names.
    """
    found = checkpointed(groups(df, key, text, **settings))
    order = F.struct(F.col("low_key").isNull(), "low_key", "tid")
    winners = found.groupBy("root").agg(F.min(order).alias("w")).select("w.tid", "w.low_key")
    own_text, own_key, spot = free_name(df, "own_text"), free_name(df, "own_key"), free_name(df, "spot")
    own = df.withColumn(own_text, F.md5(F.coalesce(F.col(text), F.lit("")))).withColumn(own_key, F.col(key))
    # One number names text and key in the join and in what follows, so that the texts are moved once.
    own = own.withColumn(spot, F.xxhash64(own_text, own_key))
    winners = winners.select(F.xxhash64("tid", "low_key").alias("won"), "tid", "low_key")
    kept = own.join(winners, (F.col(spot) == F.col("won")) & (F.col(own_text) == F.col("tid")), "left_semi")
    return kept.dropDuplicates([spot, own_text]).drop(own_text, own_key, spot)


def hexadecimal(column: str = "fingerprint") -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
