"""Merging layers of objects by position, and choosing among their attributes."""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import graph, spatial
from terravane.session import Rounds, checkpointed

LOG = logging.getLogger(__name__)

# Trust in a height's source; a layer's radius in metres.
TRUST = {"mtk": 3, "aip": 3, "vayla": 2, "osm": 1}
RADII = {"aip": 150.0, "osm": 60.0, "buildings": 30.0, "vayla": 70.0}
CARRIED = ("focal_m", "focal_agl_m", "daymark_agl_m", "vayla_type", "vayla_id", "in_service", "owner")
#: Components of places up to which one task takes their rows in order, and the rows and pairs of places that components put together have.
COMPONENT = {"rows": 1 << 18, "spots": 1 << 14, "pairs": 1 << 17}
TASK_WORK = 1 << 16
# Co-location radius, and which kind of mark stands for several.
COLLAPSE_M = 10.0
MARK_RANK = {"Merimajakka": 6, "Tunnusmajakka": 5, "Reunamerkki": 4, "Sektoriloisto": 3, "Tutkamerkki": 2, "Apuloisto": 2, "Suuntaloisto": 2, "Linjamerkki": 1}
FOLDED = ("focal_m", "focal_agl_m", "daymark_agl_m", "name", "vayla_id")


def trust(source: Column) -> Column:
    return F.coalesce(*(F.when(source == s, F.lit(r)) for s, r in TRUST.items()), F.lit(0))


def _known(c: str, kind: str) -> Column:
    """A column's value, null where it says nothing: not a number, or an empty text."""
    if kind == "string":
        return F.nullif(F.col(c), F.lit(""))
    return F.when(~F.isnan(c), F.col(c)) if kind in ("double", "float") else F.col(c)


def _candidate_height(own: Column, own_trust: Column, states: Column, at: Column) -> Column:
    """The height that an object has for a row that comes at `at`: of its own and of those absorbed before, the most trusted, then first."""
    entry = lambda trust, when, h: F.struct(trust.alias("trust"), (-when).alias("first"), h.alias("h"))
    mine = F.when(own.isNotNull(), F.array(entry(own_trust, F.lit(-(1 << 62)), own))).otherwise(F.array().cast("array<struct<trust:int,first:bigint,h:double>>"))
    others = F.transform(F.filter(F.coalesce(states, F.array().cast("array<struct<trust:int,at:bigint,h:double>>")), lambda s: s["at"] < at), lambda s: entry(s["trust"], s["at"], s["h"]))
    return F.array_max(F.concat(mine, others))["h"]


def settle(pairs: DataFrame, heights: DataFrame | None = None, sure: float = -1.0) -> DataFrame:
    """(id, into): what each row of candidate pairs goes into when rows are taken in order; null if it stays.

    pairs: a_id, b_id, b_stays (b is no row that may go), choice (the least is tried first), and with heights a_at, a_h, d; each b
    comes before its a. A row goes to the first candidate that stays and, with heights (id, at, h, trust), whose height at
    that time agrees or that is at most `sure` metres away. Absorbing a more trusted height changes an object's.

    All rows decide at once by what the others decided the round before, until nothing changes. As a row depends on earlier ones
    only, that state is the one that taking them in order leads to. Only rows whose candidates changed decide
    again. The rounds are the longest chain of decisions that overturn each other, logged at the end; no task
    holds more than a row's candidates, or an object's heights by trust, of which there are as many as TRUST has levels.
    """
    kept = Rounds(pairs.sparkSession)
    pairs = checkpointed(pairs)
    decided = kept.keep(pairs.select(F.col("a_id").alias("id")).distinct().select("id", F.lit(None).cast("bigint").alias("into"), F.lit(None).cast("bigint").alias("old"), F.lit(True).alias("changed")))
    rounds, active = 0, pairs
    while not decided.where("changed").isEmpty():
        if rounds:
            moved = decided.where("changed").select(F.explode(F.array("id", "into", "old")).alias("b_id")).where("b_id IS NOT NULL").distinct()
            again = pairs.join(moved, "b_id", "left_semi").select("a_id").distinct()
            active = pairs.join(again, "a_id", "left_semi")
        rounds += 1
        met = active.join(decided.select(F.col("id").alias("b_id"), F.col("into").isNotNull().alias("gone")), "b_id", "left")
        allowed = F.col("b_stays") | ~F.coalesce("gone", F.lit(False))
        if heights is not None:
            first = F.min_by(F.struct("trust", "at", "h"), "at").alias("s")
            taken = decided.where("into IS NOT NULL").select("id", "into").join(heights.where("h IS NOT NULL"), "id").groupBy("into", "trust").agg(first)
            states = taken.groupBy(F.col("into").alias("b_id")).agg(F.collect_list("s").alias("states"))
            met = met.join(states, "b_id", "left")
            height = _candidate_height(F.col("b_h"), F.col("b_trust"), F.col("states"), F.col("a_at"))
            allowed = allowed & (spatial.heights_agree(F.col("a_h"), height) | (F.col("d") <= sure))
        fresh = met.groupBy(F.col("a_id").alias("id")).agg(F.min_by("b_id", F.when(allowed, F.col("choice"))).alias("new"), F.lit(True).alias("again"))
        now = F.when(F.col("again"), F.col("new")).otherwise(F.col("into"))
        both = decided.select("id", "into").join(fresh, "id", "left")
        decided = kept.keep(both.select("id", now.alias("into"), F.col("into").alias("old"), (~now.eqNullSafe(F.col("into"))).alias("changed")))
        LOG.debug("round %d", rounds)
    LOG.info("settled in %d rounds", rounds)
    return kept.last(decided.select("id", "into"))


def _first(heights: np.ndarray, start: int, end: int, own: float) -> int:
    """The first place from start to end with a height that agrees with a row's own, else end; unknown ones are nan. See spatial.heights_agree."""
    size = 64
    while start < end:
        part = heights[start : min(end, start + size)]
        fits = np.isnan(part) | (np.abs(part - own) <= np.maximum(spatial.VETO_M, spatial.VETO_SHARE * np.maximum(part, own)))
        k = int(fits.argmax())
        if fits[k]:
            return start + k
        start, size = start + size, 2 * size
    return end


def _taken_in_order(points: pa.Table, near: pa.Table, sure: float) -> pa.Table:
    """(id, into) of the rows of whole components that go: each row by seq looks through what its place meets, place by place.

    points: id, seq, h, trust, incoming, spot; near: a, b (spots), d, i, j, the order in which a's rows walk over places. Of
    places that are equal in it the first row by seq counts. An object's height is the most trusted that it has met, then the first.
    """
    order = np.argsort(points.column("seq").to_numpy())
    ids, spots, heights, trusts, incoming = (points.column(c).to_numpy()[order] for c in ("id", "spot", "h", "trust", "incoming"))
    names, spot = np.unique(spots, return_inverse=True)
    a, b = (np.searchsorted(names, near.column(c).to_numpy()) for c in "ab")
    d, i, j = (near.column(c).to_numpy() for c in "dij")
    walks: dict[int, list] = {}
    last = None
    for k in np.lexsort((j, i, d, a)):
        if (at := (a[k], d[k], i[k], j[k])) != last:
            walks.setdefault(int(a[k]), []).append((bool(d[k] <= sure), []))
            last = at
        walks[int(a[k])][-1][1].append(int(b[k]))
    # The objects of a place lie side by side, as they came, from start to end.
    start = np.concatenate([[0], np.cumsum(np.bincount(spot))])
    first = int(incoming.argmax()) if incoming.any() else len(ids)
    held = np.argsort(spot[:first], kind="stable")
    have = np.bincount(spot[:first], minlength=len(names))
    end = start[:-1] + have
    place = np.arange(first) + np.repeat(start[:-1] - (np.cumsum(have) - have), have)
    who, h, trust = np.zeros(len(ids), np.int64), np.full(len(ids), np.nan), np.full(len(ids), -1)
    # An unknown height is trusted less than any.
    own = np.where(np.isnan(heights), -1, trusts)
    who[place], h[place], trust[place] = held, heights[held], own[held]
    gone, into = [], []
    for row in range(first, len(ids)):
        x, found = heights[row], -1
        for near_enough, others in walks.get(int(spot[row]), ()) if incoming[row] else ():
            for s in others:
                k = int(start[s]) if near_enough or np.isnan(x) else _first(h, int(start[s]), int(end[s]), x)
                if k < end[s] and (found < 0 or who[k] < who[found]):
                    found = k
            if found >= 0:
                break
        if found >= 0:
            gone.append(ids[row])
            into.append(ids[who[found]])
            if own[row] > trust[found]:
                h[found], trust[found] = x, own[row]
        else:
            k = end[spot[row]]
            who[k], h[k], trust[k] = row, x, own[row]
            end[spot[row]] += 1
    return pa.table({"id": pa.array(gone, pa.int64()), "into": pa.array(into, pa.int64())})


def _merged_into(point: DataFrame, radius: float, sure: float) -> DataFrame:
    """(id, into) of incoming rows that go into another one, for `merge`.

    Rows of one position and category meet the same others in the same order, so positions are joined, not rows, and
    a place with very many rows costs no pairs. What reaches no common place is independent: small components of places are
    taken in order, some of them together in a task; in larger ones (see COMPONENT) rows are paired and settled in rounds.
    """
    place = ["lat", "lon", "cat"]
    own = F.when(F.col("incoming"), F.col("seq"))
    spots = checkpointed(point.groupBy(place).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("seq").alias("first"), F.max(own).alias("last")))
    met = spatial.range_join(spots.where("last IS NOT NULL"), spots, radius).where((F.col("b_first") < F.col("a_last")) & spatial.compatible(F.col("a_cat"), F.col("b_cat")))
    scan = spatial.scan_order("a_lat", "a_lon", "b_lat", "b_lon", "b_first")
    near = checkpointed(met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "d", scan["i"].alias("i"), scan["j"].alias("j")))
    nodes = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    reached = graph.components(near.where("a != b"), "a", "b").withColumnRenamed("node", "id")
    placed = checkpointed(spots.join(nodes, "id").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id")))
    pairs = near.join(placed.select(F.col("id").alias("a"), "component"), "a")
    sizes = placed.groupBy("component").agg(F.sum("n").alias("rows"), F.count("*").alias("spots")).join(pairs.groupBy("component").agg(F.count("*").alias("pairs")), "component")
    small = F.lit(True)
    for c, most in COMPONENT.items():
        small = small & (F.col(c) <= most)
    sizes = checkpointed(sizes.withColumn("small", small))
    some, work, whole = sizes.agg(F.count_if("small"), F.sum(F.when(F.col("small"), F.col("rows") + F.col("pairs"))), F.every("small")).first()
    rows = point.join(placed.select(F.col("id").alias("spot"), "component", *place), place).join(sizes.select("component", "small"), "component")
    found = []
    if some:
        tasks = max(int(point.sparkSession.conf.get("spark.sql.shuffle.partitions")), work // TASK_WORK + 1)
        task = F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task")
        theirs = rows.where("small").select(task, "id", "seq", "h", "trust", "incoming", "spot")
        walks = pairs.join(sizes.where("small").select("component"), "component").select(task, "a", "b", "d", "i", "j")
        run = lambda points, places: _taken_in_order(points, places, sure)
        found.append(theirs.groupBy("task").cogroup(walks.groupBy("task")).applyInArrow(run, "id bigint, into bigint"))
    if whole is False:
        crowd = rows.where("NOT small").select(point.columns)
        each = spatial.range_join(crowd.where("incoming"), crowd, radius)
        each = each.where((F.col("b_seq") < F.col("a_seq")) & spatial.compatible(F.col("a_cat"), F.col("b_cat")))
        choice = F.struct("d", spatial.scan_order("a_lat", "a_lon", "b_lat", "b_lon", "b_seq").alias("scan"), "b_id").alias("choice")
        each = each.select("a_id", "b_id", (~F.col("b_incoming")).alias("b_stays"), choice, F.col("a_seq").alias("a_at"), "a_h", "b_h", "b_trust", "d")
        found.append(settle(each, crowd.select("id", F.col("seq").alias("at"), "h", "trust"), sure).where("into IS NOT NULL"))
    if not found:
        return point.limit(0).select("id", F.col("id").alias("into"))
    return reduce(DataFrame.unionByName, found)


def _folded(rows: DataFrame, decided: DataFrame, order: Column, first: list[str], more: dict[str, Column]) -> DataFrame:
    """(into, first columns, more): of the rows that go into each object the first known value of each column, in order."""
    kinds = dict(rows.dtypes)
    taken = rows.join(decided.where("into IS NOT NULL"), "id").withColumn("_order", order)
    picks = [F.min_by(_known(c, kinds[c]), F.when(_known(c, kinds[c]).isNotNull(), F.col("_order"))).alias(f"_{c}") for c in first]
    return taken.groupBy(F.col("into").alias("id")).agg(*picks, *(v.alias(f"_{c}") for c, v in more.items()))


def merge(base: DataFrame, incoming: DataFrame, radius: float, sure: float = -1.0) -> DataFrame:
    """base with incoming merged in: each incoming row, by seq, goes into the nearest compatible row or becomes one.

    Nearest means by exact distance, of equals the one met first in a walk over the cells around (spatial.scan_order).
    Rows have seq (long, unique over both, base first), id, cat, lat, lon, height_m, src_h, srcs and any of the
    carried fields; ids are longs, unique over both. Candidates are pairs within the radius with compatible categories; which of them
    merge depends on the order, as heights change with every merge: see `_merged_into` and `settle`. Within `sure` metres heights don't count.
    """
    return merge_noting(base, incoming, radius, sure)[0]


def merge_noting(base: DataFrame, incoming: DataFrame, radius: float, sure: float = spatial.SURE_M) -> tuple[DataFrame, DataFrame]:
    """What `merge` gives, and (id, into, d, height_m, into_height_m): the rows merged although heights, as registered, disagree."""
    rows = base.withColumn("incoming", F.lit(False)).unionByName(incoming.withColumn("incoming", F.lit(True)), allowMissingColumns=True)
    kinds = dict(rows.dtypes)
    rows = checkpointed(rows)
    point = rows.select("id", "seq", "lat", "lon", "cat", "incoming", _known("height_m", kinds["height_m"]).cast("double").alias("h"), trust(F.col("src_h")).alias("trust"))
    decided = checkpointed(_merged_into(point, radius, sure))
    fields = [c for c in (*CARRIED, "ground_m", "name", "obst_id") if c in rows.columns]
    height = F.struct(trust(F.col("src_h")).alias("t"), (-F.col("seq")).alias("first"), F.col("height_m").alias("h"), F.col("src_h").alias("s"))
    known = _known("height_m", kinds["height_m"]).isNotNull()
    more = {"height": F.max(F.when(known, height)), "srcs": F.flatten(F.collect_set(F.coalesce("srcs", F.array().cast("array<string>"))))}
    folded = _folded(rows, decided, F.col("seq"), fields, more)
    kept = rows.join(decided.where("into IS NOT NULL"), "id", "left_anti").join(folded, "id", "left")
    better = F.col("_height").isNotNull() & (~F.coalesce(known, F.lit(False)) | (F.col("_height.t") > trust(F.col("src_h"))))
    changed = {c: F.coalesce(_known(c, kinds[c]), F.col(f"_{c}"), F.col(c)) for c in fields}
    changed |= {"height_m": F.when(better, F.col("_height.h")).otherwise(F.col("height_m")), "src_h": F.when(better, F.col("_height.s")).otherwise(F.col("src_h"))}
    own = F.coalesce("srcs", F.array().cast("array<string>"))
    changed["srcs"] = F.when(F.col("_srcs").isNotNull(), F.array_sort(F.array_distinct(F.concat(own, F.coalesce("_srcs", F.array().cast("array<string>")))))).otherwise(F.col("srcs"))
    objects = kept.select(*(changed.get(c, F.col(c)).alias(c) for c in rows.columns if c != "incoming"))
    of = lambda side, key: point.select(F.col("id").alias(key), *(F.col(c).alias(f"{side}_{c}") for c in ("lat", "lon", "h")))
    both = decided.where("into IS NOT NULL").join(of("a", "id"), "id").join(of("b", "into"), "into")
    noted = both.withColumn("d", geo.flat_metres(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    odd = noted.where(spatial.near_conflict(F.col("a_h"), F.col("b_h"), F.col("d"), sure))
    return objects, odd.select("id", "into", "d", F.col("a_h").alias("height_m"), F.col("b_h").alias("into_height_m"))


def collapse(marks: DataFrame, radius: float = COLLAPSE_M) -> DataFrame:
    """marks with those at one place made one: the highest kind stays and takes what it lacks from the others.

    Rows have id, lat, lon, vayla_type and the folded fields. In order of kind, then height, then id, each mark goes
    to a kept one within the radius, or is kept. Of several it is the first in a walk over the cells around, then
    by kind, height and id; not the nearest. See `settle`.

    Of a position only its first mark can be kept: the others meet it, or else what it went into. So first marks are
    settled, and the others look only at those of them that are kept.
    """
    hint = F.greatest(F.col("focal_agl_m"), F.col("daymark_agl_m"), F.col("focal_m"))
    rank = F.coalesce(*(F.when(F.col("vayla_type") == t, F.lit(r)) for t, r in MARK_RANK.items()), F.lit(0))
    rows = checkpointed(marks.withColumn("_at", F.struct((-rank).alias("rank"), (-F.coalesce(hint, F.lit(0.0))).alias("hint"), "id")))
    point = rows.select("id", "lat", "lon", F.col("_at").alias("at"))
    firsts = checkpointed(point.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.min("at").alias("at"), F.count("*").alias("n")).select("at.id", "lat", "lon", "at", "n"))
    cell = lambda c: F.floor(F.col(c) / spatial.CELL_DEG)
    walk = [(cell("b_lat") - cell("a_lat")).alias("i"), (cell("b_lon") - cell("a_lon")).alias("j"), "b_at"]
    near = checkpointed(spatial.range_join(firsts, firsts, radius).select("a_id", "a_lat", "a_lon", "a_at", "a_n", "b_id", "b_at", F.struct(*walk).alias("choice")))
    of_firsts = settle(near.where("b_at < a_at").select("a_id", "b_id", F.lit(False).alias("b_stays"), "choice"))
    gone = of_firsts.where("into IS NOT NULL")
    # The kept ones that a position's other marks meet; its own first mark is one of them or has gone.
    kept_near = near.where("a_n > 1").join(gone.select(F.col("id").alias("b_id")), "b_id", "left_anti").select(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), F.col("a_id").alias("own"), "b_id", "b_at", "choice")
    others = point.join(kept_near, ["lat", "lon"]).where("id != own AND b_at < at").groupBy("id").agg(F.min_by("b_id", "choice").alias("into"))
    decided = gone.select("id", "into").unionByName(others)
    folded = _folded(rows, decided, F.col("_at"), list(FOLDED), {})
    kinds = dict(rows.dtypes)
    kept = rows.join(decided.where("into IS NOT NULL"), "id", "left_anti").join(folded, "id", "left")
    changed = {c: F.coalesce(_known(c, kinds[c]), F.col(f"_{c}"), F.col(c)) for c in FOLDED}
    return kept.select(*(changed.get(c, F.col(c)).alias(c) for c in marks.columns))


def focal_height(agl: Column, daymark: Column, water: Column, ground: Column) -> tuple[Column, Column]:
    """(height, basis) from a light's heights: above ground, else the daymark's, else above water where the ground is low."""
    above = F.coalesce(F.nullif(agl, F.lit(0.0)), daymark)
    low = F.when(ground <= 2.0, water)
    return F.round(F.coalesce(above, low), 1), F.when(above.isNotNull(), "agl").when(low.isNotNull(), "water")


def provenance(sources: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(sources, lambda s: s.isNotNull() & (s != "")))), "+")


def last_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of the last row of each key."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))

