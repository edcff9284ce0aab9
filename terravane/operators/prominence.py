"""Prominence of peaks: merge trees by tile, reduced to border cells and open peaks, then joined in rounds.

A peak's prominence is its height over its key col: the highest level at which ground connected with it, eight ways,
holds something higher. Of equal heights the cell that comes first by row and column counts as higher.

In a tile every cell belongs to the peak that steepest ascent leads to; two neighbouring basins meet at the lower of the
two cells at best. Joining basins from the highest such meeting downward, as a maximum spanning tree is built, the lower
of two peaks ends at the meeting's height. It is settled if its ground has no cell on the tile's border; else a way
beyond the border might be higher, so the peak, the border cells and the meeting go on to the next round as a tree.
There four by four tiles are joined along their seams the same way, and so on; what is passed on grows with a border, not
with an area. At last only ground at the raster's own edge is left: its peaks are open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.session import checkpointed

#: Tiles along the edge of what is joined in a round.
FAN = 4
NODE, EDGE, SETTLED, OPEN = 0, 1, 2, 3
#: kind; a, b: cells as row * columns + col; v: height of a node or peak, level of an edge; w: a peak's key col; peak: whether a node is one.
_SCHEMA = "br long, bc long, kind int, a long, b long, v double, w double, peak boolean"
_STEPS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
_COLUMNS = ["kind", "a", "b", "v", "w", "peak"]


def _basins(cell: np.ndarray, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of cells (ascending) and heights: the place of each cell's peak, and the best meetings of basins (places p, q, level)."""
    row, col = cell // width, cell % width
    # Rank by height, the first cell of equals highest.
    order = np.lexsort((-cell, v))
    rank = np.empty(len(v), np.int64)
    rank[order] = np.arange(len(v))
    up, best = np.arange(len(v)), rank.copy()
    meet = []
    for dr, dc in _STEPS:
        inside = (col + dc >= 0) & (col + dc < width) & (row + dr >= 0)
        wanted = cell + dr * width + dc
        at = np.searchsorted(cell, wanted)
        there = inside & (at < len(cell))
        there[there] = cell[at[there]] == wanted[there]
        mine, other = np.flatnonzero(there), at[there]
        better = rank[other] > best[mine]
        up[mine[better]], best[mine[better]] = other[better], rank[other[better]]
        if (dr, dc) > (0, 0):
            meet.append((mine, other))
    while True:
        further = up[up]
        if np.array_equal(further, up):
            break
        up = further
    x, y = (np.concatenate(c) for c in zip(*meet, strict=True))
    p, q = up[x], up[y]
    apart = p != q
    p, q, level = np.minimum(p, q)[apart], np.maximum(p, q)[apart], np.minimum(v[x], v[y])[apart]
    first = np.lexsort((-level, q, p))
    p, q, level = p[first], q[first], level[first]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) if len(p) else np.zeros(0, bool)
    return up, p[new], q[new], level[new]


def _joined(cell: np.ndarray, v: np.ndarray, peak: np.ndarray, border: np.ndarray, p: np.ndarray, q: np.ndarray, level: np.ndarray, last: bool) -> list[tuple]:
    """Rows of _COLUMNS: what the nodes and edges (places p, q, level) leave when joined from the highest level down."""
    parent = list(range(len(cell)))
    # The highest node of each tree, by height, then by the first cell.
    order = np.lexsort((-cell, v))
    rank = np.empty(len(v), np.int64)
    rank[order] = np.arange(len(v))
    rank = rank.tolist()
    # How high a way leads from each tree's top to the border; above a join's level it may lead on to higher ground beyond.
    top, reach = list(range(len(cell))), np.where(border, v, -np.inf).tolist()
    out, kept, peak = [], set(), peak.copy()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in np.argsort(-level, kind="stable").tolist():
        a, b = find(int(p[k])), find(int(q[k]))
        if a == b:
            continue
        if rank[top[a]] < rank[top[b]]:
            a, b = b, a
        high, low, w = top[a], top[b], float(level[k])
        if reach[b] <= w or last:
            if peak[low] and v[low] > w:
                out.append((SETTLED if reach[b] <= w else OPEN, int(cell[low]), None, float(v[low]), w, True))
            peak[low] = False
        if reach[b] > -np.inf and not last:
            out.append((EDGE, int(cell[high]), int(cell[low]), w, None, None))
            kept |= {high, low}
        parent[b] = a
        reach[a] = max(reach[a], min(reach[b], w))
    for x in range(len(cell)):
        if parent[x] == x:
            touches = reach[x] > -np.inf
            if touches:
                kept.add(top[x])
            if peak[top[x]] and (last or not touches):
                out.append((OPEN if touches else SETTLED, int(cell[top[x]]), None, float(v[top[x]]), None, True))
    if not last:
        out += [(NODE, int(cell[x]), None, float(v[x]), None, bool(peak[x])) for x in sorted(kept)]
    return out


def _table(br: int, bc: int, rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    n = len(rows)
    return pa.Table.from_arrays([pa.array([br] * n, pa.int64()), pa.array([bc] * n, pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["br", "bc", *_COLUMNS])


def _on_border(cell: np.ndarray, width: int, span: int, box: tuple[int, int, int, int]) -> np.ndarray:
    """Whether cells lie on the border of their block of `span` cells, or on the raster's own edge."""
    row, col = cell // width, cell % width
    r0, c0, r1, c1 = box
    inner = (row % span > 0) & (row % span < span - 1) & (col % span > 0) & (col % span < span - 1)
    return ~(inner & (row > r0) & (row < r1) & (col > c0) & (col < c1))


def _join(below: int, span: int, width: int, box: tuple[int, int, int, int], last: bool):
    """What joins the trees of blocks of `below` cells to those of one of `span`."""

    def join(key: tuple, group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        node, line = group.filter(pa.array(kind == NODE)), group.filter(pa.array(kind == EDGE))
        cell, v = node.column("a").to_numpy(), node.column("v").to_numpy()
        order = np.argsort(cell)
        cell, v = cell[order], v[order]
        peak = node.column("peak").to_numpy(zero_copy_only=False)[order].astype(bool)
        ends = [np.searchsorted(cell, line.column(c).to_numpy()) for c in ("a", "b")]
        levels = [line.column("v").to_numpy()]
        owner = cell // width // below * (width // below + 1) + cell % width // below
        for dr, dc in _STEPS:
            if (dr, dc) > (0, 0):  # each seam from one side
                wanted = cell + dr * width + dc
                at = np.searchsorted(cell, wanted)
                x = np.flatnonzero((at < len(cell)) & (cell % width + dc >= 0))
                x = x[cell[at[x]] == wanted[x]]
                x = x[owner[x] != owner[at[x]]]
                ends = [np.concatenate([ends[0], x]), np.concatenate([ends[1], at[x]])]
                levels.append(np.minimum(v[x], v[at[x]]))
        border = _on_border(cell, width, span, box)
        return _table(key[0].as_py(), key[1].as_py(), _joined(cell, v, peak, border, *ends, np.concatenate(levels), last))

    return join


def prominences(cells: DataFrame, edge: int = 512, least: float = 0.0, sea: float = 0.0, fan: int = FAN) -> DataFrame:
    """(row, col, v, prominence, key_col, open): the peaks of a raster (row, col, v), rows and columns from 0.

    Cells that are null, not a number or not there are the sea: ground that only the sea parts from higher ground has its height over
    `sea` as prominence and no key col. Peaks whose ground reaches the raster's edge before anything higher are open: their
    prominence is null, as the way beyond is not known, and key_col is the lowest that it can be (null if the raster has
    nothing higher). Peaks of less than `least` are left out, open ones by their height over key_col. A row and column that come
    twice are an error of the raster: the greater height counts.

    A task holds the cells of a tile of `edge` cells, or the border trees of fan * fan blocks.
    """
    known = cells.where("v IS NOT NULL AND NOT isnan(v)").groupBy("row", "col").agg(F.max(F.col("v").cast("double")).alias("v"))
    r0, c0, r1, c1 = known.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
    spark = cells.sparkSession
    if r0 is None:
        return spark.createDataFrame([], "row long, col long, v double, prominence double, key_col double, open boolean")
    # One column more than there are, so that no two neighbours of different rows have numbers that follow each other.
    width, box, span = c1 + 2, (r0, c0, r1, c1), edge
    whole = lambda s: r0 // s == r1 // s and c0 // s == c1 // s

    def tile(key: tuple, group: pa.Table) -> pa.Table:
        cell, v = group.column("a").to_numpy(), group.column("v").to_numpy()
        order = np.argsort(cell)
        cell, v = cell[order], v[order]
        up, p, q, level = _basins(cell, v, width)
        border = _on_border(cell, width, edge, box)
        peak = up == np.arange(len(cell))
        # Nodes are peaks and border cells; a border cell hangs on its peak at its own height.
        hung = np.flatnonzero(border & ~peak)
        rows = _joined(cell, v, peak, border, np.concatenate([p, hung]), np.concatenate([q, up[hung]]), np.concatenate([level, v[hung]]), whole(edge))
        return _table(key[0].as_py(), key[1].as_py(), rows)

    block = lambda c, s: F.floor(F.col(c) / s).alias({"row": "br", "col": "bc"}[c])
    first = known.select(block("row", span), block("col", span), (F.col("row") * width + F.col("col")).alias("a"), "v")
    state = checkpointed(first.groupBy("br", "bc").applyInArrow(tile, _SCHEMA))
    peaks = state.where(F.col("kind") >= SETTLED)
    while not whole(span):
        below, span = span, span * fan
        trees = state.where(F.col("kind") < SETTLED).withColumns({"br": F.floor(F.col("br") / fan), "bc": F.floor(F.col("bc") / fan)})
        state = checkpointed(trees.groupBy("br", "bc").applyInArrow(_join(below, span, width, box, whole(span)), _SCHEMA))
        peaks = peaks.unionByName(state.where(F.col("kind") >= SETTLED))
    is_open = F.col("kind") == OPEN
    height = F.col("v") - F.coalesce("w", F.when(is_open, F.lit(float("-inf"))).otherwise(F.lit(float(sea))))
    found = peaks.where(height >= least)
    return found.select(
        F.floor(F.col("a") / width).alias("row"), (F.col("a") % width).alias("col"), "v",
        F.when(~is_open, height).alias("prominence"), F.col("w").alias("key_col"), is_open.alias("open"),
    )
