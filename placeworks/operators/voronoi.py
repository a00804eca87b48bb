"""Nearest-point cells, and the zones of labels made of them.

A point's cell is a box cut by the bisectors with its neighbours, the nearest
first. Neighbours come from cells of the plane: those within a reach are
complete, and once the farthest corner of a cell is nearer than half of the
reach no point beyond it can cut the cell any more. Points whose cells are not
closed by then look again, twice as far. The first reach is halved until few
points are that near. The points of a cell of the plane and those around it
come as one row, and the cells of many points are cut together.

A corner is computed from the three points that it is equally far from, in the
order of their ids, so all cells that meet there have the same corner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import shapes, spatial
from .cut import cut

#: Decimals of corners: where four points are equally far, the corners of three of them are the same but for rounding.
DECIMALS = 6
#: Pairs of points that are looked at together.
PAIRS_AT_ONCE = 1 << 20
#: Cells along a district's longer side that tell what is inside or outside as a whole.
CELLS_ALONG = 128

Box = tuple[float, float, float, float]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n[0] numbers from first[0] on, then the n[1] from first[1] on, ..."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _clipped(own: np.ndarray, others: np.ndarray, first: np.ndarray, box: Box) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What bounds the cells of many places, in turn (a row each, of as many as it has), and the distances of their farthest corners.

    The i-th meets others[first[i] : first[i + 1]], the nearest first. What
    bounds it is told by the place among others; -1 to -4 are sides of the box.
    """
    x1, y1, x2, y2 = box
    corners = np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)]) - own[:, None]  # side i leaves corner i
    sides, n = np.tile([-1, -2, -3, -4], (len(own), 1)), np.full(len(own), 4)
    far2 = (corners**2).sum(2).max(1, initial=0)
    open_, step = np.arange(len(own)), 0
    while True:
        open_ = open_[(first[open_] + step < first[open_ + 1]) & (n[open_] > 0)]
        at = first[open_] + step
        away = others[at] - own[open_]
        apart2 = (away**2).sum(1)
        near = apart2 <= 4 * far2[open_]
        open_, at, away, apart2 = open_[near], at[near], away[near], apart2[near]
        if not len(open_):
            return sides, n, np.sqrt(far2)
        step += 1
        over = corners[open_, :, 0] * away[:, :1] + corners[open_, :, 1] * away[:, 1:] - apart2[:, None] / 2
        there = np.arange(corners.shape[1]) < n[open_][:, None]
        cut_ = np.flatnonzero(((over > 0) & there).any(1))
        if not len(cut_):
            continue
        who, over, there, at = open_[cut_], over[cut_], there[cut_], at[cut_]
        old, old_sides, out = corners[who], sides[who], over > 0
        after = np.tile(np.arange(1, corners.shape[1] + 1) % corners.shape[1], (len(who), 1))
        after[np.arange(len(who)), n[who] - 1] = 0
        to = np.take_along_axis(over, after, 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            crossing = old + (np.take_along_axis(old, after[..., None], 1) - old) * (over / (over - to))[..., None]
        # Leaving the kept side the new edge is the bisector, entering it the old one goes on.
        new = np.stack([old, crossing], 2).reshape(len(who), -1, 2)
        new_sides = np.stack([old_sides, np.where(out, old_sides, at[:, None])], 2).reshape(len(who), -1)
        kept = np.stack([~out & there, (out != (to > 0)) & there], 2).reshape(len(who), -1)
        place, now = np.cumsum(kept, 1) - 1, kept.sum(1)
        more = now.max() - corners.shape[1]
        if more > 0:
            corners, sides = np.pad(corners, ((0, 0), (0, more), (0, 0))), np.pad(sides, ((0, 0), (0, more)))
        i, j = np.nonzero(kept)
        corners[who] = 0.0  # what is behind the last corner is no nearer or farther than the place itself
        corners[who[i], place[i, j]] = new[i, j]
        sides[who[i], place[i, j]] = new_sides[i, j]
        gone = now < 3
        corners[who[gone]] = 0.0
        n[who] = np.where(gone, 0, now)
        far2[who] = (corners[who] ** 2).sum(2).max(1)


def _corners(rank: np.ndarray, px: np.ndarray, py: np.ndarray, side: np.ndarray, box: Box) -> np.ndarray:
    """Where the bisectors of the three points of each row meet, whatever their turn; where side is one of the box, that of the two of least rank meets it."""
    order = np.argsort(rank, axis=1, kind="stable")
    px, py = np.take_along_axis(px, order, 1), np.take_along_axis(py, order, 1)
    ax, ay = px[:, 0], py[:, 0]
    bx, by, cx, cy = px[:, 1] - ax, py[:, 1] - ay, px[:, 2] - ax, py[:, 2] - ay
    bb, cc = bx * bx + by * by, cx * cx + cy * cy
    level, upright = np.where(side == -1, box[1], box[3]), np.where(side == -2, box[2], box[0])
    with np.errstate(invalid="ignore", divide="ignore"):
        d = 2 * (bx * cy - by * cx)
        x = np.where(side >= 0, ax + (cy * bb - by * cc) / d, np.where(side % 2 == 1, ax + (bb / 2 - by * (level - ay)) / bx, upright))
        y = np.where(side >= 0, ay + (bx * cc - cx * bb) / d, np.where(side % 2 == 1, level, ay + (bb / 2 - bx * (upright - ax)) / by))
    return np.round(np.stack([x, y], 1), DECIMALS) + 0.0


def _before(n: np.ndarray) -> np.ndarray:
    """The place of the corner before each, in rings of n corners one after another."""
    out, last = np.arange(n.sum()) - 1, np.cumsum(n) - 1
    out[(last - n + 1)[n > 0]] = last[n > 0]
    return out


def _cells(own: np.ndarray, rank: np.ndarray, others: np.ndarray, others_rank: np.ndarray, first: np.ndarray, box: Box) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The corners of the cells of many places, turning left, how many each has, and the distances of the farthest. Ranks are those of (id, x, y)."""
    sides, n, far = _clipped(own, others, first, box)
    who, k = np.nonzero(np.arange(sides.shape[1]) < n[:, None])
    s = sides[who, k]
    one = s != s[_before(n)]
    who, s, n = who[one], s[one], np.bincount(who[one], minlength=len(own))
    before = s[_before(n)]
    high, low = np.maximum(before, s), np.minimum(before, s)
    # Between two sides of the box and beside one of them there are less than three points; what is in their place is not looked at.
    others, others_rank = np.concatenate([others, [[0.0, 0.0]]]), np.concatenate([others_rank, [np.iinfo(np.int64).max]])
    high_at, low_at = np.where(high < 0, len(others) - 1, high), np.where(low < 0, len(others) - 1, low)
    xy = _corners(np.stack([rank[who], others_rank[high_at], others_rank[low_at]], 1), *(np.stack([own[who, c], others[high_at, c], others[low_at, c]], 1) for c in (0, 1)), low, box)
    for b, a, x, y in ((-4, -1, 0, 1), (-1, -2, 2, 1), (-2, -3, 2, 3), (-3, -4, 0, 3)):
        xy[(before == b) & (s == a)] = box[x], box[y]
    one = (xy != xy[_before(n)]).any(1)
    n = np.bincount(who[one], minlength=len(own))
    one &= (n > 2)[who]
    return xy[one], np.where(n > 2, n, 0), far


def nearest_cells(points: DataFrame, key: str, box: Box, reach: float) -> DataFrame:
    """The edges (key, x1, y1, x2, y2), turning left, of the part of a box that is nearest to each point (key, x, y).

    Points without a place or outside the box have no cell; of several in one
    place the least key has it. `reach` is how far a point looks for neighbours
    at first, less where points are dense; as many as are about a cell of that
    size meet in one row.
    """
    return whole_cells(points, key, box, reach).select(key, F.explode("edges").alias("e")).select(key, "e.*")


def whole_cells(points: DataFrame, key: str, box: Box, reach: float) -> DataFrame:
    """As nearest_cells, a row (key, edges) for each point."""
    x1, y1, x2, y2 = box
    inside = points.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2) & F.col(key).isNotNull())
    at = inside.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min(key).alias(key))
    at = cut(spatial.spread(at.select(key, "x", "y"), "x", "y"))
    reach /= 2.0 ** spatial.halvings(at, F.col("x"), F.col("y"), (reach, reach), spatial.SITES_A_CELL)
    kind = at.schema[key].dataType.simpleString()
    whole = float(np.hypot(x2 - x1, y2 - y1))
    edge = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])

    def cells_within(reach: float):
        def told(keys: pa.Array, own: np.ndarray, rank: np.ndarray, group: np.ndarray, near: np.ndarray, near_rank: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            met = np.diff(starts)[group]
            who, at = np.repeat(np.arange(len(own)), met), _ranges(starts[group], met)
            apart2 = ((near[at] - own[who]) ** 2).sum(1)
            close = (apart2 > 0) & (apart2 <= reach * reach)
            who, at, apart2 = who[close], at[close], apart2[close]
            at = at[np.lexsort((apart2, who))]
            first = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(own)))])
            xy, n, far = _cells(own, rank, near[at], near_rank[at], first, box)
            begin, after = xy[_before(n)], xy
            edges = pa.StructArray.from_arrays([pa.array(v) for v in (*begin.T, *after.T)], fields=list(edge))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), edges)
            return pa.RecordBatch.from_arrays([keys, *(pa.array(v) for v in own.T), pa.array((2 * far <= reach) | (reach > whole)), lists], names=[key, "x", "y", "closed", "edges"])

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, places, starts = [], [], []
                for column in batch.columns:
                    flat = column.flatten()
                    keys.append(flat.field(0))
                    places.append(np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2)], 1))
                    starts.append(column.offsets.to_numpy() - column.offsets[0].as_py())
                ids = np.concatenate([k.to_numpy(zero_copy_only=False) for k in keys])
                ids = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
                rank, every = np.empty(len(ids), np.int64), np.concatenate(places)
                rank[np.lexsort((every[:, 1], every[:, 0], ids))] = np.arange(len(ids))
                (own, near), group = places, np.repeat(np.arange(batch.num_rows), np.diff(starts[0]))
                pairs = np.cumsum(np.diff(starts[1])[group])
                i = 0
                while i < len(own):
                    j = max(int(np.searchsorted(pairs, (pairs[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")), i + 1)
                    yield told(keys[0].slice(i, j - i), own[i:j], rank[: len(own)][i:j], group[i:j], near, rank[len(own) :], starts[1])
                    i = j

        return cells

    open_, done = at, None
    while True:
        placed = lambda df: df.select(F.struct(key, "x", "y").alias("o"), geo.cell(F.col("x"), reach).alias("_cx"), geo.cell(F.col("y"), reach).alias("_cy"))  # noqa: B023, E731
        own, sites = placed(open_), placed(at)
        # A cell in which a point is open gets the points of the nine around it.
        wanted = own.select(F.col("_cx").alias("_tx"), F.col("_cy").alias("_ty")).distinct()
        for c in "xy":
            wanted = wanted.withColumn(f"_c{c}", F.explode(F.array(*[F.col(f"_t{c}") + F.lit(d) for d in (-1, 0, 1)])))
        near = spatial.spread(sites, "_cx", "_cy").join(spatial.spread(wanted, "_cx", "_cy").hint("merge"), ["_cx", "_cy"])
        none = F.lit(None).cast(near.schema["o"].dataType)
        rows = near.select("_tx", "_ty", none.alias("own"), F.col("o").alias("near")).unionByName(own.select(F.col("_cx").alias("_tx"), F.col("_cy").alias("_ty"), F.col("o").alias("own"), none.alias("near")))
        met = spatial.spread(rows, "_tx", "_ty").groupBy("_tx", "_ty").agg(F.collect_list("own").alias("own"), F.collect_list("near").alias("near")).select("own", "near")
        now = cut(met.mapInArrow(cells_within(reach), f"`{key}` {kind}, x double, y double, closed boolean, edges array<struct<x1: double, y1: double, x2: double, y2: double>>"))
        found = now.where("closed").select(key, "edges")
        done = found if done is None else done.unionByName(found)
        open_ = now.where("not closed").select(key, "x", "y")
        if open_.isEmpty():
            return done
        reach *= 2


def _whole(district: DataFrame) -> tuple[float, int, int, np.ndarray]:
    """Square cells over a district (edges): their size, the least of them, and of each 0 for outside, 1 for inside, 2 for what its border passes through."""
    x, y = (F.array(f"{c}1", f"{c}2") for c in "xy")
    ends = district.agg(F.min(F.array_min(x)), F.max(F.array_max(x)), F.min(F.array_min(y)), F.max(F.array_max(y))).first()
    along = max(ends[1] - ends[0], ends[3] - ends[2]) if None not in ends else 0.0
    if not along > 0:
        return 1.0, 0, 0, np.zeros((1, 1), int)
    size = along / CELLS_ALONG
    rows = spatial.polygon_cells(district.select(F.lit(0).alias("_district"), "x1", "y1", "x2", "y2"), "_district", size)
    found = np.array([tuple(r) for r in rows.select("_cx", "_cy", F.when(F.size("_edges") > 0, 2).otherwise(1)).collect()])  # cells of a grid of that size
    if not len(found):
        return size, 0, 0, np.zeros((1, 1), int)
    left, low = found[:, :2].min(0)
    state = np.zeros(found[:, :2].max(0) - (left, low) + 1, int)
    state[found[:, 0] - left, found[:, 1] - low] = found[:, 2]
    return size, int(left), int(low), state


def _against(batches: Iterator[pa.RecordBatch], grid: tuple[float, int, int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column are the edges of a cell, with whether it lies inside as a whole; those outside as a whole go."""
    size, left, low, state = grid
    # A ring of cells outside, and sums of what is to the left and below.
    state = np.pad(state, 1)
    sums = [np.pad(np.cumsum(np.cumsum(state == kind, 0), 1), ((1, 0), (1, 0))) for kind in (0, 1)]
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        n, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        some = np.flatnonzero(n)
        begins = (np.cumsum(n) - n)[some]
        spans = []
        for i, least, most in ((0, left, state.shape[0]), (1, low, state.shape[1])):
            v = flat.field(i).to_numpy(zero_copy_only=False)
            ends = [f.reduceat(v, begins) / size if len(some) else np.zeros(0) for f in (np.minimum, np.maximum)]
            spans.append([np.clip(np.floor(e + slack) - least + 1, 0, most - 1).astype(int) for e, slack in zip(ends, (-1e-6, 1e-6), strict=True)])
        (a, b), (c, d) = spans
        outside, inside = (s[b + 1, d + 1] - s[a, d + 1] - s[b + 1, c] + s[a, c] == (b - a + 1) * (d - c + 1) for s in sums)
        kept = some[~outside]
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept, pa.int64())).columns, pa.array(inside[~outside])], names=[*batch.schema.names, "whole"])


def nearest_zones(points: DataFrame, key: str, label: str, district: DataFrame, box: Box, reach: float, size: float) -> DataFrame:
    """(label, rings): the parts of a district (edges) whose nearest point has the label; disjoint and without gaps.

    Cells that lie inside as a whole come with their edges; those at the border
    are cut to the district, each on its own, so no strip holds more edges than
    a cell has. What cells of a label share cancels in the outline. points
    has key, label, x and y; those without a label leave their cells empty.
    """
    labels = points.groupBy(key).agg(F.min(label).alias(label)).where(F.col(label).isNotNull())
    grid = _whole(district)
    cells = whole_cells(points, key, box, reach).join(labels, key).select(label, key, "edges")
    kinds = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in cells.columns)
    told = cut(cells.mapInArrow(lambda batches: _against(batches, grid), f"{kinds}, whole boolean"))
    inside = told.where("whole").select(label, F.explode("edges").alias("e")).select(label, "e.*")
    edges = told.where("not whole").select(F.struct(label, key).alias("_p"), F.explode("edges").alias("e")).select("_p", "e.*")
    whole = district.select(F.lit(0).alias("_district"), "x1", "y1", "x2", "y2")
    parts = shapes.trapezoids(edges, "_p", size).select(F.col(f"_p.{label}").alias(label), *shapes.PLACES)
    shared = cut(shapes.intersect(parts, shapes.trapezoids(whole, "_district", size), [label], ["_district"], size).drop("_district"))
    return shapes.rings(shapes.outline(shared, [label], inside), [label])
