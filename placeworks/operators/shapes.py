"""Polygons as geometry: overlays, clips, unions, valid faces and nearest-point zones that come back as rings.

All of it goes by trapezoids. A polygon's edges are cut at the ends and
crossings of all of them, strip by strip; between two cuts the edges stand in
order, and what lies between the first and second, third and fourth, ... is
inside. So the turn of rings does not matter, a ring that crosses itself has
the faces of the even-odd rule, and holes are rings like others. Trapezoids of
two layers meet in cells and are cut to what they share, and those of one
label are swept cell by cell for what is covered at all.

A line keeps the two ends of the edge it is from, so its height at a place is
the same number wherever it is asked for, and the sides of trapezoids next to
each other cancel. What is left of them is the outline, linked to rings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial

#: A trapezoid: from l to r, above the line b and below the line t.
LINES = [f"{line}{c}" for line in "bt" for c in ("x1", "y1", "x2", "y2")]
PLACES = ["l", "r", *LINES]
#: Polygons of so many lines in a strip are cut up together, in arrays of about so many numbers.
FEW_LINES, PLACES_AT_ONCE = 24, 1 << 20
#: Heights below so many units in the last place of the coordinates are rounding.
ULPS = 64


def _kind(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([_kind(df, keys), *(f"{c} double" for c in PLACES)])


def _at(line: np.ndarray, x: np.ndarray | float) -> np.ndarray:
    """The height of lines (..., 4) at x; at their ends, exactly that of the end."""
    x1, y1, x2, y2 = np.moveaxis(line, -1, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        inside = y1 + (y2 - y1) * ((x - x1) / (x2 - x1))
    return np.where(x == x1, y1, np.where(x == x2, y2, inside))


def height(line: str, x: Column) -> Column:
    """As _at, of the columns of a trapezoid."""
    x1, y1, x2, y2 = (F.col(f"{line}{c}") for c in ("x1", "y1", "x2", "y2"))
    return F.when(x == x1, y1).when(x == x2, y2).otherwise(y1 + (y2 - y1) * ((x - x1) / (x2 - x1)))


def _cross(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Where lines cross, by x; nan where they are parallel. The same number in either order."""
    swap = np.zeros(np.broadcast_shapes(e.shape, f.shape)[:-1], bool)
    same = ~swap
    for c in range(4):
        swap |= same & (e[..., c] > f[..., c])
        same &= e[..., c] == f[..., c]
    e, f = np.where(swap[..., None], f, e), np.where(swap[..., None], e, f)
    dx, dy, fx, fy = e[..., 2] - e[..., 0], e[..., 3] - e[..., 1], f[..., 2] - f[..., 0], f[..., 3] - f[..., 1]
    d = dx * fy - dy * fx
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(d != 0, e[..., 0] + dx * (((f[..., 0] - e[..., 0]) * fy - (f[..., 1] - e[..., 1]) * fx) / d), np.nan)


def _thick(bottom: np.ndarray, top: np.ndarray, s: np.ndarray | float, t: np.ndarray | float) -> np.ndarray:
    """Whether a piece from s to t between two lines has a height beyond rounding."""
    m = (s + t) / 2
    b, u = _at(bottom, m), _at(top, m)
    return u - b > ULPS * np.spacing(np.maximum(np.abs(b), np.abs(u)))


def _stops(lines: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Where to cut from lo to hi, so that no two of the lines, which end or cross, do so in between."""
    stops = [np.array([lo, hi]), np.clip(lines[:, [0, 2]].ravel(), lo, hi)]
    if len(lines) > 1:
        for i in range(len(lines) - 1):
            e, f = lines[i], lines[i + 1 :]
            x = _cross(np.broadcast_to(e, f.shape), f)
            low, high = np.maximum(np.maximum(e[0], f[:, 0]), lo), np.minimum(np.minimum(e[2], f[:, 2]), hi)
            stops.append(x[(x > low) & (x < high)])
    return np.unique(np.concatenate(stops))


def _slabs(lines: np.ndarray, lo: float, hi: float) -> Iterator[tuple[float, float, np.ndarray]]:
    """(s, t, the lines between them by height)."""
    stops = _stops(lines, lo, hi)
    for s, t in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        over = np.flatnonzero((lines[:, 0] <= s) & (lines[:, 2] >= t))
        if len(over):
            yield s, t, over[np.argsort(_at(lines[over], (s + t) / 2), kind="stable")]


def _pieces(lines: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The trapezoids (PLACES) from lo to hi of one polygon's lines."""
    out = []
    for s, t, order in _slabs(lines, lo, hi) if lo < hi else ():
        for k in range(0, len(order) - 1, 2):
            b, u = lines[order[k]], lines[order[k + 1]]
            if _thick(b, u, s, t):
                out.append([s, t, *b, *u])
    return np.array(out).reshape(-1, len(PLACES))


def _pieces_of_many(lines: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _pieces, of polygons with as many lines each (polygons, lines, 4): the polygon of each trapezoid, and the trapezoids."""
    some = np.flatnonzero(lo < hi)
    lines, lo, hi = lines[some], lo[some, None], hi[some, None]
    i, j = np.triu_indices(lines.shape[1], 1)
    e, f = lines[:, i], lines[:, j]
    x = _cross(e, f)
    low, high = np.maximum(np.maximum(e[..., 0], f[..., 0]), lo), np.minimum(np.minimum(e[..., 2], f[..., 2]), hi)
    stops = np.concatenate([lo, hi, np.clip(lines[..., 0], lo, hi), np.clip(lines[..., 2], lo, hi), np.where((x > low) & (x < high), x, hi)], 1)
    stops.sort(axis=1)
    who, at = np.nonzero(stops[:, :-1] < stops[:, 1:])
    s, t, own = stops[who, at], stops[who, at + 1], lines[who]
    over = (own[..., 0] <= s[:, None]) & (own[..., 2] >= t[:, None])
    order = np.argsort(np.where(over, _at(own, ((s + t) / 2)[:, None]), np.inf), axis=1, kind="stable")
    count, rows, out = over.sum(1), [np.zeros(0, int)], [np.zeros((0, len(PLACES)))]
    for k in range(0, lines.shape[1] - 1, 2):
        slab = np.flatnonzero(count > k + 1)
        b, u = own[slab, order[slab, k]], own[slab, order[slab, k + 1]]
        thick = _thick(b, u, s[slab], t[slab])
        slab = slab[thick]
        rows.append(some[who[slab]])
        out.append(np.column_stack([s[slab], t[slab], b[thick], u[thick]]))
    return np.concatenate(rows), np.concatenate(out)


def trapezoids(edges: DataFrame, key: str, size: float) -> DataFrame:
    """The trapezoids (key, l, r, b..., t...) of polygons given by their edges (x1, y1, x2, y2), in strips of `size`.

    A task holds the edges of one polygon in one strip. Upright edges are told
    by the others, so polygons of no area have no trapezoids; null keys or ends
    have none either.
    """
    ends = F.when(F.col("x1") < F.col("x2"), F.struct("x1", "y1", "x2", "y2")).otherwise(F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")))
    sided = edges.where("x1 != x2 AND y1 IS NOT NULL AND y2 IS NOT NULL").where(F.col(key).isNotNull()).select(key, *(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))).select(key, ends.alias("e"))
    strips = sided.withColumn("strip", F.explode(F.sequence(geo.cell(F.col("e.x1"), size), geo.cell(F.col("e.x2"), size))))
    # What a row takes to cut up is not told by its size, so small tables are spread as well.
    rows = spatial.spread(strips, key, "strip").groupBy(key, "strip").agg(F.collect_list("e").alias("e")).select(key, "strip", "e")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, strips_ = batch.column(2), batch.column(1).to_pylist()
            flat = lists.flatten()
            lines = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)], 1) if len(flat) else np.zeros((0, 4))
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            n = np.diff(offsets)
            lo, hi = np.array(strips_, float) * size, (np.array(strips_, float) + 1) * size
            if len(n):
                lo, hi = np.maximum(lo, np.minimum.reduceat(lines[:, 0], offsets[:-1])), np.minimum(hi, np.maximum.reduceat(lines[:, 2], offsets[:-1]))
            rows, out = [np.zeros(0, int)], [np.zeros((0, len(PLACES)))]
            for many in np.unique(n[n <= FEW_LINES]).tolist():
                # Small polygons go together, as many as stay within a few arrays of PLACES_AT_ONCE numbers.
                alike, most = np.flatnonzero(n == many), max(PLACES_AT_ONCE // many**3, 1)
                for part in (alike[k : k + most] for k in range(0, len(alike), most)):
                    who, table = _pieces_of_many(lines[offsets[part][:, None] + np.arange(many)], lo[part], hi[part])
                    rows.append(part[who])
                    out.append(table)
            for i in np.flatnonzero(n > FEW_LINES).tolist():
                table = _pieces(lines[offsets[i] : offsets[i + 1]], lo[i], hi[i])
                rows.append(np.full(len(table), i))
                out.append(table)
            rows, table = np.concatenate(rows), np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(table[:, c]) for c in range(len(PLACES)))], names=[key, *PLACES])

    return rows.mapInArrow(cut_up, _schema(edges, [key]))


def box_trapezoids(boxes: DataFrame, *keys: str) -> DataFrame:
    """Rectangles (x1, y1, x2, y2) as trapezoids."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    places = (x1, x2, x1, y1, x2, y1, x1, y2, x2, y2)
    return boxes.where("x1 < x2 AND y1 < y2").select(*keys, *(p.alias(c) for p, c in zip(places, PLACES, strict=True)))


def area_of() -> Column:
    """The area of a trapezoid."""
    m = (F.col("l") + F.col("r")) / 2
    return (F.col("r") - F.col("l")) * (height("t", m) - height("b", m))


def _boxed(traps: DataFrame) -> DataFrame:
    low = F.least(height("b", F.col("l")), height("b", F.col("r")))
    return traps.withColumns({"_low": low, "_high": F.greatest(height("t", F.col("l")), height("t", F.col("r")))})


def _spread(traps: DataFrame, size: float) -> DataFrame:
    over = lambda a, b: F.explode(F.sequence(geo.cell(F.col(a), size), geo.cell(F.col(b), size)))
    return _boxed(traps).withColumn("_cx", over("l", "r")).withColumn("_cy", over("_low", "_high"))


def _shared(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """What two trapezoids of each row share: between two cuts, above the higher bottom and below the lower top."""
    for batch in batches:
        v = np.stack([batch.column(keys + i).to_numpy(zero_copy_only=False) for i in range(2 * len(PLACES))], 1) if batch.num_rows else np.zeros((0, 2 * len(PLACES)))
        n = len(v)
        lo, hi = np.maximum(v[:, 0], v[:, 10]), np.minimum(v[:, 1], v[:, 11])
        ab, at, bb, bt = v[:, 2:6], v[:, 6:10], v[:, 12:16], v[:, 16:20]
        stops = np.stack([lo, *(_cross(e, f) for e, f in ((ab, bb), (at, bt), (ab, bt), (at, bb))), hi], 1)
        stops = np.sort(np.clip(np.where(np.isnan(stops), hi[:, None], stops), lo[:, None], hi[:, None]), 1)
        rows, out = [], []
        for k in range(5):
            s, t = stops[:, k], stops[:, k + 1]
            m = (s + t) / 2
            b = np.where((_at(ab, m) >= _at(bb, m))[:, None], ab, bb)
            u = np.where((_at(at, m) <= _at(bt, m))[:, None], at, bt)
            keep = np.flatnonzero((s < t) & _thick(b, u, s, t))
            rows.append(keep)
            out.append(np.column_stack([s[keep], t[keep], b[keep], u[keep]]))
        rows, table = np.concatenate(rows) if n else np.zeros(0, int), np.concatenate(out) if n else np.zeros((0, 10))
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(keys)), *(pa.array(table[:, c]) for c in range(len(PLACES)))], names=[*batch.schema.names[:keys], *PLACES])


def intersect(a: DataFrame, b: DataFrame, a_keys: Sequence[str], b_keys: Sequence[str], size: float) -> DataFrame:
    """The trapezoids (*a_keys, *b_keys, l, r, ...) that trapezoids of two layers share.

    Both are spread over cells of `size`, and two meet where the lower left
    corner of their boxes' overlap is, so once. No polygon is compared with
    another edge by edge.
    """
    a, b = _spread(a, size), _spread(b, size)
    for c in [*PLACES, "_low", "_high"]:
        b = b.withColumnRenamed(c, f"o{c}")
    met = a.join(b, ["_cx", "_cy"]).where("l < or AND ol < r AND _low < o_high AND o_low < _high")
    met = met.where((geo.cell(F.greatest("l", "ol"), size) == F.col("_cx")) & (geo.cell(F.greatest("_low", "o_low"), size) == F.col("_cy")))
    keys = [*a_keys, *b_keys]
    rows = met.select(*keys, *PLACES, *(f"o{c}" for c in PLACES))
    return rows.mapInArrow(lambda batches: _shared(batches, len(keys)), _schema(rows, keys))


def shared_area(layers: Sequence[tuple[DataFrame, str]], size: float) -> DataFrame:
    """The keys of polygons of several layers (edges, key) that overlap, and `area`, that of what all of them share."""
    out = trapezoids(*layers[0], size)
    keys = [layers[0][1]]
    for edges, key in layers[1:]:
        out = intersect(out, trapezoids(edges, key, size), keys, [key], size)
        keys.append(key)
    return out.groupBy(*keys).agg(F.sum(area_of()).alias("area"))


def covered(traps: DataFrame, label: str, size: float) -> DataFrame:
    """Disjoint trapezoids (label, l, r, ...) of all that a label's trapezoids, which may overlap, cover.

    A cell of a label is swept from left to right: between two cuts the lines
    are taken by height with a count of what covers the place above each.
    """
    rows = _spread(traps.where(F.col(label).isNotNull()), size).select(label, "_cx", "_cy", *PLACES).distinct()

    def swept(group: pd.DataFrame) -> pd.DataFrame:
        cx, cy = int(group["_cx"].iloc[0]), int(group["_cy"].iloc[0])
        v = group[PLACES].to_numpy(float)
        lo, hi, low, high = cx * size, (cx + 1) * size, cy * size, (cy + 1) * size
        # A trapezoid's own ends cut its lines; the cell's lower and upper side are lines too.
        sides = np.array([[lo, low, hi, low], [lo, high, hi, high]])
        lines = np.concatenate([v[:, 2:6], v[:, 6:10], sides])
        ends = np.clip(np.concatenate([v[:, 0], v[:, 1]]), lo, hi)
        stops = np.unique(np.concatenate([_stops(np.unique(lines, axis=0), lo, hi), ends]))
        out = []
        for s, t in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            live = v[(v[:, 0] <= s) & (v[:, 1] >= t)]
            m = (s + t) / 2
            b, u = np.clip(_at(live[:, 2:6], m), low, high), np.clip(_at(live[:, 6:10], m), low, high)
            live, b, u = live[u > b], b[u > b], u[u > b]
            at, reach, top = None, -np.inf, None
            for i in np.argsort(b, kind="stable"):
                if b[i] > reach:
                    if at is not None:
                        out.append([s, t, *at, *top])
                    at = live[i, 2:6] if b[i] > low else sides[0]
                if u[i] > reach:
                    reach, top = u[i], live[i, 6:10] if u[i] < high else sides[1]
            if at is not None:
                out.append([s, t, *at, *top])
        frame = pd.DataFrame(np.array(out).reshape(-1, len(PLACES)), columns=PLACES)
        frame.insert(0, label, group[label].iloc[0])
        return frame

    return rows.groupBy(label, "_cx", "_cy").applyInPandas(swept, _schema(traps, [label]))


def _level(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sides on one line (keys, line, a, e, sign) as the spans between their ends that do not cancel."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("sign").alias("d")), F.struct(F.col("e").alias("at"), (-F.col("sign")).alias("d"))))
    steps = sides.select(*keys, "line", ends.alias("p")).groupBy(*keys, "line", "p.at").agg(F.sum("p.d").alias("d")).where("d != 0")
    w = Window.partitionBy(*keys, "line").orderBy("at")
    spans = steps.select(*keys, "line", F.col("at").alias("a"), F.lead("at").over(w).alias("e"), F.sum("d").over(w).alias("sign"))
    return spans.where("sign != 0 AND e IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(1), F.abs("sign")))).drop("i")


def outline(traps: DataFrame, keys: Sequence[str], edges: DataFrame | None = None) -> DataFrame:
    """The directed edges (keys, x1, y1, x2, y2), with the inside on their left, around disjoint trapezoids.

    `edges` are directed ones of further polygons, disjoint as well, that need not be cut up.
    """
    corner = {f"{line}{x}": height(line, F.col(x)) for line in "bt" for x in "lr"}
    t = traps.select(*keys, *PLACES).withColumns(corner)
    up = F.array(*[F.struct(F.col(x).alias("line"), F.col(f"b{x}").alias("a"), F.col(f"t{x}").alias("e"), F.lit(sign).alias("sign")) for x, sign in (("r", 1), ("l", -1))])
    upright = t.select(*keys, F.explode(up).alias("s")).select(*keys, "s.*").where("a != e")
    whole = lambda line: F.struct(*(F.col(f"{line}{c}").alias(c) for c in ("x1", "y1", "x2", "y2"))).alias("whole")
    along = F.array(*[F.struct(F.col(f"{line}l").alias("y1"), F.col(f"{line}r").alias("y2"), F.lit(sign).alias("sign"), whole(line)) for line, sign in (("b", 1), ("t", -1))])
    sloped = t.select(*keys, "l", "r", F.explode(along).alias("s")).select(*keys, "l", "r", "s.*")
    if edges is not None:
        plain = edges.select(*keys, *(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")))
        ahead = F.col("x1") < F.col("x2")
        left, right = (F.when(ahead, F.struct(*(F.col(c).alias(c[0]) for c in p))).otherwise(F.struct(*(F.col(c).alias(c[0]) for c in q))) for p, q in ((("x1", "y1"), ("x2", "y2")), (("x2", "y2"), ("x1", "y1"))))
        turned = plain.where("x1 != x2").select(*keys, F.when(ahead, 1).otherwise(-1).alias("sign"), left.alias("p"), right.alias("q"))
        ends = F.struct(F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))
        sloped = sloped.unionByName(turned.select(*keys, F.col("p.x").alias("l"), F.col("q.x").alias("r"), F.col("p.y").alias("y1"), F.col("q.y").alias("y2"), "sign", ends.alias("whole")))
        standing = plain.where("x1 = x2 AND y1 != y2").select(*keys, F.col("x1").alias("line"), F.least("y1", "y2").alias("a"), F.greatest("y1", "y2").alias("e"), F.when(F.col("y1") < F.col("y2"), 1).otherwise(-1).alias("sign"))
        upright = upright.unionByName(standing)
    upright = _level(upright, keys)
    level = _level(sloped.where("y1 = y2").select(*keys, F.col("y1").alias("line"), F.col("l").alias("a"), F.col("r").alias("e"), "sign"), keys)
    # Two sides of a line may be cut at other places, so what is left goes by the line.
    rest = sloped.where("y1 != y2").groupBy(*keys, "l", "r", "y1", "y2").agg(F.sum("sign").alias("sign"), F.min("whole").alias("line")).where("sign != 0")
    rest = _level(rest.select(*keys, "line", F.col("l").alias("a"), F.col("r").alias("e"), "sign"), keys)
    rest = rest.select(*keys, "a", "e", "sign", *(F.col(f"line.{c}").alias(f"b{c}") for c in ("x1", "y1", "x2", "y2"))).withColumns({"ya": height("b", F.col("a")), "ye": height("b", F.col("e"))})

    def told(df: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
        turned = lambda a, b, c: F.when(F.col("sign") > 0, F.col(a)).otherwise(F.col(b)).alias(c)
        return df.select(*keys, turned(x1, x2, "x1"), turned(y1, y2, "y1"), turned(x2, x1, "x2"), turned(y2, y1, "y2"))

    return told(upright, "line", "a", "line", "e").unionByName(told(level, "a", "line", "e", "line")).unionByName(told(rest, "a", "ya", "e", "ye"))


def _snapped(edges: np.ndarray) -> np.ndarray:
    """Edges whose corners above each other are one where only rounding parts them, without those that this takes the length of."""
    p = edges.reshape(-1, 2)
    order = np.lexsort((p[:, 1], p[:, 0]))
    q = p[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:, 0] != q[:-1, 0]) | (q[1:, 1] - q[:-1, 1] > ULPS * np.spacing(np.abs(p).max()))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty_like(p)
    out[order] = np.column_stack([q[:, 0], q[first, 1]])
    out = out.reshape(-1, 4)
    return out[(out[:, :2] != out[:, 2:]).any(1)]


def _linked(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners of the rings of directed edges, one ring after another, and how many each has.

    Where several edges go on from a corner, the leftmost turn keeps rings apart that only touch.
    """
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
    corners = edges.reshape(-1, 2)
    order = np.lexsort((corners[:, 1], corners[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (corners[order[1:]] != corners[order[:-1]]).any(1)
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new) - 1
    start, end = name[::2], name[1::2]
    many = np.bincount(start, minlength=int(new.sum()))
    first = (np.cumsum(many) - many)[end].tolist()  # of the edges that go on from an edge's end, which stand together
    starts, ends, many = start.tolist(), end.tolist(), many[end].tolist()
    used, turns, sizes = [False] * len(edges), [], []

    def angle(i: int, at: np.ndarray, end: slice) -> float:
        x, y = edges[i, end] - at
        return float(np.arctan2(y, x))

    for begin in range(len(edges)):
        if used[begin]:
            continue
        i, n = begin, 0
        while True:
            used[i] = True
            turns.append(i)
            n += 1
            if ends[i] == starts[begin]:
                break
            on = [j for j in range(first[i], first[i] + many[i]) if not used[j]]
            if not on:
                break
            if len(on) > 1:
                at, before = edges[i, 2:], i
                back = angle(before, at, slice(0, 2))
                i = min(on, key=lambda j: (back - angle(j, at, slice(2, 4))) % (2 * np.pi) or 7.0)  # noqa: B023
            else:
                i = on[0]
        sizes.append(n)
    return edges[np.array(turns, int), :2], np.array(sizes, int)


def _straightened(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings (their corners one after another, how many each has) without the corners on a straight side, which cuts have left; none of what has no area."""
    while True:
        p, n = p[np.repeat(n > 2, n)], n[n > 2]
        if not len(n):
            return p, n
        first = np.cumsum(n) - n
        last = first + n - 1
        before, after = np.arange(len(p)) - 1, np.arange(len(p)) + 1
        before[first], after[last] = last, first
        a, b = p - p[before], p[after] - p
        along_a, along_b = np.hypot(*a.T), np.hypot(*b.T)
        most = np.repeat(np.maximum.reduceat(np.abs(p).max(1), first), n)
        turn = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
        flat = turn <= 1e-9 * (along_a * along_b) + ULPS * np.spacing(most) * (along_a + along_b)
        if not flat.any():
            return p, n
        # Neighbours may both be flat only because they are near: one of two goes at a time.
        even = (np.arange(len(p)) - np.repeat(first, n)) % 2 == 0
        even[last] &= ~((n % 2 == 1) & flat[first])
        flat &= even | ~(flat[before] | flat[after])
        p, n = p[~flat], n - np.add.reduceat(flat.astype(int), first)


def _plain(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """As _straightened, of one ring."""
    p, _ = _straightened(np.array(ring, float).reshape(-1, 2), np.array([len(ring)]))
    return [tuple(q) for q in p.tolist()]


RINGS = "rings array<array<struct<x: double, y: double>>>"


def rings(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rings) of directed edges as `outline` gives them: outer rings turn left, holes right. A key's rings are one row, so one task holds its outline."""

    listed = spatial.spread(edges, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")))).alias("e"))
    names = list(keys)
    listing = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            flat = lists.flatten()
            lines = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)], 1) if len(flat) else np.zeros((0, 4))
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            found = [_straightened(*_linked(_snapped(lines[i:j]))) if i < j else (np.zeros((0, 2)), np.zeros(0, int)) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            p, n = (np.concatenate([none, *(f[i] for f in found)]) for i, none in ((0, np.zeros((0, 2))), (1, np.zeros(0, int))))
            corners = pa.StructArray.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["x", "y"])
            told = listing(np.array([len(f[1]) for f in found], int), listing(n, corners))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), told], names=[*names, "rings"])

    return listed.mapInArrow(linked, f"{_kind(edges, keys)}, {RINGS}").where("size(rings) > 0")


def fragments(a: DataFrame, b: DataFrame, a_key: str, b_key: str, size: float) -> DataFrame:
    """(a_key, b_key, rings) of what each two polygons (edges) share; a clip to a district is that with one polygon on the other side."""
    shared = intersect(trapezoids(a, a_key, size), trapezoids(b, b_key, size), [a_key], [b_key], size)
    return rings(outline(shared, [a_key, b_key]), [a_key, b_key])


def valid(edges: DataFrame, key: str, size: float) -> DataFrame:
    """(key, rings) of polygons whose rings may cross or repeat: their even-odd faces, outer rings turning left and holes right."""
    return rings(outline(trapezoids(edges, key, size), [key]), [key])


def union(edges: DataFrame, polygon: str, label: str, size: float) -> DataFrame:
    """(label, rings) of what the polygons (edges with polygon and label) of a label cover together."""
    return rings(outline(union_trapezoids(edges, polygon, label, size), [label]), [label])


def union_trapezoids(edges: DataFrame, polygon: str, label: str, size: float) -> DataFrame:
    named = edges.select(F.struct(label, polygon).alias("_p"), "x1", "y1", "x2", "y2").where(F.col(f"_p.{label}").isNotNull())
    return covered(trapezoids(named, "_p", size).select(F.col(f"_p.{label}").alias(label), *PLACES), label, size)


def ring_area(rings: Column) -> Column:
    """The area of rings, holes turning the other way."""

    def turned(ring: Column) -> Column:
        pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
        return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)

    return F.aggregate(F.transform(rings, turned), F.lit(0.0), lambda total, x: total + x) / 2


def segment_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The distance of two segments (x1, y1, x2, y2), 0 where they cross or touch."""
    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    crossing = (side(a, b[0], b[1]) * side(a, b[2], b[3]) < 0) & (side(b, a[0], a[1]) * side(b, a[2], a[3]) < 0)
    ends = [geo.to_segment(*p, *s) for s, o in ((a, b), (b, a)) for p in ((o[0], o[1]), (o[2], o[3]))]
    return F.when(crossing, F.lit(0.0)).otherwise(F.least(*ends))


def polygon_distance(a: DataFrame, b: DataFrame, a_key: str, b_key: str, radius: float, size: float) -> DataFrame:
    """(a_key, b_key, distance) of polygons (edges) at most radius apart, 0 where they share a place, borders included.

    So `distance <= d` is whether one meets the other's buffer of d. Edges meet
    in cells, those of a widened by the radius; polygons of which one holds the
    other are told by what they share.
    """
    near = _near(a, b, a_key, b_key, radius, size)
    inside = intersect(trapezoids(a, a_key, size), trapezoids(b, b_key, size), [a_key], [b_key], size).select(a_key, b_key, F.lit(0.0).alias("distance"))
    return near.unionByName(inside).groupBy(a_key, b_key).agg(F.min("distance").alias("distance"))


def point_distance(polygons: DataFrame, points: DataFrame, polygon: str, point: str, radius: float, size: float) -> DataFrame:
    """(polygon, point, distance) of points (x, y) at most radius from a polygon (edges), 0 inside it; so whether its buffer of radius holds them.

    A point without a place is near to nothing.
    """
    placed = points.where("x IS NOT NULL AND y IS NOT NULL")
    dots = placed.select(point, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = _near(polygons, dots, polygon, point, radius, size)
    inside = spatial.point_in_polygon(placed, polygons, point, polygon, size).select(polygon, point, F.lit(0.0).alias("distance"))
    return near.unionByName(inside).groupBy(polygon, point).agg(F.min("distance").alias("distance"))


def _near(a: DataFrame, b: DataFrame, a_key: str, b_key: str, radius: float, size: float) -> DataFrame:
    """(a_key, b_key, distance) of the nearest edges of what is at most radius apart."""
    c = ("x1", "y1", "x2", "y2")

    def spread(edges: DataFrame, key: str, wide: float, names: str) -> DataFrame:
        over = lambda n: F.explode(F.sequence(geo.cell(F.least(f"{n}1", f"{n}2") - wide, size), geo.cell(F.greatest(f"{n}1", f"{n}2") + wide, size)))
        return edges.where(F.col(key).isNotNull()).withColumn("_cx", over("x")).withColumn("_cy", over("y")).select(key, "_cx", "_cy", *(F.col(n).cast("double").alias(f"{names}{n}") for n in c))

    met = spread(a, a_key, radius, "a").join(spread(b, b_key, 0.0, "b"), ["_cx", "_cy"])
    apart = segment_distance([F.col(f"a{n}") for n in c], [F.col(f"b{n}") for n in c])
    return met.groupBy(a_key, b_key).agg(F.min(apart).alias("distance")).where(F.col("distance") <= radius)
