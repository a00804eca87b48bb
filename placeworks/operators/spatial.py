"""Spatial joins: within a radius, nearest, point in polygon, overlays of rectangles, dissolved borders, hulls.

A join by distance is an equi-join on square cells as large as the radius: the
smaller side is copied to the nine cells around it, so each pair that can be
near enough meets once, and nothing is compared with everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .cut import cut

#: Sites up to which a nearest search carries all of them along with each row, as one array.
MOST_SITES = 256
#: Halvings of a cell before a search begins, at most.
HALVINGS = 16
#: Sites that the mean cell may hold when a search begins, and cells along a segment of mean length.
SITES_A_CELL, CELLS_A_SEGMENT = 16, 16
#: Edges of all polygons together that the mean cell may hold when points are asked for in dense borders.
EDGES_A_CELL = 64
#: Points of the greatest ids that segments meet first.
LAST_POINTS = 16_384


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df in as many partitions as a shuffle has, by columns if there are any: a small file is one, and what its rows meet would be one task's."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *columns)


def halvings(places: DataFrame, x: Column, y: Column, cell: tuple[float, float], most: float) -> int:
    """How often a cell has to be halved until the mean place (of all of them) has at most `most` in its own, so that dense tables are searched in small cells."""
    sizes = places.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    w, h = cell
    for n in range(HALVINGS):
        held = sizes.groupBy(geo.cell(F.col("x"), w), geo.cell(F.col("y"), h)).agg(F.count("*").cast("double").alias("n"))
        if (held.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0) <= most:
            return n
        w, h = w / 2, h / 2
    return HALVINGS


def within(points: DataFrame, sites: DataFrame, x: Callable[[DataFrame], Column], y: Callable[[DataFrame], Column], cell: tuple[float, float], distance: Column, radius: float) -> DataFrame:
    """points joined with the sites whose `distance` is at most radius.

    x and y give the coordinates of either table; cell is their extent of the
    radius, at least. Both tables' columns are kept and must differ in name.
    """
    own = points.withColumn("_cx", geo.cell(x(points), cell[0])).withColumn("_cy", geo.cell(y(points), cell[1]))
    around = sites.withColumn("_cx", F.explode(geo.cells_around(x(sites), cell[0]))).withColumn("_cy", F.explode(geo.cells_around(y(sites), cell[1])))
    joined = own.join(around, ["_cx", "_cy"]).drop("_cx", "_cy")
    return joined.withColumn("distance", distance).where(F.col("distance") <= radius)


def nearest(
    points: DataFrame,
    sites: DataFrame,
    distance: Callable[[Column], Column],
    columns: list[str],
    order: str,
    at: tuple[Column, Column],
    site_at: tuple[Column, Column],
    cell: tuple[float, float, float],
    most: float | None = None,
) -> DataFrame:
    """points with `nearest`: a struct of the distance and of the columns of the nearest site, the least `order` of equals.

    Up to MOST_SITES sites travel as one array beside every row. More of them
    are searched in cells that double their size, from one that holds a few
    sites: at and site_at place both tables, cell is (width, height, distance),
    and a site that is not in the nine cells around a point is at least that
    distance away, in cells of half the size half of it. A point that has found
    a site nearer than that is done. A point or a site without a place is near
    to nothing: `nearest` is null where there is no site with a distance. With
    `most`, distance gives null for what is farther than that, and the search
    ends there.
    """
    columns = list(dict.fromkeys([order, *columns]))
    if sites.limit(MOST_SITES + 1).count() <= MOST_SITES:
        packed = sites.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_sites"))
        joined = points.crossJoin(F.broadcast(packed))  # one row, of MOST_SITES structs at most
        told = F.transform("_sites", lambda s: F.struct(distance(s).alias("distance"), *[s[c].alias(c) for c in columns]))
        return joined.withColumn("nearest", F.array_min(F.filter(told, lambda s: s["distance"].isNotNull()))).drop("_sites")
    placed = cut(spread(points.select(F.struct("*").alias("_row"), at[0].alias("_x"), at[1].alias("_y"))).withColumn("_id", F.monotonically_increasing_id()))
    open_, done = placed.select("_id", "_row", "_x", "_y"), None
    targets = cut(sites.select(F.struct(*columns).alias("_site"), site_at[0].alias("_sx"), site_at[1].alias("_sy")))
    part = 2.0 ** -halvings(targets, F.col("_sx"), F.col("_sy"), cell[:2], SITES_A_CELL)
    w, h, reach = (size * part for size in cell)
    ends = targets.agg(F.max(F.abs(F.col("_sx"))), F.max(F.abs(F.col("_sy")))).first()
    far = placed.agg(F.max(F.abs(F.col("_x"))), F.max(F.abs(F.col("_y")))).first()
    while True:
        # Cells as large as everything hold all sites, so the search ends there.
        last = (most is not None and reach > most) or all(size > 2 * max(e or 0, f or 0) for size, e, f in zip((w, h), ends, far, strict=True))
        own = open_.withColumn("_cx", geo.cell(F.col("_x"), w)).withColumn("_cy", geo.cell(F.col("_y"), h))
        around = targets.withColumn("_cx", F.explode(geo.cells_around(F.col("_sx"), w))).withColumn("_cy", F.explode(geo.cells_around(F.col("_sy"), h)))
        # The size that is estimated for a table spread over cells is that of the table, so it is not to be broadcast by it.
        met = spread(own, "_cx", "_cy").join(spread(around, "_cx", "_cy").hint("merge"), ["_cx", "_cy"]).select("_id", "_site", "_row.*")
        told = met.select("_id", F.struct(distance(F.col("_site")).alias("distance"), *[F.col(f"_site.{c}").alias(c) for c in columns]).alias("nearest"))
        best = told.where("nearest.distance IS NOT NULL").groupBy("_id").agg(F.min("nearest").alias("nearest"))
        now = cut(open_.join(best, "_id", "left"))
        settled = F.coalesce(F.col("nearest.distance") < reach, F.lit(False)) | F.col("_x").isNull() | F.col("_y").isNull()
        found = now if last else now.where(settled)
        done = found if done is None else done.unionByName(found)
        open_ = now.where(~settled).drop("nearest")
        if last or open_.isEmpty():
            return done.select("_row.*", "nearest")
        w, h, reach = 2 * w, 2 * h, 2 * reach


def nearest_segments(points: DataFrame, segments: DataFrame, key: str, order: str, reach: float) -> DataFrame:
    """points (key, x, y) with the nearest segment (ax, ay, ex, ey) within reach, its distance to six decimals and the part `t` of it; the least `order` of equals.

    Segments stand in the cells that they come near to. The first cells are so
    small that they hold a few; what finds nothing looks again, twice as far.
    """
    ends = [F.col(c) for c in ("x", "y", "ax", "ay", "ex", "ey")]
    columns = [c for c in segments.columns if c not in ("ax", "ay", "ex", "ey")]
    lines = cut(spread(segments))
    extent = lines.agg(F.avg(F.abs(F.col("ex") - F.col("ax")) + F.abs(F.col("ey") - F.col("ay")))).first()[0] or 0
    least = extent / CELLS_A_SEGMENT
    near, n = reach, halvings(lines, (F.col("ax") + F.col("ex")) / 2, (F.col("ay") + F.col("ey")) / 2, (2 * reach, 2 * reach), SITES_A_CELL / 4)
    while n and near > least:
        near, n = near / 2, n - 1
    open_, done = cut(spread(points.select(key, "x", "y"))), None
    while True:
        size = 2 * near
        over = lambda a, b: F.explode(F.sequence(geo.cell(F.least(a, b) - near, size), geo.cell(F.greatest(a, b) + near, size)))  # noqa: B023, E731
        boxed = lines.withColumn("_cx", over("ax", "ex")).withColumn("_cy", over("ay", "ey"))
        middle = geo.to_segment((F.col("_cx") + 0.5) * size, (F.col("_cy") + 0.5) * size, *ends[2:])
        own = open_.withColumn("_cx", geo.cell(F.col("x"), size)).withColumn("_cy", geo.cell(F.col("y"), size))
        met = spread(own, "_cx", "_cy").join(spread(boxed.where(middle <= near + 0.7072 * size), "_cx", "_cy").hint("merge"), ["_cx", "_cy"])
        close = met.withColumn("_d", geo.to_segment(*ends)).where(F.col("_d") <= near)
        best = close.groupBy(key).agg(F.min(F.struct(F.round("_d", 6).alias("distance"), *dict.fromkeys([order, *columns]), geo.along_segment(*ends).alias("t"))).alias("_m"))
        now = best.select(key, "_m.*")
        if near >= reach:
            return now if done is None else done.unionByName(now)
        now = cut(now.where(F.col("distance") < near))
        done = now if done is None else done.unionByName(now)
        open_ = cut(open_.join(now.select(key), key, "left_anti"))
        if open_.isEmpty():
            return done
        near = min(2 * near, reach)


def last_near_segments(points: DataFrame, segments: DataFrame, point: str, segment: str, reach: float) -> DataFrame:
    """(point, segment, distance): of the points (x, y) within reach of each segment (ax, ay, ex, ey) the one of the greatest id, a number.

    LAST_POINTS points of the greatest ids come first, then as many again and so
    on; a segment that has found one is done, so a dense table of points does
    not meet each segment with all that are near it.
    """
    ends = [F.col(c) for c in ("x", "y", "ax", "ay", "ex", "ey")]
    size = 4 * reach
    placed = points.where(F.col(point).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(point, "x", "y", geo.cell(F.col("x"), size).alias("_cx"), geo.cell(F.col("y"), size).alias("_cy"))
    n, open_, done, above, upto = placed.count(), cut(spread(segments.select(segment, "ax", "ay", "ex", "ey"))), None, None, LAST_POINTS
    over = lambda a, b: F.explode(F.sequence(geo.cell(F.least(a, b) - reach, size), geo.cell(F.greatest(a, b) + reach, size)))
    while True:
        # Where the quantile is rounded does not matter: each point is in one part.
        least = placed.agg(F.percentile_approx(point, 1 - upto / n, 10000)).first()[0] if upto < n else None
        some = placed if above is None else placed.where(F.col(point) < above)
        some = some if least is None else some.where(F.col(point) >= least)
        met = open_.withColumn("_cx", over("ax", "ex")).withColumn("_cy", over("ay", "ey")).join(some, ["_cx", "_cy"])
        close = met.withColumn("distance", geo.to_segment(*ends)).where(F.col("distance") <= reach)
        found = close.groupBy(segment).agg(F.max(F.struct(point, "distance")).alias("_m")).select(segment, f"_m.{point}", "_m.distance")
        if least is None:
            return found if done is None else done.unionByName(found)
        found = cut(found)
        done = found if done is None else done.unionByName(found)
        open_, above, upto = cut(open_.join(found.select(segment), segment, "left_anti")), least, 2 * upto


def first_match(matches: DataFrame, key: str, order: str) -> DataFrame:
    """One match of each key: that of the least `order`."""
    w = Window.partitionBy(key).orderBy(order)
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _crosses(edge: Column, x: Column, y: Column) -> Column:
    """Whether an edge passes to the right of a place; an edge counts at its lower end, not at its upper."""
    rise = F.when(edge["y1"] != edge["y2"], edge["y2"] - edge["y1"])
    return ((edge["y1"] > y) != (edge["y2"] > y)) & (x < (edge["x2"] - edge["x1"]) * (y - edge["y1"]) / rise + edge["x1"])


def polygon_cells(edges: DataFrame, polygon: str, size: float) -> DataFrame:
    """The cells (polygon, _cx, _cy, _edges, _turns, _odd) of polygons: those that edges pass through, with these, and those inside as a whole, with none.

    A level line to the right of a point crosses edges in its cell, and of those
    that lie in its row beyond the cell the ones with a single end above it.
    `_odd` is 1 where an odd number of these leave the row at its top, `_turns`
    are the heights of their ends in the row. Where two of them meet, their
    ends cancel, so what is left are ends of edges that pass through the cell.
    """
    row = F.explode(F.sequence(geo.cell(F.least("y1", "y2"), size), geo.cell(F.greatest("y1", "y2"), size)))
    banded = edges.where("x1 IS NOT NULL AND x2 IS NOT NULL").select(polygon, "x1", "y1", "x2", "y2", row.alias("_cy"))
    # Where an edge enters and leaves its row of cells.
    slope = (F.col("x2") - F.col("x1")) / F.when(F.col("y1") != F.col("y2"), F.col("y2") - F.col("y1"))
    low, high = F.greatest(F.least("y1", "y2"), F.col("_cy") * size), F.least(F.greatest("y1", "y2"), (F.col("_cy") + 1) * size)
    ends = [F.coalesce(F.col("x1") + slope * (y - F.col("y1")), other) for y, other in ((low, F.col("x1")), (high, F.col("x2")))]
    slack = size * 1e-6
    banded = banded.withColumns({"_a": geo.cell(F.least(*ends) - slack, size), "_b": geo.cell(F.greatest(*ends) + slack, size)})
    edge, turn = F.struct("x1", "y1", "x2", "y2"), F.lit(None).cast("double")
    over = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)))
    through = banded.select(polygon, "_cy", over(F.col("_a"), F.col("_b")).alias("_cx"), edge.alias("_e"), turn.alias("_t"), F.lit(0).alias("_o"))
    # Of an open ring some ends are left over; they count as far as the first cell of the row.
    rows = banded.withColumn("_first", F.min("_a").over(Window.partitionBy(polygon, "_cy")))
    none = F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double>").alias("_e")
    crossed = rows.groupBy(polygon, "_cy", "_a").agg(F.count_if(geo.cell(F.greatest("y1", "y2"), size) > F.col("_cy")).alias("_n"))
    w = Window.partitionBy(polygon, "_cy").orderBy("_a")
    parts = crossed.withColumns({"_left": F.lag("_a").over(w), "_o": F.sum("_n").over(w.rowsBetween(0, Window.unboundedFollowing)) % 2}).where("_o = 1")
    odd = parts.select(polygon, "_cy", over(F.col("_left"), F.col("_a") - 1).alias("_cx"), none, turn.alias("_t"), F.col("_o").cast("int").alias("_o"))
    corners = rows.select(polygon, "_cy", "_a", "_first", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("_p"))
    corners = corners.where(geo.cell(F.col("_p.y"), size) == F.col("_cy")).groupBy(polygon, "_cy", "_p").agg(F.sort_array(F.collect_list("_a"), asc=False).alias("_as"), F.min("_first").alias("_first"))
    # An end counts from each edge's first cell to the left, so two of them cancel to the left of both.
    pairs = corners.select(polygon, "_cy", "_p", "_as", "_first", F.explode(F.expr("sequence(0, size(_as) - 1, 2)")).alias("_i"))
    left = F.coalesce(F.get("_as", F.col("_i") + 1), "_first")
    turns = pairs.select(polygon, "_cy", over(left, F.get("_as", "_i") - 1).alias("_cx"), none, F.col("_p.y").alias("_t"), F.lit(0).alias("_o"))
    told = through.unionByName(odd).unionByName(turns).groupBy(polygon, "_cx", "_cy")
    return told.agg(F.collect_list("_e").alias("_edges"), F.collect_list("_t").alias("_turns"), F.max("_o").alias("_odd"))


def small_cells(edges: DataFrame, size: float) -> float:
    """size, halved until the mean edge has but EDGES_A_CELL in its cell; the edges' extent has no more cells than there are edges by then."""
    ends = edges.agg(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2")), F.count("*")).first()
    n = halvings(edges, (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, (size, size), EDGES_A_CELL)
    while n and (ends[0] or 0) * (ends[1] or 0) > (size / 2**n) ** 2 * ends[2]:
        n -= 1
    return size / 2**n


def point_in_polygon(points: DataFrame, edges: DataFrame, point: str, polygon: str, size: float = 250.0) -> DataFrame:
    """(point, polygon) of every point (x, y) inside a polygon given by its edges (x1, y1, x2, y2).

    A point is inside where the edges to its right are odd in number; one on a
    left or lower border counts as inside, on a right or upper one as outside.
    Points meet polygons in cells, and there only the edges that pass through
    the cell: how often others pass to its right is told once for all points.
    """
    placed = points.select(point, "x", "y", geo.cell(F.col("x"), size).alias("_cx"), geo.cell(F.col("y"), size).alias("_cy"))
    met = placed.join(polygon_cells(edges, polygon, size), ["_cx", "_cy"])
    crossed = F.size(F.filter("_edges", lambda e: _crosses(e, F.col("x"), F.col("y")))) + F.size(F.filter("_turns", lambda y: y > F.col("y")))
    return met.where((crossed + F.col("_odd")) % 2 == 1).select(point, polygon)


def overlay(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of overlapping rectangles (ax1, ay1, ax2, ay2) and (bx1, by1, bx2, by2) with their shared area.

    Both sides are spread over cells of `size`; a pair is kept in the cell that
    holds the lower left corner of its overlap, so it appears once.
    """
    spread = lambda df, p: df.withColumn("_cx", F.explode(F.sequence(geo.cell(F.col(f"{p}x1"), size), geo.cell(F.col(f"{p}x2"), size)))).withColumn(
        "_cy", F.explode(F.sequence(geo.cell(F.col(f"{p}y1"), size), geo.cell(F.col(f"{p}y2"), size)))
    )
    met = spread(a, "a").join(spread(b, "b"), ["_cx", "_cy"])
    once = (geo.cell(F.greatest("ax1", "bx1"), size) == F.col("_cx")) & (geo.cell(F.greatest("ay1", "by1"), size) == F.col("_cy"))
    area = geo.overlap_area(*[F.col(f"{p}{c}") for p in "ab" for c in ("x1", "y1", "x2", "y2")])
    return met.where(once).drop("_cx", "_cy").withColumn("area", area).where("area > 0")


def rings_to_edges(polygons: DataFrame, polygon: str) -> DataFrame:
    """The edges of polygons given as rings (array<array<struct<x, y>>>), each ring closed; holes are rings like others."""
    ring = polygons.select(polygon, F.explode("rings").alias("ring"))
    pairs = ring.select(polygon, F.explode(F.arrays_zip(F.col("ring").alias("a"), F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)).alias("b"))).alias("e"))
    return pairs.select(polygon, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def polygon_area(polygons: DataFrame, polygon: str) -> DataFrame:
    """The area of polygons given as rings, the first one's turn being positive and holes turning the other way."""
    edges = rings_to_edges(polygons, polygon)
    return edges.groupBy(polygon).agg(F.abs(F.sum((F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2)).alias("area"))


def dissolved(edges: DataFrame, label: str) -> DataFrame:
    """The border of each label's polygons, which share whole edges and do not overlap: the edges that only one of them has."""
    ends = F.when(F.struct("x1", "y1") < F.struct("x2", "y2"), F.array("x1", "y1", "x2", "y2")).otherwise(F.array("x2", "y2", "x1", "y1"))
    once = edges.withColumn("_e", ends).groupBy(label, "_e").agg(F.count("*").alias("_n"), F.first(F.struct("x1", "y1", "x2", "y2")).alias("e")).where("_n % 2 = 1")
    return once.select(label, "e.*")


def _hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise, from the leftmost lowest."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows: np.ndarray) -> list:
        out: list = []
        for q in rows.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def convex_hull(points: DataFrame, key: str) -> DataFrame:
    """(key, corner, x, y): the corners of each key's hull in turn. Hulls of parts come first, so what meets in one task is their corners alone."""
    kind = points.schema[key].dataType.simpleString()

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        h = _hull(rows[["x", "y"]].to_numpy(float))
        return pd.DataFrame({key: rows[key].iloc[0], "corner": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield pd.concat([corners(g) for _, g in rows.groupby(key)])

    schema = f"`{key}` {kind}, corner long, x double, y double"
    some = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(f"`{key}` IS NOT NULL")
    return some.mapInPandas(parts, schema).groupBy(key).applyInPandas(corners, schema)
