"""Polygons as geometry: by hand, against grids of points, and on shapes at random."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeworks.functions import projection
from placeworks.operators import interpolate, shapes, simplify, spatial, voronoi

SCHEMA = "k long, rings array<array<struct<x:double,y:double>>>"
ELL = [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)]
SQUARE, HOLE = [(1, 1), (5, 1), (5, 5), (1, 5)], [(2, 2), (2, 4), (4, 4), (4, 2)]


def polygons(spark, rows, key="k"):
    told = [(k, [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in rows]
    return spatial.rings_to_edges(spark.createDataFrame(told, SCHEMA), "k").withColumnRenamed("k", key)


def inside(rings, g):
    """Even-odd, of plain rings [(x, y), ...] at places g."""
    odd = np.zeros(len(g), bool)
    for r in rings:
        xy = np.array(r, float)
        for (x1, y1), (x2, y2) in zip(xy, np.roll(xy, -1, axis=0), strict=True):
            if y1 != y2:
                odd ^= ((y1 > g[:, 1]) != (y2 > g[:, 1])) & (g[:, 0] < (x2 - x1) * (g[:, 1] - y1) / (y2 - y1) + x1)
    return odd


def plain(rows, *keys):
    return {tuple(r[k] for k in keys): [[(p.x, p.y) for p in ring] for ring in r.rings] for r in rows.collect()}


def area(rings):
    turns = [sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True)) / 2 for r in rings]
    return sum(turns)


def grid(low, high, n):
    step = (high - low) / n
    return (np.stack(np.meshgrid(np.arange(n), np.arange(n)), -1).reshape(-1, 2) + 0.5) * step + low


@pytest.mark.parametrize("size", [0.7, 2.0, 50.0])
def test_an_ell_and_a_square_with_a_hole(spark, size):
    a, b = polygons(spark, [(1, [ELL])]), polygons(spark, [(2, [SQUARE, HOLE])], "j")
    assert shapes.shared_area([(a, "k"), (b, "j")], size).first().area == pytest.approx(7.0)
    found = plain(shapes.fragments(a, b, "k", "j", size), "k", "j")
    assert list(found) == [(1, 2)] and area(found[1, 2]) == pytest.approx(7.0)
    assert sorted(found[1, 2][0]) == [(1, 1), (1, 5), (2, 2), (2, 5), (5, 1), (5, 2)] and len(found[1, 2]) == 1
    whole = polygons(spark, [(9, [[(-1, -1), (9, -1), (9, 9), (-1, 9)]])], "j")
    kept = plain(shapes.fragments(polygons(spark, [(2, [SQUARE, HOLE])]), whole, "k", "j", size), "k", "j")[2, 9]
    assert sorted(map(len, kept)) == [4, 4] and area(kept) == pytest.approx(12) and area(kept[:1]) * area(kept[1:]) < 0


@pytest.mark.parametrize("scale", [1e-4, 1.0, 1e5])
def test_small_overlaps_are_kept_and_touching_is_not(spark, scale):
    """Two squares that overlap by half, and one that only touches, whatever the unit; far from the origin too."""
    at = lambda x, y: [(-79 + scale * (x + a), 35 + scale * (y + b)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    a, b = polygons(spark, [(1, [at(0, 0)])]), polygons(spark, [(2, [at(0.5, 0)]), (3, [at(1, 0)]), (4, [at(0, -1)])], "j")
    got = {r.j: r.area for r in shapes.shared_area([(a, "k"), (b, "j")], scale * 0.8).collect()}
    assert got == {2: pytest.approx(scale * scale / 2, rel=1e-6)}


def test_faces_of_rings_that_cross_or_repeat(spark):
    bow, twice, star = [(0, 0), (4, 4), (4, 0), (0, 4)], [(0, 0), (3, 0), (3, 3), (0, 3)] * 2, [(0, 0), (6, 4), (0, 4), (6, 0), (3, 7)]
    rows = [(1, [bow]), (2, [twice]), (3, [star]), (4, [SQUARE[::-1], HOLE[::-1]]), (5, [[(0, 0), (1, 1)]]), (6, [[(0, 0), (4, 0), (4, 3), (4, 0)]])]
    found = plain(shapes.valid(polygons(spark, rows), "k", 1.3), "k")
    assert set(found) == {(1,), (3,), (4,)}
    assert area(found[1,]) == pytest.approx(8) and sorted(map(len, found[1,])) == [3, 3]
    g = grid(-1, 8, 700)
    for k, rings in ((3, [star]), (4, [SQUARE, HOLE])):
        assert area(found[k,]) == pytest.approx(inside(rings, g).sum() * (9 / 700) ** 2, rel=0.01)
        assert (inside(found[k,], g) == inside(rings, g)).mean() > 0.9999
    outer = [r for r in found[4,] if area([r]) > 0]
    assert len(outer) == 1 and area(outer) == pytest.approx(16)


@pytest.mark.parametrize(("seed", "size"), [(1, 1.7), (2, 40.0), (3, 0.9)])
def test_unions_and_fragments_at_random(spark, seed, size):
    """Triangles and stars of two labels against a grid, whatever the cells."""
    rng = np.random.default_rng(seed)

    def shape():
        angle = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 9)))
        return np.column_stack([np.cos(angle), np.sin(angle)]) * rng.uniform(0.4, 2.2, (len(angle), 1)) + rng.uniform(2, 8, 2)

    rows = [(i, [shape().tolist()]) for i in range(14)]
    edges = polygons(spark, rows).withColumn("label", F.col("k") % 2)
    union = plain(shapes.union(edges, "k", "label", size), "label")
    g = grid(0, 10, 500)
    for label in (0, 1):
        expected = np.any([inside(rings, g) for k, rings in rows if k % 2 == label], 0)
        assert (inside(union[label,], g) == expected).mean() > 0.9999
        assert area(union[label,]) == pytest.approx(expected.sum() * 4e-4, rel=0.01)
        swept = shapes.union_trapezoids(edges, "k", "label", size).where(F.col("label") == label).agg(F.sum(shapes.area_of())).first()[0]
        assert area(union[label,]) == pytest.approx(swept, rel=1e-9)
    parts = plain(shapes.fragments(edges.where("label = 0"), edges.where("label = 1").withColumnRenamed("k", "j"), "k", "j", size), "k", "j")
    shared = {(r.k, r.j): r.area for r in shapes.shared_area([(edges.where("label = 0"), "k"), (edges.where("label = 1").withColumnRenamed("k", "j"), "j")], size).collect()}
    assert {k: area(r) for k, r in parts.items()} == pytest.approx({k: v for k, v in shared.items() if k in parts}, rel=1e-6)
    for (k, j), rings in parts.items():
        assert (inside(rings, g) == (inside(rows[k][1], g) & inside(rows[j][1], g))).mean() > 0.9999
    assert all(v < 1e-6 for k, v in shared.items() if k not in parts)


def test_no_polygons(spark):
    none, some = polygons(spark, []), polygons(spark, [(1, [ELL])], "j")
    assert shapes.fragments(none, some, "k", "j", 1.0).count() == 0
    assert shapes.union(none.withColumn("label", F.lit(1)), "k", "label", 1.0).count() == 0
    assert shapes.polygon_distance(none, some, "k", "j", 1.0, 1.0).count() == 0
    assert shapes.union(some.withColumn("label", F.lit(None).cast("long")), "j", "label", 1.0).count() == 0


def test_distances_of_polygons(spark):
    a = polygons(spark, [(1, [ELL]), (2, [SQUARE, HOLE])])
    b = polygons(spark, [(1, [[(2.5, 2.5), (3.5, 2.5), (3.5, 3.5), (2.5, 3.5)]]), (2, [[(9, 6), (10, 6), (9, 7)]]), (3, [[(0.2, 0.2), (0.8, 0.2), (0.5, 0.9)]]), (4, [[(-5, -5), (20, -5), (20, 20), (-5, 20)]]), (5, [[(6, 1), (7, 0), (7, 2)]]), (6, [[(90, 90), (91, 90), (91, 91)]])], "j")
    got = {(r.k, r.j): r.distance for r in shapes.polygon_distance(a, b, "k", "j", 5.0, 1.5).collect()}
    expected = {(1, 1): 0.5, (1, 2): 5.0, (1, 3): 0, (1, 4): 0, (1, 5): 0, (2, 1): 0.5, (2, 2): np.hypot(4, 1), (2, 4): 0, (2, 5): 1.0}
    near = min(np.hypot(x - 1, y - 1) for x, y in [(0.8, 0.2), (0.5, 0.9)])
    # The triangle's side from (0.8, 0.2) to (0.5, 0.9) and the square's corner (1, 1).
    d = np.array([-0.3, 0.7])
    t = np.clip(np.dot([0.2, 0.8], d) / np.dot(d, d), 0, 1)
    expected[2, 3] = min(near, float(np.hypot(*(np.array([0.2, 0.8]) - t * d))))
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("kind", ["random", "lattice", "line"])
def test_nearest_zones_are_a_partition(spark, kind):
    """Disjoint, without gaps, and every place has the label of its nearest point; equal distances of a lattice too."""
    rng = np.random.default_rng(7)
    places = {"random": rng.uniform(0, 100, (60, 2)), "lattice": np.array(list(itertools.product(range(5, 100, 10), repeat=2)), float), "line": np.array([(float(x), 50.0) for x in range(3, 99, 8)])}[kind]
    rows = [(i, f"l{i % 4}", float(x), float(y)) for i, (x, y) in enumerate(places)] + [(900, "l0", None, 1.0), (901, "l9", 500.0, 500.0), (902, "l9", float(places[0][0]), float(places[0][1]))]
    points = spark.createDataFrame(rows, "p long, label string, x double, y double")
    box = (0.0, 0.0, 100.0, 100.0)
    cells = collections.defaultdict(list)
    for r in voronoi.nearest_cells(points, "p", box, 9.0).collect():
        cells[r.p].append((r.x1, r.y1, r.x2, r.y2))
    assert set(cells) == set(range(len(places)))
    assert sum(sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in e) / 2 for e in cells.values()) == pytest.approx(1e4, rel=1e-9)
    district = [(10, 10), (90, 10), (90, 50), (50, 50), (50, 90), (10, 90)]
    zones = {r.label: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in voronoi.nearest_zones(points, "p", "label", polygons(spark, [(1, [district])]), box, 9.0, 21.0).collect()}
    assert sum(map(area, zones.values())) == pytest.approx(80 * 80 - 40 * 40, rel=1e-9)
    g = rng.uniform(0, 100, (4000, 2))
    nearest = np.hypot(g[:, None, 0] - places[None, :, 0], g[:, None, 1] - places[None, :, 1]).argmin(1)
    within = inside([district], g)
    for label, rings in zones.items():
        assert (inside(rings, g) == (within & (nearest % 4 == int(label[1])))).all()


def test_simplified_neighbours_share_their_border(spark):
    """Three winding neighbours and an island: no gap or overlap, corners where three meet stay, nothing moves by more than the tolerance."""
    rng = np.random.default_rng(11)

    def winding(p, q):
        t = np.linspace(0, 1, 41)[1:-1, None]
        return [tuple(p), *map(tuple, (np.array(p) * (1 - t) + np.array(q) * t + np.sin(np.pi * t) * rng.uniform(-0.1, 0.1, (39, 2))).tolist()), tuple(q)]

    o, corners = (5.0, 5.0), [(0.0, 0.0), (10.0, 0.0), (5.0, 10.0)]
    spokes, sides = [winding(o, c) for c in corners], [winding(corners[i], corners[(i + 1) % 3]) for i in range(3)]
    rings = [(i, [(spokes[i][:-1] + sides[i][:-1] + spokes[(i + 1) % 3][::-1])[:-1]]) for i in range(3)]
    angle = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    rings.append((9, [(np.column_stack([np.cos(angle), np.sin(angle)]) + [20, 20]).tolist()]))
    edges = polygons(spark, rings)
    found = plain(simplify.simplified(edges, "k", 0.25), "k")
    assert set(found) == {(0,), (1,), (2,), (9,)}
    assert all(len(found[i,][0]) < 20 and set(found[i,][0]) >= {o, corners[i], corners[(i + 1) % 3]} for i in range(3))
    assert sum(len(r[0]) for r in found.values()) < sum(len(r[0]) for _, r in rings) / 4
    whole = polygons(spark, [(1, [[p for side in sides for p in side[:-1]]])])
    border = plain(simplify.simplified(whole, "k", 1e-12), "k")
    g = grid(-1.0031, 11.0017, 300) + [0.0007, 0]
    counts = sum(inside(found[i,], g).astype(int) for i in range(3))
    assert counts.max() == 1 and abs(counts.sum() - inside(border[1,], g).sum()) < 0.05 * counts.sum()
    pairs = {frozenset(e) for i in range(3) for e in zip(found[i,][0], found[i,][0][1:] + found[i,][0][:1], strict=True)}
    assert sum(len(found[i,][0]) for i in range(3)) - len(pairs) == sum(1 for p in pairs if sum(p == frozenset(e) for i in range(3) for e in zip(found[i,][0], found[i,][0][1:] + found[i,][0][:1], strict=True)) == 2)
    assert abs(area(found[9,]) - np.pi) < 2 * np.pi * 0.25


def test_transverse_mercator(spark):
    """Both ways within a millimetre over a zone, and published values: the scale on the meridian, and a tower in Toronto."""
    rows = [(float(lat), float(lon)) for lat in np.linspace(0, 84, 29) for lon in np.linspace(-84, -78, 13)] + [(43.642567, -79.387139)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    e, n = projection.utm(F.col("lat"), F.col("lon"), 17)
    df = df.select("lat", "lon", e.alias("e"), n.alias("n"))
    lat, lon = projection.from_utm(F.col("e"), F.col("n"), 17)
    got = df.select("lat", "lon", "e", "n", lat.alias("lat2"), lon.alias("lon2")).collect()
    for r in got:
        metre = 1 / 111_000
        assert abs(r.lat - r.lat2) < 1e-3 * metre and abs(r.lon - r.lon2) * np.cos(np.radians(r.lat)) < 1e-3 * metre
    tower = got[-1]
    assert (tower.e, tower.n) == pytest.approx((630084, 4833439), abs=1.5)
    middle = [r for r in got if r.lon == -81.0]
    assert all(r.e == pytest.approx(500_000, abs=1e-6) for r in middle) and max(middle, key=lambda r: r.lat).n == pytest.approx(9328093.8, abs=1)


def test_dots_lie_where_they_may(spark):
    """Counts come out exactly; dots are on homes where there are any, evenly by area, else in the whole area; one too small has none."""
    areas = polygons(spark, [(1, [ELL]), (2, [SQUARE, HOLE]), (3, [[(0, 0), (1, 0), (0, 1)]]), (4, [[(20, 0), (30, 0), (25, 12)]])])
    homes = polygons(spark, [(7, [[(-5, -5), (4, -5), (4, 1.5), (-5, 1.5)]]), (8, [[(1, 0), (9, 0), (9, 1.8), (1, 1.8)]])], "home")
    places = interpolate.placement(shapes.trapezoids(areas, "k", 3.0), shapes.trapezoids(homes, "home", 3.0), "k", "home", 3.0, 4.0)
    counts = spark.createDataFrame([(1, "a", 500), (1, "b", 1), (2, "a", 300), (3, "a", 9), (4, "a", 2000), (4, "b", 0), (4, "c", None)], "k long, category string, n long")
    rows = interpolate.placed_dots(places, counts, "k").collect()
    assert collections.Counter((r.k, r.category) for r in rows) == {(1, "a"): 500, (1, "b"): 1, (2, "a"): 300, (4, "a"): 2000}
    assert sorted(r.dot for r in rows if (r.k, r.category) == (4, "a")) == list(range(1, 2001))
    at = {k: np.array([(r.x, r.y) for r in rows if r.k == k]) for k in (1, 2, 4)}
    # Homes cover 10.1 of the first; they cover less than 4 of the second, whose hole stays empty.
    x, y = at[1].T
    assert inside([ELL], at[1]).all() and ((x <= 4) & (y <= 1.5) | (x >= 1) & (y <= 1.8)).all()
    assert np.mean(x < 1) == pytest.approx(1.5 / (6 * 1.8 - 0.3), abs=0.02)
    assert inside([SQUARE, HOLE], at[2]).all() and (at[2][:, 1] > 2).any()
    # A triangle as high as 12: the lower half holds three quarters, and each side half.
    x, y = at[4].T
    assert inside([[(20, 0), (30, 0), (25, 12)]], at[4]).all()
    assert np.mean(y < 6) == pytest.approx(0.75, abs=0.03) and np.mean(x < 25) == pytest.approx(0.5, abs=0.01) and np.mean(x < 22.5) == pytest.approx(0.125, abs=0.01)


def test_points_in_buffers(spark):
    """A square with a hole and one that a diagonal bounds: inside, in the hole, on the border, about a corner, without a place."""
    rings = [(1, [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (3, 7), (7, 7), (7, 3)]]), (2, [[(20, 0), (30, 0), (20, 10)]])]
    edges = polygons(spark, rings, "zone")
    places = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 10.0, 5.0), (4, 13.0, 14.0), (5, 25.0, 6.0), (6, 100.0, 0.0), (7, None, 1.0), (8, 15.0, 2.0)]
    points = spark.createDataFrame(places, "p long, x double, y double")
    for size in (1.0, 4.0, 100.0):
        got = {(r.zone, r.p): round(r.distance, 6) for r in shapes.point_distance(edges, points, "zone", "p", 5.0, size).collect()}
        assert got == {(1, 1): 0, (1, 2): 2, (1, 3): 0, (1, 4): 5, (2, 5): round(0.5**0.5, 6), (1, 8): 5, (2, 8): 5}


def test_small_polygons_are_cut_up_as_large_ones():
    """Any number of lines, crossing, equal, and strips that hold none of them: the same trapezoids."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 4, 7, 24):
        ends = np.sort(rng.integers(0, 9, (40, n, 2)), axis=2) + [0, 1]
        lines = np.stack([ends[..., 0], rng.integers(0, 9, (40, n)), ends[..., 1], rng.integers(0, 9, (40, n))], 2).astype(float)
        lo, hi = np.maximum(lines[..., 0].min(1), 2.5), np.minimum(lines[..., 2].max(1), 7.25)
        who, table = shapes._pieces_of_many(lines, lo, hi)
        told = sorted((int(i), *row) for i, row in zip(who, table.tolist(), strict=True))
        assert told == sorted((i, *row) for i in range(40) for row in shapes._pieces(lines[i], lo[i], hi[i]).tolist())


def test_sides_that_are_cut_at_other_places_cancel(spark):
    """Triangles on both sides of a sloped line: one ring, without the line."""
    corners = {1: [(0.0, 0.0), (12.0, 6.0), (3.0, 9.0)], 2: [(0.0, 0.0), (7.0, -2.0), (12.0, 6.0)]}
    edges = spark.createDataFrame([(p, *c[i], *c[(i + 1) % 3]) for p, c in corners.items() for i in range(3)], "p long, x1 double, y1 double, x2 double, y2 double")
    traps = shapes.trapezoids(edges, "p", 100.0).select(F.lit(1).alias("k"), *shapes.PLACES)
    border = {tuple(r)[1:] for r in shapes.outline(traps, ["k"]).collect()}
    assert border == {(0.0, 0.0, 7.0, -2.0), (7.0, -2.0, 12.0, 6.0), (12.0, 6.0, 3.0, 9.0), (3.0, 9.0, 0.0, 0.0)}


@pytest.mark.parametrize("turn", range(5))
def test_a_corner_that_rounding_made_two_stays(turn):
    """Two corners at a distance of rounding are both flat; one of them has to stay, wherever the ring begins."""
    ring = [(10.0, 51.7), (11.532410999999998, 55.387466), (11.532411, 55.387466), (20.0, 58.0), (10.0, 60.0)]
    assert area([shapes._plain(ring[turn:] + ring[:turn])]) == pytest.approx(area([ring]), abs=1e-9)


@pytest.mark.parametrize("size", [1.0, 2.5, 100.0])
def test_points_meet_only_the_edges_of_their_cell(spark, size):
    """A winding border, holes, edges and corners on lines of cells, and a ring with an edge missing: as even-odd of all edges, and a cell holds only what passes through it."""
    rng = np.random.default_rng(3)
    teeth = [(float(x), float(y)) for x, y in zip(np.arange(120) / 3, rng.choice([1.0, 2.0, 2.25, 4.75, 6.0, 9.5], 120), strict=True)]
    rows = [(1, [[(-1, -3), *teeth, (41, -3)], [(3, -2), (3, 0), (9, 0), (9, -2)]]), (2, [[(0, 0), (40, 0), (40, 10), (30, 5), (20, 10), (10, 5), (0, 10)]]), (3, [rng.uniform(0, 10, (40, 2)).tolist()])]
    edges = polygons(spark, rows).where("NOT (k = 3 AND x1 < 2)")
    # A missing edge leaves a ring open; one without a place counts as missing.
    edges = edges.withColumn("x2", F.when(~((F.col("k") == 3) & (F.col("x1") > 9)), F.col("x2")))
    g = np.concatenate([grid(-4, 44, 40), np.array(list(itertools.product(range(-3, 42, 2), range(-3, 11)))), np.array(teeth), rng.uniform(0, 10, (300, 2))])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(g)], "p long, x double, y double")
    found = {(r.p, r.k) for r in spatial.point_in_polygon(points, edges, "p", "k", size).collect()}
    for k in (1, 2, 3):
        odd = np.zeros(len(g), bool)
        for e in edges.where((F.col("k") == k) & F.col("x2").isNotNull() & (F.col("y1") != F.col("y2"))).collect():
            odd ^= ((e.y1 > g[:, 1]) != (e.y2 > g[:, 1])) & (g[:, 0] < (e.x2 - e.x1) * (g[:, 1] - e.y1) / (e.y2 - e.y1) + e.x1)
        if k == 3:  # an open ring has nothing to the left of the first cell of its row that an edge passes through
            own = np.array([(e.x1, e.y1, e.x2, e.y2) for e in edges.where("k = 3 AND x2 IS NOT NULL").collect()])
            low = np.floor(g[:, 1:] / size) * size
            y = np.clip(np.stack([low, low + size], 2), np.minimum(own[:, 1], own[:, 3])[:, None], np.maximum(own[:, 1], own[:, 3])[:, None])
            least = (own[:, [0]] + (own[:, [2]] - own[:, [0]]) * (y - own[:, [1]]) / (own[:, [3]] - own[:, [1]])).min(2)
            passes = (np.minimum(own[:, 1], own[:, 3]) < low + size) & (np.maximum(own[:, 1], own[:, 3]) >= low)
            odd &= np.floor(g[:, 0] / size) >= np.floor(np.where(passes, least, np.inf).min(1) / size)
        assert {i for i, j in found if j == k} == set(np.flatnonzero(odd).tolist())
    most = spatial.polygon_cells(edges.where("k = 1"), "k", size).agg(F.max(F.size("_edges")), F.max(F.size("_turns"))).first()
    assert max(most) <= 3 * size + 8


def test_only_cells_at_the_border_are_cut(spark, monkeypatch):
    """Of 3,600 cells those inside the district come as they are; the zones are whole, whatever the size of the cells they are cut in."""
    rng = np.random.default_rng(4)
    rows = [(i, f"l{i % 3}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (3600, 2)))]
    points, made, cut_up = spark.createDataFrame(rows, "p long, label string, x double, y double"), [], shapes.trapezoids
    monkeypatch.setattr(shapes, "trapezoids", lambda edges, key, size: made.append(edges.select(key).distinct().count()) or cut_up(edges, key, size))
    district = [(10, 10), (90, 10), (90, 50), (50, 50), (50, 90), (10, 90)]
    found = plain(voronoi.nearest_zones(points, "p", "label", polygons(spark, [(1, [district])]), (0.0, 0.0, 100.0, 100.0), 50.0, 21.0), "label")
    assert sum(map(area, found.values())) == pytest.approx(80 * 80 - 40 * 40, rel=1e-9)
    assert sorted(made)[0] == 1 and sorted(made)[1] < 700
    g, xy = rng.uniform(0, 100, (2000, 2)), np.array([r[2:] for r in rows])
    nearest = np.array([np.hypot(*(xy - q).T).argmin() for q in g])
    within = inside([district], g)
    for (label,), rings in found.items():
        assert (inside(rings, g) == (within & (nearest % 3 == int(label[1])))).all()


def test_a_key_in_several_places_has_all_of_their_cells(spark):
    places = [(1, 2.0, 2.0), (1, 4.0, 2.0), (2, 8.0, 8.0), (1, 9.0, 1.0)]
    points = spark.createDataFrame([(k, f"l{k}", x, y) for k, x, y in places], "p long, label string, x double, y double")
    box = (0.0, 0.0, 10.0, 10.0)
    cells = [(r.p, r.x1 * r.y2 - r.x2 * r.y1) for r in voronoi.nearest_cells(points, "p", box, 3.0).collect()]
    assert sum(a for _, a in cells) / 2 == pytest.approx(100)
    whole = polygons(spark, [(1, [[(0, 0), (10, 0), (10, 10), (0, 10)]])])
    zones = plain(voronoi.nearest_zones(points, "p", "label", whole, box, 3.0, 4.0), "label")
    assert {k: area(r) for (k,), r in zones.items()} == pytest.approx({f"l{k}": sum(a for p, a in cells if p == k) / 2 for k in (1, 2)})


def test_rings_that_touch_are_kept_apart():
    """Squares that meet at corners, with a hole that does, as one label's edges: each is a ring of its own, whatever order its edges come in."""
    rng = np.random.default_rng(6)
    squares = [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)] for x, y in ((0, 0), (1, 1), (2, 0), (2, 2), (0, 2))]
    edges = np.array([(*p, *q) for r in squares for p, q in zip(r, r[1:] + r[:1], strict=True)], float)
    for _ in range(5):
        p, n = shapes._straightened(*shapes._linked(rng.permutation(edges)))
        assert n.tolist() == [4] * 5 and len(p) == 20
        assert sorted(area([r.tolist()]) for r in np.split(p, np.cumsum(n)[:-1])) == [1.0] * 5
