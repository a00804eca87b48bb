"""Golden values, edge cases and properties of the operators."""

import collections
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from placeworks.functions import clean, geo
from placeworks.operators import choice, exposure, interpolate, network, profile, proximity, shapes, spatial, tables
from placeworks.sources import inputs, readers, sinks


def test_haversine_one_degree(spark):
    row = spark.range(1).select(geo.haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first()
    assert row.d == pytest.approx(3959 * math.pi / 180)


def test_radius_is_inclusive_and_empty_sites_count_zero(spark):
    f = spark.createDataFrame([(1, 0.0, 0.0, 5.0)], "facility long, x double, y double, weight double")
    s = spark.createDataFrame([(1, 3.0, 4.0), (2, 100.0, 0.0)], "site long, site_x double, site_y double")
    out = {r.site: r.raw_5 for r in exposure.decay_sums(s, f.select("x", "y", "weight"), (5,)).collect()}
    assert out == {1: pytest.approx(5 * math.exp(-0.015)), 2: 0.0}


def test_bands_of_no_facilities(spark):
    f = spark.createDataFrame([], "facility long, lat double, lon double, capacity double")
    s = spark.createDataFrame([(1, 36.0, -79.0)], "site long, site_lat double, site_lon double")
    assert {(r.radius, r.n) for r in proximity.band_counts(f, s).collect()} == {(0.25, 0), (0.5, 0), (1.0, 0), (2.0, 0)}


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def polygons(spark, rows):
    return spark.createDataFrame(rows, "zone long, rings array<array<struct<x:double,y:double>>>")


def test_concave_ring_and_hole(spark):
    rows = [(1, [ring((0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6))]), (2, [ring((1, 1), (5, 1), (5, 5), (1, 5)), ring((2, 2), (2, 4), (4, 4), (4, 2))])]
    p = polygons(spark, rows)
    assert {r.zone: r.area for r in spatial.polygon_area(p, "zone").collect()} == {1: 20.0, 2: 12.0}
    points = spark.createDataFrame([(1, 1.0, 5.0), (2, 4.0, 4.5), (3, 3.0, 3.0), (4, 1.5, 1.5)], "point long, x double, y double")
    found = {(r.point, r.zone) for r in spatial.point_in_polygon(points, spatial.rings_to_edges(p, "zone"), "point", "zone").collect()}
    assert found == {(1, 1), (2, 2), (4, 1), (4, 2)}


def test_overlay_is_symmetric_and_unique(spark):
    rng = np.random.default_rng(0)
    boxes = lambda n, p: spark.createDataFrame([(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.uniform(0.1, 9, (n, 4)))], f"{p} long, {p}x1 double, {p}y1 double, {p}x2 double, {p}y2 double")
    a, b = boxes(20, "a"), boxes(20, "b")
    one = {(r.a, r.b): r.area for r in spatial.overlay(a, b, 2.0).collect()}
    two = {(r.a, r.b): r.area for r in spatial.overlay(b.withColumnsRenamed({c: "a" + c[1:] for c in b.columns}), a.withColumnsRenamed({c: "b" + c[1:] for c in a.columns}), 3.0).collect()}
    assert spatial.overlay(a, b, 2.0).count() == len(one)
    assert {(j, i): v for (i, j), v in two.items()} == pytest.approx(one)


def test_group_without_homes_falls_back_to_area(spark):
    z = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 10.0)], "zone long, x1 double, y1 double, x2 double, y2 double")
    g = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "bg long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([], "x1 double, y1 double, x2 double, y2 double")
    assert interpolate.fragments(z, g, p, 4.0).first().weight == 0.5


def test_dots_stay_inside_and_repeat(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 7.0), (2, 0.0, 0.0, 1.0, 1.0, 9.0)], "block long, x1 double, y1 double, x2 double, y2 double, a double")
    one, two = (sorted(map(tuple, interpolate.dots(b, ["a"], 2, 10.0).collect())) for _ in range(2))
    assert one == two and len(one) == 3 and all(0 <= r[3] <= 10 and 0 <= r[4] <= 10 for r in one)


def test_diamond_ties_and_closures(spark):
    e = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1)], "u long, v long, w long")
    sources = spark.createDataFrame([(7, 0)], "site long, node long")
    paths = network.shortest_paths(sources, e)
    assert {(r.node, r.dist) for r in paths.collect()} == {(0, 0), (1, 1), (2, 1), (3, 2)}
    preds = network.predecessors(paths, e, sources)
    assert {(r.node, r.pred) for r in preds.collect()} == {(1, 0), (2, 0), (3, 1)}
    demand = spark.createDataFrame([(7, 3, 5), (7, 1, 2)], "site long, node long, amount long")
    assert {(r.u, r.v, r.amount) for r in network.edge_traffic(demand, preds).collect()} == {(3, 1, 5), (1, 0, 7)}
    times = spark.createDataFrame([(1, 1, 5.0, 0), (1, 2, 5.0, 0), (1, 3, 9.0, 0)], "pixel long, site long, time double, entry long")
    assert network.closure(times, []).first().site == 1
    assert network.closure(times, [1, 2]).first().time == 9.0


def test_closing_never_shortens(spark):
    rng = np.random.default_rng(1)
    t = spark.createDataFrame([(p, s, float(rng.integers(1, 50)), 0) for p in range(30) for s in range(5)], "pixel long, site long, time double, entry long")
    base, closed = ({r.pixel: r.time for r in network.closure(t, c).collect()} for c in ([], [0, 1]))
    assert len(base) == len(closed) == 30 and all(closed[p] >= base[p] for p in base)


def test_cleaning(spark):
    row = spark.range(1).select(
        clean.money(F.lit("$1,234.5")).alias("a"), clean.money(F.lit("n/a")).alias("b"), clean.fix_address(F.lit(" 207 and 209 Erwin Toad ")).alias("c"),
        clean.flood_class(F.lit("X"), F.lit("0.2 pct annual")).alias("d"), clean.guarded_percent(F.lit(1), F.lit(0)).alias("e"),
    ).first()
    assert tuple(row) == (1234.5, None, "207 Erwin Road", 500, 0.0)


def test_profiles_of_empty_tables(spark):
    empty = spark.createDataFrame([], "a string, v double")
    assert profile.completeness(empty, ["a"]).count() == 0
    assert profile.histogram(empty, "v", 0.0, 1.0).count() == 15
    assert profile.repeated_places(empty, "a", "v").first().n_rows == 0


def test_quantiles_of_many_values(spark, monkeypatch):
    """The search by ranges against numpy: ties, null keys and values, skew, a key of one value."""
    rng = np.random.default_rng(2)
    data = {None: np.exp(rng.normal(0, 4, 300)), "a": rng.integers(0, 5, 400).astype(float), "b": np.full(50, 7.0), "c": np.append(rng.normal(size=200), 1e12)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("d", None), ("c", float("nan")), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    plain = {r.k: (r.q05, r.q25, r.q50, r.q75, r.q95) for r in profile.quantiles(df, "v", ["k"]).collect()}
    monkeypatch.setattr(profile, "MANY", 9)
    monkeypatch.setattr(profile, "BINS", 8)
    found = {r.k: (r.q05, r.q25, r.q50, r.q75, r.q95) for r in profile.quantiles(df, "v", ["k"]).collect()}
    for k, vs in data.items():
        assert found[k] == pytest.approx(np.quantile(vs, (0.05, 0.25, 0.5, 0.75, 0.95)), rel=1e-6, abs=1e-6) == plain[k]
    assert {r.k: r.median for r in profile.upper_median(df, "v", ["k"]).collect()} == {k: sorted(vs)[len(vs) // 2] for k, vs in data.items()}
    assert set(found) == set(plain) == {*data, "d", "e"} and found["d"] == plain["d"] == found["e"] == plain["e"] == (None,) * 5
    whole = profile.quantiles(df.where("k = 'a'"), "v", (), {"mid": 0.5}).first()
    assert whole.mid == np.median(data["a"])


@pytest.mark.parametrize("many", [7, 100_000])
def test_weighted_quantiles_are_those_of_the_expanded_rows(spark, monkeypatch, many):
    monkeypatch.setattr(profile, "MANY", many)
    monkeypatch.setattr(profile, "BINS", 8)
    rng = np.random.default_rng(4)
    rows = [(str(k), float(v), int(n)) for k, v, n in zip(rng.integers(0, 3, 90), rng.normal(size=90).round(1), rng.integers(0, 2000, 90), strict=True)] + [("9", 1.0, 0), ("9", None, 5), ("1", 99.0, None), ("1", float("nan"), 9), ("2", -99.0, -4)]
    got = {r.k: tuple(r)[1:] for r in profile.quantiles(spark.createDataFrame(rows, "k string, v double, n long"), "v", ["k"], weight="n").collect()}
    assert got.pop("9") == (None,) * 5
    for k, found in got.items():
        expanded = np.repeat([v for key, v, n in rows if key == k and n and n > 0 and v == v], [n for key, v, n in rows if key == k and n and n > 0 and v == v])
        assert found == pytest.approx(np.quantile(expanded, (0.05, 0.25, 0.5, 0.75, 0.95)), abs=1e-6)
    assert set(got) == {"0", "1", "2"}


def test_nearest_beyond_one_array(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MOST_SITES", 3)
    rng = np.random.default_rng(3)
    p, s = rng.uniform(-500, 500, (80, 2)), np.concatenate([rng.uniform(-500, 500, (40, 2)), [[9000, 9000]]])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([*p, (20000.0, 0.0), (0.0, -30000.0)])], "point long, x double, y double")
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(s)], "site long, site_x double, site_y double")
    d = lambda t: F.sqrt(F.pow(F.col("x") - t["site_x"], 2) + F.pow(F.col("y") - t["site_y"], 2))
    out = spatial.nearest(points, sites, d, ["site", "site_x", "site_y"], "site", (F.col("x"), F.col("y")), (F.col("site_x"), F.col("site_y")), (30.0, 30.0, 30.0)).collect()
    assert len(out) == 82
    for r in out:
        far = np.hypot(s[:, 0] - r.x, s[:, 1] - r.y)
        assert r.nearest.site == far.argmin() and r.nearest.distance == pytest.approx(far.min())


@pytest.mark.parametrize("most", [1, 4096])
def test_nearest_of_no_place(spark, monkeypatch, most):
    """Points and sites without a place are near to nothing, however many sites there are."""
    monkeypatch.setattr(spatial, "MOST_SITES", most)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 50.0, None)], "point long, x double, y double")
    sites = spark.createDataFrame([(5, None, 1.0), (6, 3.0, 4.0), (7, -9.0, 9.0)], "site long, site_x double, site_y double")
    d = lambda t: F.sqrt(F.pow(F.col("x") - t["site_x"], 2) + F.pow(F.col("y") - t["site_y"], 2))
    near = lambda s: {r.point: r.nearest and (r.nearest.site, r.nearest.distance) for r in spatial.nearest(points, s, d, ["site", "site_x", "site_y"], "site", (F.col("x"), F.col("y")), (F.col("site_x"), F.col("site_y")), (4.0, 4.0, 4.0)).collect()}
    assert near(sites) == {1: (6, 5.0), 2: None, 3: None}
    assert near(sites.where("site = 5")) == near(sites.where("site = 0")) == {1: None, 2: None, 3: None}


def test_nearest_in_dense_tables(spark, monkeypatch):
    """Searches begin in cells that hold a few sites, so rows that meet do not grow with the square of the table; what is beyond `most` is near to nothing."""
    monkeypatch.setattr(spatial, "MOST_SITES", 3)
    rng = np.random.default_rng(5)
    p, s = rng.uniform(0, 100, (60, 2)), np.concatenate([rng.uniform(0, 100, (400, 2)), [[900, 900], [900, 900]]])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([*p, (903.0, 904.0), (950.0, 950.0)])], "point long, x double, y double")
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(s)], "site long, site_x double, site_y double")
    assert spatial.halvings(sites, F.col("site_x"), F.col("site_y"), (100.0, 100.0), 16) > 1
    d = lambda t: F.round(F.sqrt(F.pow(F.col("x") - t["site_x"], 2) + F.pow(F.col("y") - t["site_y"], 2)), 6)
    near = lambda t: F.when(d(t) <= 20, d(t))
    out = {r.point: r.nearest for r in spatial.nearest(points, sites, near, ["site", "site_x", "site_y"], "site", (F.col("x"), F.col("y")), (F.col("site_x"), F.col("site_y")), (21.0, 21.0, 21.0), 20.0).collect()}
    assert len(out) == 62 and out[61] is None and (out[60].site, out[60].distance) == (400, 5.0)
    for i, (x, y) in enumerate(p):
        far = np.hypot(s[:, 0] - x, s[:, 1] - y).round(6)
        assert (out[i].site, out[i].distance) == (far.argmin(), pytest.approx(far.min()))


def _to_segments(s, x, y):
    d = s[:, 2:] - s[:, :2]
    t = np.clip((((np.array([x, y]) - s[:, :2]) * d).sum(1)) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.hypot(s[:, 0] + t * d[:, 0] - x, s[:, 1] + t * d[:, 1] - y), t


def test_nearest_segments_by_growing_cells(spark):
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 300, (300, 2))
    s, p = np.concatenate([np.column_stack([a, a + rng.uniform(-40, 40, (300, 2))]), [[700, 700, 700, 700]]]), np.concatenate([rng.uniform(0, 300, (50, 2)), [[703, 704], [800, 800]]])
    lines = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(s)], "road long, ax double, ay double, ex double, ey double")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(99, None, 1.0)], "point long, x double, y double")
    got = {r.point: r for r in spatial.nearest_segments(points, lines, "point", "road", 60.0).collect()}
    assert set(got) == set(range(51)) and got[50].distance == 5.0
    for i, r in got.items():
        far, t = _to_segments(s, *p[i])
        assert r.road == far.round(6).argmin() and r.distance == pytest.approx(far.min(), abs=1e-6) and r.t == pytest.approx(t[r.road])


@pytest.mark.parametrize("first", [3, 16_384])
def test_last_point_near_a_segment(spark, monkeypatch, first):
    monkeypatch.setattr(spatial, "LAST_POINTS", first)
    rng = np.random.default_rng(7)
    a, p = rng.uniform(0, 300, (40, 2)), rng.uniform(0, 300, (60, 2))
    s = np.column_stack([a, a + rng.uniform(-40, 40, (40, 2))])
    lines = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(s)], "road long, ax double, ay double, ex double, ey double")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "point long, x double, y double")
    got = {r.road: (r.point, r.distance) for r in spatial.last_near_segments(points, lines, "point", "road", 15.0).collect()}
    far = np.array([_to_segments(s, x, y)[0] for x, y in p])
    want = {i: max(np.flatnonzero(far[:, i] <= 15.0)) for i in range(40) if (far[:, i] <= 15.0).any()}
    assert {k: v[0] for k, v in got.items()} == want and all(v[1] == pytest.approx(far[v[0], k]) for k, v in got.items())


@pytest.mark.parametrize("width", [1, 2, 16])
def test_paths_with_several_sites_a_row(spark, monkeypatch, width):
    """Distances and predecessors do not depend on how many sites share a row of the search; several nodes of a site, edges of no length, nodes out of reach."""
    monkeypatch.setattr(network, "SITES_A_ROW", width)
    rng = np.random.default_rng(8)
    rows = [(int(u), int(v), float(w)) for u, v, w in zip(rng.integers(0, 30, 90), rng.integers(0, 30, 90), rng.integers(0, 9, 90) / 2, strict=True)] + [(40, 41, 1.0)]
    start = [(0, 3), (1, 7), (1, 9), (4, 12), (9, 40)]
    edges, sources = spark.createDataFrame(rows, "u long, v long, w double"), spark.createDataFrame(start, "site long, node long")
    want = {}
    for site, node in start:
        want[site, node] = 0.0
    for _ in range(60):
        for u, v, w in rows:
            for site in (0, 1, 4, 9):
                if (site, u) in want and want[site, u] + w < want.get((site, v), np.inf):
                    want[site, v] = want[site, u] + w
    paths = network.shortest_paths(sources, edges)
    assert {(r.site, r.node): r.dist for r in paths.collect()} == want
    preds = {(r.site, r.node): r.pred for r in network.predecessors(paths, edges, sources).collect()}
    assert set(preds) == set(want) - set(start)
    for (site, node), pred in preds.items():
        tight = [u for u, v, w in rows if v == node and u != v and (site, u) in want and want[site, u] + w == want[site, node]]
        nearer = [u for u in tight if want[site, u] < want[site, node]]
        assert pred in tight and (not nearer or pred == min(nearer))


def test_shared_areas_of_any_shape(spark):
    """An L and a square with a hole share 7; tilted shapes against a fine grid of points; three layers."""
    edges = lambda rows, key: spatial.rings_to_edges(spark.createDataFrame(rows, f"{key} long, rings array<array<struct<x:double,y:double>>>"), key)
    ell, square = [ring((0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6))], [ring((1, 1), (5, 1), (5, 5), (1, 5)), ring((2, 2), (2, 4), (4, 4), (4, 2))]
    met = shapes.shared_area([(edges([(1, ell)], "a"), "a"), (edges([(2, square)], "b"), "b")], 2.0).collect()
    assert [(r.a, r.b) for r in met] == [(1, 2)] and met[0].area == pytest.approx(7.0)
    star, kite = [ring((0, 3), (2, 2), (3, 0), (4, 2), (6, 3), (4, 4), (3, 6), (2, 4))], [ring((1, 0), (5, 2), (6, 6), (0, 4))]
    a, b, c = edges([(1, star), (2, ell)], "a"), edges([(1, kite)], "b"), edges([(1, square), (9, [ring((50, 50), (51, 50), (51, 51))])], "c")
    g = (np.stack(np.meshgrid(np.arange(600), np.arange(600)), -1).reshape(-1, 2) + 0.5) / 100

    def inside(rings):
        odd = np.zeros(len(g), bool)
        for r in rings:
            xy = np.array([(p["x"], p["y"]) for p in r])
            for (x1, y1), (x2, y2) in zip(xy, np.roll(xy, -1, axis=0), strict=True):
                if y1 != y2:
                    odd ^= ((y1 > g[:, 1]) != (y2 > g[:, 1])) & (g[:, 0] < (x2 - x1) * (g[:, 1] - y1) / (y2 - y1) + x1)
        return odd

    two = {(r.a, r.b): r.area for r in shapes.shared_area([(a, "a"), (b, "b")], 2.5).collect()}
    assert two == pytest.approx({(i, 1): (inside(p) & inside(kite)).sum() / 1e4 for i, p in ((1, star), (2, ell))}, rel=0.01)
    three = {(r.a, r.b, r.c): r.area for r in shapes.shared_area([(a, "a"), (b, "b"), (c, "c")], 2.5).collect()}
    assert three == pytest.approx({(i, 1, 1): (inside(p) & inside(kite) & inside(square)).sum() / 1e4 for i, p in ((1, star), (2, ell))}, rel=0.02)
    points = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(g[::97])], "point long, x double, y double")
    for size in (0.7, 2.5, 100.0):
        found = {(r.point, r.a) for r in spatial.point_in_polygon(points, a, "point", "a", size).collect()}
        assert found == {(int(i), k) for k, p in ((1, star), (2, ell)) for i in np.flatnonzero(inside(p)[::97])}


def test_hulls(spark):
    rng = np.random.default_rng(5)
    points = [(1, float(x), float(y)) for x, y in rng.normal(size=(200, 2))] + [(2, 0.0, 0.0), (2, 1.0, 1.0)]
    corners = {k: [(r.x, r.y) for r in rows] for k in (1, 2) for rows in [sorted((r for r in spatial.convex_hull(spark.createDataFrame(points, "k long, x double, y double"), "k").collect() if r.k == k), key=lambda r: r.corner)]}
    xy = np.array([p[1:] for p in points if p[0] == 1])
    for p, q in zip(corners[1], corners[1][1:] + corners[1][:1], strict=True):
        assert ((q[0] - p[0]) * (xy[:, 1] - p[1]) - (q[1] - p[1]) * (xy[:, 0] - p[0]) > -1e-12).all()
    assert corners[2] == [(0.0, 0.0), (1.0, 1.0)]


def test_headings_and_places_over_many_ranges(spark):
    lines = spark.range(1000).withColumn("h", F.when(F.col("id") % 130 == 7, F.col("id"))).repartition(7)
    out = {r.id: r.s for r in tables.carried_forward(lines, "id", F.col("h"), "s").collect()}
    assert out == {i: (i - 7) // 130 * 130 + 7 if i >= 7 else None for i in range(1000)}
    assert all(r.id == r.place for r in tables.numbered(lines, ["id"], "place").collect())


def test_a_long_road(spark, monkeypatch):
    """Paths, routes and traffic over any number of steps."""
    monkeypatch.setattr(network, "ROUNDS", 12)
    e = spark.createDataFrame([(i, i + 1, 1) for i in range(100)], "u long, v long, w long")
    sources = spark.createDataFrame([(7, 0), (8, 50)], "site long, node long")
    paths = network.shortest_paths(sources, e)
    assert {(r.site, r.node, r.dist) for r in paths.collect()} == {(7, i, i) for i in range(101)} | {(8, i, i - 50) for i in range(50, 101)}
    preds = network.predecessors(paths, e, sources)
    ways = network.routes(spark.createDataFrame([(7, 100), (8, 3)], "site long, start long"), preds, paths).collect()
    assert {(r.site, r.start, r.step, r.node, r.elapsed) for r in ways} == {(7, 100, i, 100 - i, i) for i in range(101)}


def test_walks_double(spark, monkeypatch):
    """A way of 200 steps takes eight rounds, for traffic of several kinds and for routes; starts anywhere on it, and where nothing leads on."""
    rounds = []
    doubled = network._doubled
    monkeypatch.setattr(network, "_doubled", lambda preds: (rounds.append(n) or (n, j) for n, j in doubled(preds)))
    preds = spark.createDataFrame([(7, i, i - 1) for i in range(1, 201)] + [(8, i, 0) for i in range(1, 5)], "site long, node long, pred long")
    demand = spark.createDataFrame([("a", 7, 200, 1), ("b", 7, 90, 10), ("a", 7, 90, 100), ("a", 8, 3, 5), ("a", 8, 9, 6), (None, 7, 2, 3)], "k string, site long, node long, amount long")
    flows = {("a", i, i - 1): 1 + 100 * (i <= 90) for i in range(1, 201)} | {("b", i, i - 1): 10 for i in range(1, 91)} | {("a", 3, 0): 5} | {(None, i, i - 1): 3 for i in (1, 2)}
    assert {(r.k, r.u, r.v): r.amount for r in network.edge_traffic(demand, preds, ["k"]).collect()} == flows
    paths = preds.select("site", "node", F.col("node").cast("double").alias("dist")).unionByName(spark.createDataFrame([(7, 0, 0.0), (8, 0, 0.0)], "site long, node long, dist double"))
    ways = network.routes(spark.createDataFrame([(7, 200), (7, 0), (8, 4)], "site long, start long"), preds, paths).collect()
    told = {(7, 200, i, 200 - i, i) for i in range(201)} | {(7, 0, 0, 0, 0), (8, 4, 0, 4, 0), (8, 4, 1, 0, 4)}
    assert {tuple(r) for r in ways} == told and len(ways) == len(told)
    assert rounds == 2 * [1, 2, 4, 8, 16, 32, 64, 128]


def test_fractional_and_zero_weights(spark):
    """Against Dijkstra by hand: distances, ways that end, and the traffic of all nodes."""
    rng = np.random.default_rng(3)
    weights = [0.0, 0.0, 0.3, 0.7, 0.9, 1e-20, 2.5]
    rows = [(int(u), int(v), float(rng.choice(weights))) for u, v in rng.integers(0, 24, (70, 2))] + [(30, 31, 0.0), (31, 30, 0.0), (31, 32, 0.0), (32, 30, 0.0), (0, 30, 0.9)]
    rows += [(v, u, w) for u, v, w in rows]
    e = spark.createDataFrame(rows, "u long, v long, w double")
    sources = spark.createDataFrame([(1, 0), (2, 5), (3, 99)], "site long, node long")
    paths = network.shortest_paths(sources, e)
    dist, starts = {}, {1: 0, 2: 5, 3: 99}
    for site, start in starts.items():
        best = {start: 0.0}
        for _ in range(60):
            for u, v, w in rows:
                if u in best and best[u] + w < best.get(v, np.inf):
                    best[v] = best[u] + w
        dist |= {(site, n): d for n, d in best.items()}
    assert {(r.site, r.node): r.dist for r in paths.collect()} == dist
    preds = network.predecessors(paths, e, sources)
    before = {(r.site, r.node): r.pred for r in preds.collect()}
    assert set(before) == {k for k in dist if starts[k[0]] != k[1]}
    flows = collections.Counter()
    for site, node in dist:
        seen, at = set(), node
        while at != starts[site]:
            assert at not in seen and any((u, v) == (before[site, at], at) and dist[site, u] + w == dist[site, at] for u, v, w in rows)
            seen.add(at)
            flows[at, before[site, at]] += 1
            at = before[site, at]
    demand = paths.select("site", "node", F.lit(1).alias("amount"))
    assert {(r.u, r.v): r.amount for r in network.edge_traffic(demand, preds).collect()} == dict(flows)
    circle = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "site long, node long, pred long")
    with pytest.raises(ValueError, match="circle"):
        network.edge_traffic(spark.createDataFrame([(1, 1, 1)], "site long, node long, amount long"), circle)
    with pytest.raises(ValueError, match="circle"):
        network.routes(spark.createDataFrame([(1, 1)], "site long, start long"), circle, spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0)], "site long, node long, dist double"))


def test_pixels_of_an_edge_with_one_end_reached(spark):
    paths = spark.createDataFrame([(7, 0, 10.5), (7, 1, 3.25), (8, 1, 4.0)], "site long, node long, dist double")
    snaps = spark.createDataFrame([(1, 0, 1, 0.25, 8.0, 0.5), (2, 5, 1, 0.5, 3.0, 0.0), (3, 0, 6, 0.5, 3.0, 0.0), (4, 5, 6, 0.5, 3.0, 0.0)], "pixel long, start long, end long, part double, seconds double, access double")
    got = {tuple(r) for r in network.pixel_times(snaps, paths).select("pixel", "site", "time", "entry").collect()}
    assert got == {(1, 7, 9.75, 1), (1, 8, 10.5, 1), (2, 7, 4.75, 1), (2, 8, 5.5, 1), (3, 7, 12.0, 0)}


@pytest.mark.parametrize("width", [2, 16])
def test_ways_of_pixels_stand_in_one_row(spark, monkeypatch, width):
    """Ways by rows of the search are the times by paths, and so are the nearest of them; each moves a pixel, not a pixel and site, so its plan has no more than one shuffle for an end of an edge and one for groups."""
    monkeypatch.setattr(network, "SITES_A_ROW", width)
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(u), int(v), float(w)) for u, v, w in zip(rng.integers(0, 40, 60), rng.integers(0, 40, 60), rng.integers(0, 9, 60) / 2, strict=True)], "u long, v long, w double")
    sources = spark.createDataFrame([(1, 3), (2, 7), (5, 9), (6, 12), (9, 99)], "site long, node long")
    snaps = [(p, int(rng.integers(0, 45)), int(rng.integers(0, 45)), float(rng.integers(0, 5)) / 4, 3.0, float(p % 3)) for p in range(60)]
    snaps = spark.createDataFrame(snaps, "pixel long, start long, end long, part double, seconds double, access double")
    reached = network.search(sources, edges)
    ways, times = network.pixel_ways(snaps, reached), network.pixel_times(snaps, network.paths_of(reached)).select("pixel", "site", "time", "entry")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(network.times_of(ways)) == rows(times) and times.count() > 60
    scenarios = spark.createDataFrame([("all", None), ("some", 2), ("some", 5), ("none", 1), ("none", 2), ("none", 5), ("none", 6), ("none", 9)], "scenario string, closed long")
    assert rows(network.nearest_open_of(ways, scenarios)) == rows(network.nearest_open(times, scenarios))
    assert rows(network.closure_of(ways, [1, 6])) == rows(network.closure(times, [1, 6]))
    own = snaps.selectExpr("pixel", "pixel % 7 AS site")
    assert rows(network.times_to(ways, own)) == rows(times.join(own, ["pixel", "site"]).select("pixel", "site", "time", "entry"))
    near = network.closure_of(ways, [1, 6])
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 1 + (width == 2)


def test_zone_sites_and_walk_zones(spark):
    scenarios = spark.createDataFrame([("all", None), ("one", 1)], "scenario string, closed long")
    times = spark.createDataFrame([(p, s, float(10 * s + p), 0) for p in (1, 2, 3) for s in (1, 2)], "pixel long, site long, time double, entry long")
    near = network.nearest_open(times, scenarios)
    zones = spark.createDataFrame([(1, 2), (2, 1), (3, 9)], "pixel long, site long")
    told = network.zone_sites(times, near, zones, scenarios)
    assert {(r.scenario, r.pixel): r.site for r in told.collect()} == {("all", 1): 2, ("all", 2): 1, ("all", 3): 1, ("one", 1): 2, ("one", 2): 2, ("one", 3): 2}
    walks = spark.createDataFrame([(2, 1), (3, 2)], "pixel long, walk_site long")
    kept = network.outside_walk_zones(told, walks, scenarios)
    assert {(r.scenario, r.pixel) for r in kept.collect()} == {("all", 1), ("one", 1), ("one", 2)}


# Values as published with the analysis that the operators redo: places, counts and scores.
SITES = [("Carrboro", 35.9149, -79.0786), ("Ephesus", 35.9335, -79.0162), ("Estes Hills", 35.9359, -79.0436), ("Graham", 35.8997, -79.0725), ("Glenwood", 35.9063, -79.0266), ("McDougle", 35.9297, -79.099011), ("Rashkis", 35.9144, -79.0081)]
NEAREST = [(35.9298113, -79.0988182, "McDougle", 0.013), (35.9336581, -79.0160393, "Ephesus", 0.014), (35.9359769, -79.0438998, "Estes Hills", 0.018), (35.9140577, -79.0084062, "Rashkis", 0.029), (35.8999118, -79.0718339, "Graham", 0.04), (35.9065569, -79.0259135, "Glenwood", 0.042), (35.915768, -79.0778025, "Carrboro", 0.075)]


def test_golden_distances(spark):
    f = spark.createDataFrame([(i, lat, lon) for i, (lat, lon, _, _) in enumerate(NEAREST)], "facility long, lat double, lon double")
    s = spark.createDataFrame(SITES, "site string, site_lat double, site_lon double")
    out = sorted((r.facility, r.site, round(r.distance, 3)) for r in proximity.nearest_site(f, s).collect())
    assert out == [(i, name, d) for i, (_, _, name, d) in enumerate(NEAREST)]


def test_golden_exposure(spark):
    rows = [(6.1955, 0.7601, 3.5585), (0.7059, 0.8208, 0.3815), (2.3347, 0.8172, 1.2663), (11.3271, 0.7553, 6.5363), (1.8908, 0.8533, 0.9873), (8.2331, 0.7295, 4.8695)]
    out = spark.createDataFrame(rows, "raw double, canopy double, net double").select(exposure.mitigated(F.col("raw"), F.col("canopy")).alias("got"), "net").collect()
    assert all(r.got == pytest.approx(r.net, abs=6e-4) for r in out)
    land = spark.createDataFrame([(1, 10), (1, 50), (1, 80), (1, 0), (2, 10), (3, 50)], "site long, class int")
    assert {r.site: r.uhi for r in exposure.heat_score(land).collect()} == pytest.approx({1: (-0.1 / 3 + 0.6) / 1.6 * 100, 2: 0.0, 3: 100.0})


def test_golden_changes(spark):
    wide = {"a": (462, 444, 430, 413, 409, 398, 395, 395, 392, 390, 388), "b": (343, 375, 387, 394, 405, 417, 421, 420, 422, 422, 423)}
    told = {"a": (0.0, -3.9, -6.9, -10.6, -11.5, -13.9, -14.5, -14.5, -15.2, -15.6, -16.0), "b": (0.0, 9.3, 12.8, 14.9, 18.1, 21.6, 22.7, 22.4, 23.0, 23.0, 23.3)}
    rows = spark.createDataFrame([(k, i, v) for k, vs in wide.items() for i, v in enumerate(vs)], "k string, year int, v long")
    out = {(r.k, r.year): r.pct_change for r in tables.change_from_first(rows, "k", "year", "v").collect()}
    assert out == {(k, i): v for k, vs in told.items() for i, v in enumerate(vs)}


def test_golden_fit(spark):
    actual = (462, 343, 324, 499, 394, 469, 371, 335, 367, 366, 364)
    by_mae = (461.99999960730423, 381.73878841746034, 248.87238750743325, 499.00000143064483, 393.9999970535365, 471.2414763205271, 342.8030616973305, 502.5313983822755, 312.2329092103184, 315.579981179628, 363.9999991935414)
    by_rmse = (470.71797640132036, 399.1226024580587, 264.47407733109344, 508.5769508231935, 400.96319768723964, 493.6800938305596, 325.9142691402585, 446.5666394883605, 291.4875211298995, 320.27258654842296, 372.22408516159305)
    naive = (351.9528106589633, 434.72746982569237, 306.735843507912, 0.0, 37.214027451566956, 602.2561744019689, 548.8129322170845, 940.3957965338257, 441.95998842500046, 398.054119837425, 231.89083714056113)
    for predicted, mae, rmse in ((by_mae, 37.9112, None), (by_rmse, None, 52.1004), (naive, 202.7648, None)):
        got = choice.fit(spark.createDataFrame(list(zip(map(float, actual), predicted, strict=True)), "a double, p double"), "p", "a").first()
        assert mae is None or round(got.mae, 4) == mae
        assert rmse is None or round(got.rmse, 4) == rmse


def test_travel_seconds(spark):
    rows = spark.createDataFrame([(100.0, "motorway", "traffic_signals"), (100.0, "primary_link", None), (100.0, "unknown", "stop")], "m double, c string, t string")
    out = rows.select(*[exposure.travel_seconds(m, F.col("m"), F.col("c"), F.col("t")).alias(m) for m in ("walk", "bike", "drive")]).collect()
    assert [r.walk for r in out] == pytest.approx([100 / 1.12] * 3) and [r.bike for r in out] == pytest.approx([100 / 5.36] * 3)
    assert [r.drive for r in out] == pytest.approx([100 / (59 * 0.44704) + 22, 100 / (28 * 0.44704), 100 / (20 * 0.44704) + 11])


def test_softmax_keeps_the_total(spark):
    c = spark.createDataFrame([(1, "x", 1000.0, 10.0), (1, "y", 999.0, 10.0)], "zone long, dest string, u double, kids double")
    flows = [r.flow for r in choice.softmax_flows(c, ["zone"], "u", "kids").collect()]
    assert sum(flows) == pytest.approx(10.0) and max(flows) == pytest.approx(10 / (1 + math.exp(-1)))


def test_calibration_finds_a_minimum():
    best, score = choice.calibrate(lambda p: float(((p - 1.5) ** 2).sum()), np.zeros(2), np.ones(2) * 4)
    assert best == pytest.approx([1.5, 1.5], abs=1e-3) and score < 1e-5
    h, cond = choice.curvature(lambda p: float((p**2).sum()), np.zeros(2))
    assert h == pytest.approx(np.eye(2) * 2, abs=1e-6) and cond == pytest.approx(1)


def test_mitigation_has_a_ceiling(spark):
    row = spark.range(1).select(exposure.mitigated(F.lit(10.0), F.lit(0.5)).alias("a"), exposure.mitigated(F.lit(10.0), F.lit(9.0)).alias("b")).first()
    assert tuple(row) == (pytest.approx(7.2), pytest.approx(2.0))


def test_records_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,zip,capacity,geocoded\nOne,00123,5,True\nTwo,,x,false\n,1,2,true\n')
    rows = readers.records(spark, str(tmp_path / "a.csv"), "name string, zip string, capacity int, geocoded boolean", ["name"]).collect()
    assert [tuple(r) for r in rows] == [("One", "00123", 5, True), ("Two", None, None, False)]
    (tmp_path / "p.json").write_text('{"features": [{"id": 1, "n": "a"}, {"id": 2, "n": "b"}]}')
    assert readers.pages(spark, str(tmp_path / "p.json"), "features", "struct<id:int,n:string>").count() == 2
    (tmp_path / "c.json").write_text('[["B01", "state"], ["12", "37"], ["-666666666", "37"]]')
    assert [r.row["B01"] for r in readers.census(spark, str(tmp_path / "c.json")).collect()] == ["12", "-666666666"]
    (tmp_path / "h.html").write_text('<script>\nconst DATA = {"a": [1, 2]};\n</script>\n')
    assert readers.embedded_json(spark, str(tmp_path / "h.html"), "DATA", "struct<a:array<int>>").first().value.a == [1, 2]
    cells = spark.createDataFrame([(1, i, float(i)) for i in range(3)], "k long, i long, v double")
    assert sinks.packed(cells, ["k"], "i", "v", "i2").first().data == "AAABAAIA"
    p = polygons(spark, [(1, [ring((0, 0), (1, 0), (1, 1))])])
    assert '"coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]' in sinks.geojson(p, "rings", ["zone"]).first().feature
    first, missing = readers.known_names(spark.createDataFrame([("A", 2), ("A", 1), ("Z", 3)], "n string, o long"), {"A": "alpha", "B": "beta"}, "n", "o")
    assert [(r.canonical, r.o) for r in first.collect()] == [("alpha", 1)] and [r.canonical for r in missing.collect()] == ["beta"]


def test_rows_by_place_skip_row_groups(spark, tmp_path):
    """The same rows as from any table, from few of the row groups, nulls and other columns kept."""
    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 1000, (20_000, 2))
    rows = [(i, float(x), float(y), float(x) + 2, float(y) + 1, "code") for i, (x, y) in enumerate(xy)] + [(-1, None, 1.0, 2.0, 3.0, None)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double, code string").repartition(4)
    sinks.by_place(df, str(tmp_path / "placed"), group_bytes=32 << 10)
    box = (400.0, 600.0, 440.0, 630.0)
    found = {r.id for r in readers.in_box(spark, str(tmp_path / "placed"), box).collect()}
    assert found == {i for i, x, y, x2, y2, _ in rows if x is not None and x <= box[2] and x2 >= box[0] and y <= box[3] and y2 >= box[1]} and found
    whole = spark.read.parquet(str(tmp_path / "placed"))
    assert whole.columns == df.columns and whole.count() == len(rows) and whole.where("x1 IS NULL").count() == 1
    met = total = 0
    for file in (tmp_path / "placed").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            told = {c.path_in_schema: c.statistics for c in (meta.row_group(g).column(k) for k in range(meta.num_columns))}
            total += 1
            met += told["x1"].min <= box[2] and told["x2"].max >= box[0] and told["y1"].min <= box[3] and told["y2"].max >= box[1]
    assert total >= 20 and met <= total / 5
    sinks.by_place(df.limit(0), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_cascade_and_bidirectional(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    a, b = spark.createDataFrame([(1, 1.0)], "k long, lat double"), spark.createDataFrame([(1, 9.0), (2, 2.0)], "k long, lat double")
    assert {tuple(r) for r in tables.cascade(rows, "k", [a, b], ["lat"]).collect()} == {(1, 1.0, 0), (2, 2.0, 1), (3, None, None)}
    e = spark.createDataFrame([(1, 2, 5), (2, 1, 7), (2, 3, 4)], "u long, v long, w long")
    assert {tuple(r) for r in tables.bidirectional(e).collect()} == {(1, 2, 5), (2, 1, 7), (2, 3, 4), (3, 2, 4)}


def test_canonical_names_of_several_rows(spark):
    """All rows of known names stay, under what they mean; unknown and missing names go."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "z"), (5, None)], "k long, name string")
    got = readers.canonical(rows, {"a": "North", "b": "North", "c": "South"}, "name").collect()
    assert sorted((r.k, r.canonical) for r in got) == [(1, "North"), (2, "North"), (3, "North")]


def test_first_path_that_is_there(spark, tmp_path):
    """Records from a newer place before an older one, an empty table where there is neither; other errors are not hidden."""
    schema = "name string, lat double, lon double, geocoded boolean"
    new, old = str(tmp_path / "new.csv"), str(tmp_path / "old.csv")
    assert readers.geocoded(spark, [new, old], schema).collect() == []
    (tmp_path / "old.csv").write_text("name,lat,lon,geocoded\nOne,35.9,-79.0,True\nTwo,,,\nThree,x,1,no\n")
    told = [tuple(r) for r in readers.geocoded(spark, [new, old], schema).collect()]
    assert told == [("One", 35.9, -79.0, True), ("Two", None, None, False), ("Three", None, 1.0, False)]
    (tmp_path / "new.csv").write_text("name,lat,lon,geocoded\nFour,1,2,true\n")
    assert [r.name for r in readers.geocoded(spark, [new, old], schema).collect()] == ["Four"]
    with pytest.raises(ZeroDivisionError):
        readers.either([new], lambda path: 1 / 0)


def test_network_of_parquet(spark, tmp_path):
    """The first of several classes of an edge, a missing list, and classes that are plain text."""
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "node long, x double, y double")
    nodes.write.parquet(str(tmp_path / "nodes"))
    edges = spark.createDataFrame([(1, 2, ["primary", "service"]), (2, 1, None), (2, 2, [])], "u long, v long, highway array<string>")
    for name, df in (("lists", edges), ("plain", edges.withColumn("highway", F.get("highway", F.lit(0))))):
        df.write.parquet(str(tmp_path / name))
        n, e = readers.network(spark, str(tmp_path / "nodes"), str(tmp_path / name))
        assert n.count() == 2 and sorted(map(tuple, e.collect())) == [(1, 2, "primary"), (2, 1, None), (2, 2, None)]


@pytest.mark.parametrize("kind", ["f4", "i2", "u4"])
def test_packed_grids_come_back(spark, kind):
    values = [1.0, None, 3.5, 250.0] if kind == "f4" else [1.0, 0.0, 4.0, 250.0]
    cells = spark.createDataFrame([(k, i, v) for k in ("a", "b") for i, v in enumerate(values)], "k string, i long, v double")
    grids = sinks.packed(cells, ["k"], "i", "v", kind)
    back = readers.unpacked(grids.unionByName(spark.createDataFrame([("none", None)], "k string, data string")), ["k"], kind)
    assert sorted(map(tuple, back.collect())) == [(k, i, v) for k in ("a", "b") for i, v in enumerate(values)]
    assert readers.unpacked(grids.limit(0), ["k"], kind).count() == 0


def test_places_within_keys(spark):
    """Places of one key that fills many tasks, of small ones and of the key that is null."""
    rows = [(k, i * 7919 % 1009, i) for i, k in enumerate([1] * 700 + [2] * 3 + [None] * 5)]
    got = tables.placed_within(spark.createDataFrame(rows, "k long, v long, i long"), ["k"], ["v", "i"], "place").collect()
    assert got[0].__fields__ == ["k", "v", "i", "place"]
    expected = {i: n + 1 for key in (1, 2, None) for n, (_, i) in enumerate(sorted((v, i) for k, v, i in rows if k == key))}
    assert {r.i: r.place for r in got} == expected
    assert tables.placed_within(spark.createDataFrame([], "k long, v long"), ["k"], ["v"], "place").count() == 0


def test_inputs_that_do_not_belong_together(spark):
    zones, schools = {"a zone": "A", "b zone": "B", "b old": "B"}, {"a": "A", "b": "B", "c": "C"}
    fragments = [("a zone", 0.5), ("b zone", 0.25), ("b old", 0.5), ("b old", 1e-7), ("elsewhere", 1.0), (None, 1.0), ("a zone", None)]
    counts = [("a", "1", "10"), ("b", "2", "20"), ("c", "3", "30"), ("all", "6", "60")]

    def run(fragments=fragments, counts=counts, schools=schools, total=60, known="ABC", homes="AB"):
        f = spark.createDataFrame(fragments, "zone string, weight double")
        c = spark.createDataFrame(counts, "name string, y1 string, `2025-26` string")
        return inputs.enrolment_inputs(f, zones, c, schools, "2025-26", "all", known, homes, total)

    kept, students = run()
    assert sorted((r.zone, r.school, r.weight) for r in kept.collect()) == [("a zone", "A", 0.5), ("b old", "B", 0.5), ("b zone", "B", 0.25)]
    assert sorted(map(tuple, students.collect())) == [("A", 10), ("B", 20), ("C", 30)]
    for text, wrong in (
        ("canonical", {"schools": {"a": "A", "b": "B"}}), ("canonical", {"counts": [*counts, (None, "1", "1")]}), ("without students", {"counts": [*counts[:2], ("c", "3", "many")]}),
        ("twice", {"counts": [*counts, ("a", "1", "10")]}), ("schools: unknown", {"known": "ABCD"}), ("schools: unknown", {"known": "AB"}),
        ("homes", {"homes": "A"}), ("homes", {"fragments": fragments[:1]}), ("add up to 60", {"total": 61}),
    ):
        with pytest.raises(ValueError, match=text):
            run(**wrong)
