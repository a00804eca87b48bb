"""Rasters: sums over windows against plain sums, reprojection and grids against the projection itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeworks.functions import projection
from placeworks.operators import exposure, raster

KINDS = "row long, col long, class int"


def cells_of(spark, grid, top=0, left=0):
    return spark.createDataFrame([(int(r + top), int(c + left), int(v)) for (r, c), v in np.ndenumerate(grid) if v >= 0], KINDS)


@pytest.mark.parametrize("top, left", [(0, 0), (-7, 1000)])
def test_window_sums_are_plain_sums(spark, top, left):
    """Windows of one cell to more than the raster, beside it and across tiles without any cell, over negative indices too."""
    rng = np.random.default_rng(5)
    grid = np.where(rng.random((41, 37)) < 0.7, rng.integers(0, 90, (41, 37)), -1)
    grid[8:20, 8:24] = -1  # whole tiles are empty
    sums = raster.running_sums(cells_of(spark, grid, top, left), {"n": F.lit(1), "v": F.col("class")}, tile=4)
    spans = []
    for k in range(300):
        r1, c1 = rng.integers(-10, 48, 2)
        h, w = rng.integers(0, 60, 2) if k % 2 else rng.integers(0, 3, 2)
        spans.append((k, int(r1 + top), int(r1 + h + top), int(c1 + left), int(c1 + w + left)))
    spans += [(300, top, top - 1, left, left + 5), (301, None, 3, left, left)]
    got = {r.k: (r.n, r.v) for r in raster.window_sums(spark.createDataFrame(spans, "k long, r1 long, r2 long, c1 long, c2 long"), "k", sums).collect()}
    for k, r1, r2, c1, c2 in spans[:300]:
        part = grid[max(r1 - top, 0) : max(r2 - top + 1, 0), max(c1 - left, 0) : max(c2 - left + 1, 0)]
        assert got[k] == ((part >= 0).sum(), part[part >= 0].sum())
    assert got[300] == got[301] == (0, 0) and len(got) == 302


def test_sums_of_nothing_nulls_and_repeats(spark):
    ask = spark.createDataFrame([(1, 0, 9, 0, 9)], "k long, r1 long, r2 long, c1 long, c2 long")
    empty = raster.running_sums(spark.createDataFrame([], KINDS), {"v": F.col("class")})
    assert [tuple(r) for r in raster.window_sums(ask, "k", empty).collect()] == [(1, 0)]
    odd = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (2, 2, None), (None, 1, 7), (1, None, 7)], KINDS)
    assert [tuple(r) for r in raster.window_sums(ask, "k", raster.running_sums(odd, {"v": F.col("class")})).collect()] == [(1, 10)]


def test_land_sums_are_those_of_windows(spark):
    """Canopy and heat by running sums are those of the cells of the windows, one by one."""
    rng = np.random.default_rng(2)
    land = cells_of(spark, rng.choice([0, 10, 20, 30, 40, 50, 60, 80, 90, 95], (50, 50)))
    grid = spark.range(40).select(F.col("id").alias("cell"), (F.col("id") * 37 % 500 + 0.5).alias("x"), (F.col("id") * 59 % 500 + 0.5).alias("y"))
    heat = {r.cell: r.uhi for r in exposure.heat_grid(grid, exposure.land_sums(land), 10.0, 40.0).collect()}
    sites = grid.select(F.col("cell").alias("site"), F.floor(F.col("y") / 10).alias("row0"), F.floor(F.col("x") / 10).alias("col0"))
    window = exposure.heat_score(exposure.window_cells(sites, land, 4)).collect()
    assert len(window) == 40 and all(heat[r.site] == pytest.approx(r.uhi, abs=1e-9) for r in window)
    points = spark.createDataFrame([(250.0, 250.0, 1.0)], "x double, y double, weight double")
    shade = {r.site: r.canopy for r in exposure.canopy_fraction(exposure.window_cells(sites, land, 4)).collect()}
    for r in exposure.exposure_grid(grid, points, exposure.land_sums(land), 10.0, 40.0, 150).collect():
        d = np.hypot(r.x - 250, r.y - 250)
        raw = np.exp(-0.003 * d) if d <= 150 else 0.0
        assert r.raw == pytest.approx(raw) and r.net == pytest.approx(raw * (1 - min(0.56 * shade[r.cell], 0.8)))


def test_reprojection_takes_the_source_at_each_centre(spark):
    bounds, shape = (-79.02, 35.9, -78.98, 35.93), (30, 40)
    source = spark.range(30 * 40).select(F.expr("id div 40").alias("row"), (F.col("id") % 40).alias("col"), F.col("id").alias("v")).where("v % 7 != 0")
    got = raster.reprojected(source, bounds, shape, 17, 50.0).collect()
    places = spark.createDataFrame([((r.col + 0.5) * 50, (r.row + 0.5) * 50, r.v) for r in got], "e double, n double, v long")
    lat, lon = projection.from_utm(F.col("e"), F.col("n"), 17)
    for r in places.select(lat.alias("lat"), lon.alias("lon"), "v").collect():
        assert r.v == int((r.lat - 35.9) / 0.001) * 40 + int((r.lon + 79.02) / 0.001) and r.v % 7
    # About 3,610 by 3,330 metres in cells of 50, six sevenths of them known, none twice.
    assert len({(r.row, r.col) for r in got}) == len(got) == pytest.approx(72.2 * 66.6 * 6 / 7, rel=0.02)


def test_extent_grid(spark):
    got = raster.extent_grid(spark, (-79.02, 35.9, -78.98, 35.93), 17, 500.0).orderBy("cell").collect()
    rows, cols = max(r.row for r in got) + 1, max(r.col for r in got) + 1
    assert (rows, cols) == (7, 7) and [(r.row, r.col) for r in got] == [(i // 7, i % 7) for i in range(49)]
    assert got[0].lat == pytest.approx(35.93 - 0.03 / 14) and got[0].lon == pytest.approx(-79.02 + 0.04 / 14) and got[0].lat > got[-1].lat
