"""Queries on rasters over the whole county: land cover reprojected, exposure and heat over a grid from the roads' extent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projection
from ..operators import exposure as E
from ..operators import raster
from .exposure import HEAT, WEIGHTED, land, land_sql, weighted
from .proximity import _SERIES
from .registry import query

ZONE = 17
#: West, south, east and north of the land cover, its rows and columns; the sides of reprojected and of grid cells in metres.
BOUNDS, SHAPE, SIZE, RESOLUTION = (-79.25, 35.85, -78.9, 36.1), (250, 350), 100.0, 500.0

_PARTS = """n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 AS a2, 61 * n ** 3 / 240 - 103 * n ** 4 / 140 AS a3, 49561 * n ** 4 / 161280 AS a4,
n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360 AS b1, n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440 AS b2, 17 * n ** 3 / 480 - 37 * n ** 4 / 840 AS b3, 4397 * n ** 4 / 161280 AS b4"""
CONSTANTS = f"series AS (SELECT *, {_PARTS} FROM (SELECT {_SERIES}))"


def _projected(name: str, source: str) -> str:
    """WITH clauses that give rows with lat and lon their easting and northing."""
    return f"""{name}_t AS (SELECT s.*, n, r, a1, a2, a3, a4, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t, radians(lon + 81) AS w FROM {source} s, series),
{name}_x AS (SELECT *, atan2(t, cos(w)) AS xi, atanh(sin(w) / sqrt(t * t + 1)) AS eta FROM {name}_t),
{name} AS (SELECT *, 500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)) AS px,
r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)) AS py FROM {name}_x)"""


# Every whole cell of the range is asked; what has no source goes. Latitudes come from the conformal ones in eight steps.
_LATITUDE = "asin(tanh(iso + e * atanh(e * sin({}))))"
_STEPS = ", ".join(f"s{i} AS (SELECT * REPLACE ({_LATITUDE.format('phi')} AS phi) FROM s{i - 1})" for i in range(1, 9))
COVER = f"""source AS ({land_sql(*SHAPE)}),
asked AS (SELECT k AS row, m AS col, (k + 0.5e0) * 100 / r AS xi, ((m + 0.5e0) * 100 - 500000) / r AS eta, series.* FROM range(39600, 40060) a(k), range(6520, 6960) b(m), series),
conformal AS (SELECT row, col, e, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) - b4 * sin(8 * xi) * cosh(8 * eta) AS u,
eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) - b4 * cos(8 * xi) * sinh(8 * eta) AS v FROM asked),
s0 AS (SELECT row, col, e, u, v, atanh(sin(u) / cosh(v)) AS iso, asin(sin(u) / cosh(v)) AS phi FROM conformal), {_STEPS},
cover AS (SELECT p.row, p.col, class FROM (SELECT row, col, CAST(floor((degrees(phi) - 35.85e0) / 0.001e0) AS BIGINT) AS sr, CAST(floor((degrees(atan2(sinh(v), cos(u))) - 81 + 79.25e0) / 0.001e0) AS BIGINT) AS sc FROM s8) p
JOIN source ON sr = source.row AND sc = source.col)"""


def cover(spark, sf_dir):
    """Land cover in a UTM zone, from cells in degrees."""
    return raster.reprojected(land(spark, sf_dir, *SHAPE), BOUNDS, SHAPE, ZONE, SIZE)


@query("cover_reprojected", f"WITH {CONSTANTS}, {COVER} SELECT row, col, class FROM cover")
def cover_reprojected(spark, sf_dir):
    return cover(spark, sf_dir).select("row", "col", "class")


def _degrees(x: str, y: str) -> str:
    return f"-79.25e0 + {x} / 10007e0 * 0.35e0 AS lon, 35.85e0 + {y} / 10009e0 * 0.25e0 AS lat"


GRID = WEIGHTED + f""", {CONSTANTS}, ends AS (SELECT road, 'a' AS side, {_degrees('ax', 'ay')} FROM road UNION ALL SELECT road, 'e', {_degrees('ex', 'ey')} FROM road),
{_projected('end_at', 'ends')},
box AS (SELECT min(lon) - 0.01e0 AS west, min(lat) - 0.01e0 AS south, max(lon) + 0.01e0 AS east, max(lat) + 0.01e0 AS north FROM ends),
corner AS (SELECT 'sw' AS c, west AS lon, south AS lat FROM box UNION ALL SELECT 'ne', east, north FROM box), {_projected('corner_at', 'corner')},
steps AS (SELECT CAST(round((max(px) - min(px)) / 500) AS BIGINT) AS nx, CAST(round((max(py) - min(py)) / 500) AS BIGINT) AS ny FROM corner_at),
lattice AS (SELECT row, col, west + (col + 0.5e0) * ((east - west) / nx) AS lon, north - (row + 0.5e0) * ((north - south) / ny) AS lat FROM (SELECT *, unnest(range(ny)) AS row FROM (SELECT *, unnest(range(nx)) AS col FROM steps, box))), {_projected('cell_at', 'lattice')},
grid AS (SELECT row, col, px, py FROM cell_at)
"""
SQUARE = f""", {COVER}, asked_cells AS (SELECT row, col, unnest(range(CAST(floor((py - 500) / 100) AS BIGINT), CAST(floor((py + 500) / 100) AS BIGINT) + 1)) AS r, px FROM grid),
square AS (SELECT row, col, r, unnest(range(CAST(floor((px - 500) / 100) AS BIGINT), CAST(floor((px + 500) / 100) AS BIGINT) + 1)) AS c FROM asked_cells),
counted AS (SELECT square.row, square.col, count_if(class > 0) AS valid, count_if(class = 10) AS trees, CAST(sum(CASE WHEN class > 0 THEN CAST(round(100 * ({HEAT})) AS BIGINT) END) AS DOUBLE) AS heat FROM square JOIN cover ON cover.row = r AND cover.col = c GROUP BY ALL)
"""
RAW = """, segment AS (SELECT road, weight, max(px) FILTER (side = 'a') AS x1, max(py) FILTER (side = 'a') AS y1, max(px) FILTER (side = 'e') AS x2, max(py) FILTER (side = 'e') AS y2 FROM end_at JOIN weighted USING (road) WHERE weight IS NOT NULL GROUP BY ALL),
cut AS (SELECT *, greatest(CAST(floor(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 50e0) AS BIGINT), 1) AS k FROM segment WHERE (x1, y1) != (x2, y2)),
piece AS (SELECT weight, x1 + (i + 0.5e0) / k * (x2 - x1) AS x, y1 + (i + 0.5e0) / k * (y2 - y1) AS y FROM (SELECT *, unnest(range(k)) AS i FROM cut)),
near AS (SELECT *, CAST(floor(x / 1000) AS BIGINT) + dx AS kx, CAST(floor(y / 1000) AS BIGINT) + dy AS ky FROM piece, range(-1, 2) a(dx), range(-1, 2) b(dy)),
raw AS (SELECT row, col, sum(weight * exp(-0.003e0 * sqrt((x - px) ** 2 + (y - py) ** 2))) AS raw FROM grid JOIN near ON kx = CAST(floor(px / 1000) AS BIGINT) AND ky = CAST(floor(py / 1000) AS BIGINT) WHERE sqrt((x - px) ** 2 + (y - py) ** 2) <= 1000 GROUP BY ALL)
"""


def _roads(spark, sf_dir):
    """Roads with their ends in degrees."""
    ends = {f"{p}lon": F.col(f"{p}x") / 10007.0 * 0.35 - 79.25 for p in "ae"} | {f"{p}lat": F.col(f"{p}y") / 10009.0 * 0.25 + 35.85 for p in "ae"}
    return weighted(spark, sf_dir).withColumns(ends).drop("ax", "ay", "ex", "ey")


def _points(roads):
    """Pieces of the weighted roads, in metres of the zone."""
    roads = roads.where("weight IS NOT NULL")
    for p in "ae":
        roads = projection.with_utm(roads, f"{p}lat", f"{p}lon", ZONE, f"{p}x", f"{p}y")
    return E.discretized(roads, 50.0)


def _grid(roads):
    """The grid over all roads and a hundredth of a degree around them."""
    low, high = (lambda c: F.least(F.min(f"a{c}"), F.min(f"e{c}"))), (lambda c: F.greatest(F.max(f"a{c}"), F.max(f"e{c}")))
    west, south, east, north = roads.agg(low("lon"), low("lat"), high("lon"), high("lat")).first()
    return raster.extent_grid(roads.sparkSession, (west - 0.01, south - 0.01, east + 0.01, north + 0.01), ZONE, RESOLUTION)


@query("county_exposure", GRID + SQUARE + RAW + """SELECT row, col, round(coalesce(raw, 0), 6) AS raw, round(coalesce(raw * (1 - least(0.56e0 * coalesce(trees / CAST(nullif(valid, 0) AS DOUBLE), 0), 0.8e0)), 0), 6) AS net
FROM grid LEFT JOIN raw USING (row, col) LEFT JOIN counted USING (row, col)""")
def county_exposure(spark, sf_dir):
    """Exposure to roads over a grid from their extent, and net of the canopy around each cell."""
    roads = _roads(spark, sf_dir)
    out = E.exposure_grid(_grid(roads), _points(roads), E.land_sums(cover(spark, sf_dir)), SIZE, RESOLUTION)
    return out.select("row", "col", F.round("raw", 6).alias("raw"), F.round("net", 6).alias("net"))


@query("county_heat", GRID + SQUARE + "SELECT row, col, CASE WHEN valid > 0 THEN round(greatest(0, least(100, (heat / valid / 100 + 0.6e0) / 1.6e0 * 100)), 9) ELSE 0 END AS uhi FROM grid LEFT JOIN counted USING (row, col)")
def county_heat(spark, sf_dir):
    """The heat score over the same grid."""
    out = E.heat_grid(_grid(_roads(spark, sf_dir)), E.land_sums(cover(spark, sf_dir)), SIZE, RESOLUTION)
    return out.select("row", "col", F.round("uhi", 9).alias("uhi"))
