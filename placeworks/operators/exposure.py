"""Distance-decay exposure and raster statistics around sites and over grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import raster, spatial

# Weights of road classes and of kinds of service roads, free-flow speeds of classes in miles an hour,
# seconds that a driver loses at the control of the node that an edge leads to, weights of land cover and their range.
ROAD_WEIGHTS = {
    "motorway": 1.0, "motorway_link": 0.8, "trunk": 0.6, "trunk_link": 0.48, "primary": 0.3, "primary_link": 0.24, "secondary": 0.15, "secondary_link": 0.12,
    "tertiary": 0.06, "tertiary_link": 0.048, "unclassified": 0.02, "residential": 0.01, "service": 0.005, "living_street": 0.005,
}
SERVICE_WEIGHTS = {"driveway": 0.002, "alley": 0.003, "drive-through": 0.001}
SPEEDS_MPH = {
    "motorway": 59.0, "motorway_link": 49.0, "trunk": 43.0, "trunk_link": 37.0, "primary": 34.0, "primary_link": 28.0, "secondary": 28.0, "secondary_link": 24.0,
    "tertiary": 24.0, "tertiary_link": 20.0, "unclassified": 20.0, "residential": 20.0, "service": 11.0, "living_street": 11.0,
}
CONTROL_SECONDS = {"traffic_signals": 22.0, "stop": 11.0, "give_way": 6.0, "crossing": 3.0, "turning_circle": 4.0, "motorway_junction": 0.0}
MPS_OF_MPH, WALK_MPS, BIKE_MPS, DEFAULT_MPH = 0.44704, 1.12, 5.36, 20.0
LAND_WEIGHTS = {10: -0.6, 20: -0.3, 30: -0.1, 40: -0.05, 50: 1.0, 60: 0.4, 80: -0.5, 90: -0.4, 95: -0.4}
COOLEST, HOTTEST = -0.6, 1.0
DECAY = 0.003
CANOPY_SHARE, CANOPY_MOST = 0.56, 0.80


def _mapped(column: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[column]


def road_weight(kind: Column, service: Column) -> Column:
    """The weight of a road class, of its service subtype where it is one; null for other classes."""
    return F.when(kind == "service", F.coalesce(_mapped(service, SERVICE_WEIGHTS), F.lit(ROAD_WEIGHTS["service"]))).otherwise(_mapped(kind, ROAD_WEIGHTS))


def travel_seconds(mode: str, meters: Column, kind: Column, control: Column) -> Column:
    """Seconds over an edge; 9999 where there is no speed. Drivers alone wait at the control of the node that it leads to, if it has one."""
    if mode != "drive":
        return meters / F.lit(WALK_MPS if mode == "walk" else BIKE_MPS)
    speed = F.coalesce(_mapped(kind, SPEEDS_MPH), F.lit(DEFAULT_MPH)) * MPS_OF_MPH
    return F.when(speed > 0, meters / speed).otherwise(F.lit(9999.0)) + F.coalesce(_mapped(control, CONTROL_SECONDS), F.lit(0.0))


def discretized(roads: DataFrame, step: float) -> DataFrame:
    """Midpoints (road, piece, x, y, weight) of about `step` long pieces of segments; those without length are left out."""
    length = geo.planar(F.col("ax"), F.col("ay"), F.col("ex"), F.col("ey"))
    n = F.greatest(F.floor(length / step), F.lit(1)).cast("long")
    pieces = roads.withColumn("n", n).where(length > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("piece"))
    part = (F.col("piece") + 0.5) / F.col("n")
    return pieces.select("road", "piece", (F.col("ax") + part * (F.col("ex") - F.col("ax"))).alias("x"), (F.col("ay") + part * (F.col("ey") - F.col("ay"))).alias("y"), "weight")


def decay_sums(sites: DataFrame, points: DataFrame, radii: Sequence[float]) -> DataFrame:
    """site and, for each radius, raw_<radius>: the sum of weight * exp(-DECAY * distance) of the points within it; 0 where none is.

    One join at the largest radius serves all of them.
    """
    x = lambda df: F.col("site_x") if "site_x" in df.columns else F.col("x")
    y = lambda df: F.col("site_y") if "site_y" in df.columns else F.col("y")
    r = float(max(radii))
    d = geo.planar(F.col("x"), F.col("y"), F.col("site_x"), F.col("site_y"))
    near = spatial.within(points, sites, x, y, (r, r), d, r)
    decayed = F.col("weight") * F.exp(-DECAY * F.col("distance"))
    sums = near.groupBy("site").agg(*[F.sum(F.when(F.col("distance") <= q, decayed)).alias(f"raw_{q}") for q in radii])
    return sites.select("site").join(sums, "site", "left").fillna(0.0)


def mitigated(raw: Column, canopy: Column) -> Column:
    return raw * (1 - F.least(canopy * CANOPY_SHARE, F.lit(CANOPY_MOST)))


def window_cells(sites: DataFrame, cells: DataFrame, reach: int) -> DataFrame:
    """Cells (row, col, class) of the square window around each site's cell (site, row0, col0), up to `reach` cells away; an equi-join on coarse tiles."""
    tile = 2 * reach + 1
    at = lambda c: F.floor(F.col(c) / tile)
    around = lambda c: F.explode(F.array(*[at(c) + d for d in (-1, 0, 1)]))
    placed = sites.withColumn("_tr", around("row0")).withColumn("_tc", around("col0"))
    near = cells.withColumn("_tr", at("row")).withColumn("_tc", at("col")).join(placed, ["_tr", "_tc"])
    return near.where((F.abs(F.col("row") - F.col("row0")) <= reach) & (F.abs(F.col("col") - F.col("col0")) <= reach)).drop("_tr", "_tc")


def canopy_fraction(window: DataFrame) -> DataFrame:
    """site and the part of its valid cells (class > 0) that are trees (class 10)."""
    return window.groupBy("site").agg(F.coalesce(F.try_divide(F.count_if(F.col("class") == 10), F.count_if(F.col("class") > 0)), F.lit(0.0)).alias("canopy"))


def heat_score(window: DataFrame) -> DataFrame:
    """site and uhi: the mean land-cover weight of its valid cells, from 0 (all trees) to 100 (all built up)."""
    mean = F.avg(F.when(F.col("class") > 0, _mapped(F.col("class"), LAND_WEIGHTS)))
    return window.groupBy("site").agg(geo.clamp((mean - COOLEST) / (HOTTEST - COOLEST) * 100, 0, 100).alias("uhi"))


def land_sums(cells: DataFrame) -> raster.RunningSums:
    """Running sums of land-cover cells (row, col, class): how many are valid (class > 0), how many trees, and their weights in hundredths."""
    kind = F.col("class")
    weights = _mapped(kind, {c: round(w * 100) for c, w in LAND_WEIGHTS.items()})
    return raster.running_sums(cells, {"valid": F.when(kind > 0, 1), "trees": F.when(kind == 10, 1), "heat": F.when(kind > 0, weights)})


def exposure_grid(grid: DataFrame, points: DataFrame, land: raster.RunningSums, size: float, half: float, radius: float = 1000) -> DataFrame:
    """grid (cell, x, y, ...) with raw, the decayed sum of the points (x, y, weight) within the radius, and net of the canopy in the square of `half` around each centre.

    Canopy is asked for only where there is exposure.
    """
    raw = decay_sums(grid.select(F.col("cell").alias("site"), F.col("x").alias("site_x"), F.col("y").alias("site_y")), points, (radius,))
    told = grid.join(raw.select(F.col("site").alias("cell"), F.col(f"raw_{radius}").alias("raw")), "cell")
    shade = raster.window_sums(told.where("raw > 0").select("cell", *raster.square(F.col("x"), F.col("y"), half, size)), "cell", land)
    canopy = F.coalesce(F.try_divide("trees", "valid"), F.lit(0.0))
    return told.join(shade.select("cell", canopy.alias("canopy")), "cell", "left").fillna(0.0, subset=["canopy"]).withColumn("net", mitigated(F.col("raw"), F.col("canopy")))


def heat_grid(grid: DataFrame, land: raster.RunningSums, size: float, half: float) -> DataFrame:
    """grid (cell, x, y, ...) with uhi, the heat score of the square of `half` around each centre; 0 where the land cover is not known."""
    sums = raster.window_sums(grid.select("cell", *raster.square(F.col("x"), F.col("y"), half, size)), "cell", land)
    mean = F.try_divide("heat", "valid") / 100
    score = geo.clamp((mean - COOLEST) / (HOTTEST - COOLEST) * 100, 0, 100)
    return grid.join(sums.select("cell", F.when(F.col("valid") > 0, score).otherwise(0.0).alias("uhi")), "cell")


def rasterized_least(points: DataFrame, value: str, bounds: tuple[float, float, float, float], rows: int, cols: int) -> DataFrame:
    """row, col and the least value of each cell that has points; points outside the bounds count for the border cells."""
    x1, y1, x2, y2 = bounds
    index = lambda c, lo, hi, n: F.least(F.greatest(F.floor((F.col(c) - lo) / ((hi - lo) / n)), F.lit(0)), F.lit(n - 1)).cast("long")
    return points.groupBy(index("y", y1, y2, rows).alias("row"), index("x", x1, x2, cols).alias("col")).agg(F.min(value).alias("value"))


def filled(cells: DataFrame, rows: int, cols: int, passes: int = 1) -> DataFrame:
    """cells with the empty ones that have neighbours filled by the mean of their 3 x 3 surroundings, pass after pass."""
    for _ in range(passes):
        cells = _filled(cells, rows, cols)
    return cells


def _filled(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    spread = cells.withColumn("s", F.explode(steps)).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "value")
    means = spread.where((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols)).groupBy("row", "col").agg(F.avg("value").alias("value"))
    return cells.unionByName(means.join(cells.select("row", "col"), ["row", "col"], "left_anti"))
