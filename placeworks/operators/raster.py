"""Rasters as tables of cells (row, col, ...): sums over windows of any size, nearest reprojection, grids over an extent.

Sums over windows go by tiles of running sums. A tile knows the sum of its
cells up to each place in it, of all cells left of it by row, and of all cells
under it by column; so the sum up to any place of the raster is read from one
tile, and a window, whatever its size, from four.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import projection
from .cut import cut

#: Cells along the side of a tile.
TILE = 64
#: Places on each side of an extent at which its outline is projected.
SAMPLES = 64


def _whole(first: int, last: int) -> Column:
    return F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))


@dataclass(frozen=True)
class RunningSums:
    """tiles (tr, tc, an array for each stat, carry) of a raster between rows and cols, ends included."""

    tiles: DataFrame
    stats: tuple[str, ...]
    rows: tuple[int, int]
    cols: tuple[int, int]
    tile: int


def running_sums(cells: DataFrame, stats: dict[str, Column], tile: int = TILE) -> RunningSums:
    """Running sums of whole-number stats of cells (row, col, ...). A null counts for 0, as does a cell that is not there; one that is there twice counts twice.

    A task holds one tile at a time. What tiles pass on is a number for each
    row and column of a tile, summed over tiles in windows.
    """
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    place = (F.pmod(F.col("row"), F.lit(tile)) * tile + F.pmod(F.col("col"), F.lit(tile))).cast("int")
    placed = cells.where("row IS NOT NULL AND col IS NOT NULL").select(at("row").alias("tr"), at("col").alias("tc"), place.alias("at"), *(F.coalesce(v.cast("long"), F.lit(0)).alias(s) for s, v in stats.items()))

    names = tuple(stats)

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        out = {"tr": group["tr"].iloc[:1], "tc": group["tc"].iloc[:1]}
        for s in names:
            flat = np.zeros(tile * tile, np.int64)
            np.add.at(flat, group["at"].to_numpy(), group[s].to_numpy())
            out[s] = [flat.reshape(tile, tile).cumsum(0).cumsum(1).ravel()]
        return pd.DataFrame(out)

    kinds = ", ".join(f"`{s}` array<bigint>" for s in stats)
    tiles = cut(placed.groupBy("tr", "tc").applyInPandas(summed, f"tr bigint, tc bigint, {kinds}"))
    r1, r2, c1, c2 = tiles.agg(F.min("tr"), F.max("tr"), F.min("tc"), F.max("tc")).first()
    if r1 is None:
        r1, r2, c1, c2 = 0, -1, 0, -1
    # Tiles without cells pass on what others have.
    lattice = cells.sparkSession.range(r1, r2 + 1).select(F.col("id").alias("tr"), F.explode(_whole(c1, max(c1, c2))).alias("tc"))
    tiles = lattice.join(tiles, ["tr", "tc"], "left")
    sides = lambda i: F.struct(*(F.coalesce(F.get(s, i * tile + tile - 1), F.lit(0)).alias(f"right_{s}") for s in stats), *(F.coalesce(F.get(s, (tile - 1) * tile + i), F.lit(0)).alias(f"top_{s}") for s in stats))
    passed = tiles.select("tr", "tc", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), sides)).alias("pos", "e"))
    before = lambda *by: Window.partitionBy(*by)
    along = before("tr", "pos").orderBy("tc").rowsBetween(Window.unboundedPreceding, -1)
    up = before("tc", "pos").orderBy("tr").rowsBetween(Window.unboundedPreceding, -1)
    passed = passed.withColumns({f"left_{s}": F.coalesce(F.sum(f"e.right_{s}").over(along), F.lit(0)) for s in stats})
    # The last row's sum over the tiles on the left is that of all their cells.
    passed = passed.withColumns({f"all_{s}": F.max(F.when(F.col("pos") == tile - 1, F.col(f"left_{s}"))).over(before("tr", "tc")) for s in stats})
    passed = passed.withColumns({f"under_{s}": F.coalesce(F.sum(F.col(f"e.top_{s}") + F.col(f"all_{s}")).over(up), F.lit(0)) for s in stats})
    carry = F.array_sort(F.collect_list(F.struct("pos", *(f"{side}_{s}" for side in ("left", "under") for s in stats))))
    whole = tiles.join(passed.groupBy("tr", "tc").agg(carry.alias("carry")), ["tr", "tc"])
    return RunningSums(whole, tuple(stats), (r1 * tile, (r2 + 1) * tile - 1), (c1 * tile, (c2 + 1) * tile - 1), tile)


def window_sums(windows: DataFrame, key: str, sums: RunningSums) -> DataFrame:
    """key and the stats' sums over the cells of its window (r1, r2, c1, c2; ends included); 0 where it holds none or an end is null. Keys are unique and not null.

    Each window meets four tiles at most, so what it costs does not depend on its size.
    """
    t = sums.tile
    corners = F.array(*[F.struct(F.lit(sign).alias("sign"), r.cast("long").alias("r"), c.cast("long").alias("c")) for sign, r, c in (
        (1, F.col("r2"), F.col("c2")), (-1, F.col("r1") - 1, F.col("c2")), (-1, F.col("r2"), F.col("c1") - 1), (1, F.col("r1") - 1, F.col("c1") - 1))])
    asked = windows.where("r1 <= r2 AND c1 <= c2").select(key, F.explode(corners).alias("q")).select(key, "q.*")
    asked = asked.where((F.col("r") >= sums.rows[0]) & (F.col("c") >= sums.cols[0])).withColumns({"r": F.least("r", F.lit(sums.rows[1])), "c": F.least("c", F.lit(sums.cols[1]))})
    asked = asked.select(key, "sign", F.floor(F.col("r") / t).alias("tr"), F.floor(F.col("c") / t).alias("tc"), F.pmod("r", F.lit(t)).cast("int").alias("i"), F.pmod("c", F.lit(t)).cast("int").alias("j"))
    met = asked.join(sums.tiles, ["tr", "tc"])
    up_to = lambda s: F.coalesce(F.get(s, F.col("i") * t + F.col("j")), F.lit(0)) + F.get("carry", F.col("i"))[f"left_{s}"] + F.get("carry", F.col("j"))[f"under_{s}"]
    found = met.select(key, *((F.col("sign") * up_to(s)).alias(s) for s in sums.stats)).groupBy(key).agg(*(F.sum(s).alias(s) for s in sums.stats))
    return windows.select(key).join(found, key, "left").fillna(0, subset=list(sums.stats))


def square(x: Column, y: Column, half: float, size: float) -> list[Column]:
    """The window (r1, r2, c1, c2) of the cells of `size` that a square around a place touches."""
    index = lambda v: F.floor(v / F.lit(float(size))).cast("long")
    return [index(y - half).alias("r1"), index(y + half).alias("r2"), index(x - half).alias("c1"), index(x + half).alias("c2")]


def reprojected(cells: DataFrame, bounds: tuple[float, float, float, float], shape: tuple[int, int], zone: int, size: float) -> DataFrame:
    """Cells (row, col, ...) of a raster in degrees, rows from the south, as cells of `size` metres in a UTM zone: each takes what the source has at its centre.

    bounds are west, south, east and north, shape is (rows, cols). Rows and
    columns of the result count from the zone's origin. Centres outside the
    bounds, and those on source cells that are not there, have no row.
    """
    west, south, east, north = bounds
    rows, cols = shape
    spark = cells.sparkSession
    part = F.col("id") / SAMPLES
    lon, lat = F.lit(west) + part * (east - west), F.lit(south) + part * (north - south)
    ends = spark.range(SAMPLES + 1).select(F.explode(F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in ((lon, F.lit(south)), (lon, F.lit(north)), (F.lit(west), lat), (F.lit(east), lat))])).alias("p"))
    ends = projection.with_utm(ends.select("p.*"), "lat", "lon", zone)
    x1, x2, y1, y2 = (int(v // size) for v in ends.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
    # One more on each side for the bend of the outline between samples.
    grid = spark.range(y1 - 1, y2 + 2).select(F.col("id").alias("row"), F.explode(_whole(x1 - 1, x2 + 1)).alias("col"))
    grid = projection.with_degrees(grid.withColumns({"_x": (F.col("col") + 0.5) * size, "_y": (F.col("row") + 0.5) * size}), "_x", "_y", zone, "_lat", "_lon")
    at = grid.select("row", "col", F.floor((F.col("_lat") - south) / ((north - south) / rows)).alias("_r"), F.floor((F.col("_lon") - west) / ((east - west) / cols)).alias("_c"))
    at = at.where((F.col("_r") >= 0) & (F.col("_r") < rows) & (F.col("_c") >= 0) & (F.col("_c") < cols))
    return at.join(cells.withColumnsRenamed({"row": "_r", "col": "_c"}), ["_r", "_c"]).drop("_r", "_c")


def extent_grid(spark: SparkSession, bounds: tuple[float, float, float, float], zone: int, resolution: float) -> DataFrame:
    """(cell, row, col, lat, lon, x, y): centres of the cells, about `resolution` metres wide, that an extent in degrees is cut into; rows from the north."""
    west, south, east, north = bounds
    corners = spark.range(2).select(F.when(F.col("id") == 0, south).otherwise(north).alias("lat"), F.when(F.col("id") == 0, west).otherwise(east).alias("lon"))
    width, height = projection.with_utm(corners, "lat", "lon", zone).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    nx, ny = max(round(width / resolution), 1), max(round(height / resolution), 1)
    cells = spark.range(nx * ny).select(F.col("id").alias("cell"), F.expr(f"id div {nx}").alias("row"), (F.col("id") % nx).alias("col"))
    cells = cells.withColumns({"lat": F.lit(north) - (F.col("row") + 0.5) * ((north - south) / ny), "lon": F.lit(west) + (F.col("col") + 0.5) * ((east - west) / nx)})
    return projection.with_utm(cells, "lat", "lon", zone)
