"""Facilities around sites: counts by distance band, nearest site, lists within reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial

RADII = (0.25, 0.5, 1.0, 2.0)
#: Degrees that are at least a mile at the latitudes below 60.
MILE_LAT, MILE_LON = 1 / 68.7, 1 / 34.0


def _miles() -> Column:
    return geo.haversine_miles(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon"))


def near_pairs(facilities: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """facilities (lat, lon) with the sites (site, site_lat, site_lon) within `radius` miles, and the distance."""
    x = lambda df: F.col("site_lon") if "site_lon" in df.columns else F.col("lon")
    y = lambda df: F.col("site_lat") if "site_lat" in df.columns else F.col("lat")
    return spatial.within(facilities, sites, x, y, (radius * MILE_LON, radius * MILE_LAT), _miles(), radius)


def band_counts(facilities: DataFrame, sites: DataFrame, radii: Sequence[float] = RADII) -> DataFrame:
    """A row for each site and radius, those without facilities too: how many are within it and their capacity."""
    pairs = near_pairs(facilities, sites, max(radii))
    bands = F.explode(F.array(*[F.lit(float(r)) for r in radii]))
    counted = pairs.withColumn("radius", bands).where("distance <= radius").groupBy("site", "radius")
    counted = counted.agg(F.count("*").alias("n"), F.sum("capacity").alias("capacity"))
    every = sites.select("site", bands.alias("radius"))
    return every.join(counted, ["site", "radius"], "left").select("site", "radius", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("capacity", F.lit(0.0)).alias("capacity"))


def band_table(facilities: DataFrame, sites: DataFrame, radii: Sequence[float] = RADII) -> DataFrame:
    """A row for each site with a count column for each radius (n_0_25 and so on)."""
    pairs = near_pairs(facilities, sites, max(radii)).groupBy("site")
    counts = pairs.agg(*[F.count_if(F.col("distance") <= r).alias(_name(r)) for r in radii])
    return sites.select("site").join(counts, "site", "left").fillna(0)


def _name(radius: float) -> str:
    return f"n_{radius:g}".replace(".", "_") if radius != int(radius) else f"n_{int(radius)}"


def nearest_site(facilities: DataFrame, sites: DataFrame) -> DataFrame:
    """facilities with the nearest site and its distance in miles, the least site of equals."""
    distance = lambda s: geo.haversine_miles(F.col("lat"), F.col("lon"), s["site_lat"], s["site_lon"])
    # Sites outside the cells around a facility are at least half a mile away, below 60 degrees of latitude.
    cell = (0.5 * MILE_LON, 0.5 * MILE_LAT, 0.5)
    out = spatial.nearest(facilities, sites, distance, ["site", "site_lat", "site_lon"], "site", (F.col("lon"), F.col("lat")), (F.col("site_lon"), F.col("site_lat")), cell)
    return out.withColumn("site", F.col("nearest.site")).withColumn("distance", F.col("nearest.distance")).drop("nearest")


def reachable_lists(facilities: DataFrame, sites: DataFrame, radius: float, key: str) -> DataFrame:
    """key and the sorted list of (distance, site) within the radius, by facility; an empty list where there is none."""
    near = near_pairs(facilities, sites, radius).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("distance", "site"))).alias("within"))
    return facilities.select(key).join(near, key, "left").withColumn("within", F.coalesce("within", F.array().cast("array<struct<distance:double,site:bigint>>")))
