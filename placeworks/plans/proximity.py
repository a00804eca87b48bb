"""Queries on facilities around sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, projection
from ..operators import proximity as P
from ..operators import spatial, tables
from .adapters import entity, sql
from .registry import query

MILES = """2 * 3959e0 * asin(sqrt(least(sin(radians(site_lat - lat) / 2) * sin(radians(site_lat - lat) / 2)
  + cos(radians(lat)) * cos(radians(site_lat)) * sin(radians(site_lon - lon) / 2) * sin(radians(site_lon - lon) / 2), 1e0)))"""
PAIRS = sql("site", "facility") + f", pairs AS (SELECT *, {MILES} AS d FROM facility, site)"


@query("proximity_counts", PAIRS + """, radii AS (SELECT unnest([0.25e0, 0.5e0, 1e0, 2e0]) AS radius)
SELECT s.site, r.radius, count(p.facility) AS n, round(coalesce(sum(p.capacity), 0e0), 4) AS capacity
FROM site s CROSS JOIN radii r LEFT JOIN pairs p ON p.site = s.site AND p.d <= r.radius GROUP BY ALL""")
def proximity_counts(spark, sf_dir):
    out = P.band_counts(entity(spark, sf_dir, "facility"), entity(spark, sf_dir, "site"))
    return out.withColumn("capacity", F.round("capacity", 4))


@query("proximity_pivot", PAIRS + """SELECT s.site, CAST(count_if(d <= 0.25e0) AS BIGINT) AS n_0_25, CAST(count_if(d <= 0.5e0) AS BIGINT) AS n_0_5, CAST(count_if(d <= 1) AS BIGINT) AS n_1, CAST(count_if(d <= 2) AS BIGINT) AS n_2
FROM site s LEFT JOIN pairs p USING (site) GROUP BY ALL""")
def proximity_pivot(spark, sf_dir):
    return P.band_table(entity(spark, sf_dir, "facility"), entity(spark, sf_dir, "site"))


@query("proximity_nearest", PAIRS + """SELECT facility, site, round(d, 6) AS distance FROM pairs
QUALIFY row_number() OVER (PARTITION BY facility ORDER BY d, site) = 1""")
def proximity_nearest(spark, sf_dir):
    out = P.nearest_site(entity(spark, sf_dir, "facility"), entity(spark, sf_dir, "site"))
    return out.select("facility", "site", F.round("distance", 6).alias("distance"))


@query("proximity_within_list", PAIRS + """SELECT f.facility, count(p.site) AS n, coalesce(string_agg(CAST(p.site AS VARCHAR), ',' ORDER BY d, p.site), '') AS sites
FROM facility f LEFT JOIN pairs p ON p.facility = f.facility AND p.d <= 1.5e0 GROUP BY ALL""")
def proximity_within_list(spark, sf_dir):
    out = P.reachable_lists(entity(spark, sf_dir, "facility"), entity(spark, sf_dir, "site"), 1.5, "facility")
    return out.select("facility", F.size("within").cast("long").alias("n"), F.array_join(F.transform("within", lambda w: w["site"].cast("string")), ",").alias("sites"))


@query("proximity_master_pivot", PAIRS + """SELECT s.site, k.kind, CAST(count_if(d <= 0.5e0) AS BIGINT) AS n_0_5, CAST(count_if(d <= 1) AS BIGINT) AS n_1
FROM site s CROSS JOIN (SELECT DISTINCT kind FROM facility) k LEFT JOIN pairs p ON p.site = s.site AND p.kind = k.kind GROUP BY ALL""")
def proximity_master_pivot(spark, sf_dir):
    facilities, sites = entity(spark, sf_dir, "facility"), entity(spark, sf_dir, "site")
    pairs = P.near_pairs(facilities, sites, 1.0).groupBy("site", "kind")
    counts = pairs.agg(F.count_if(F.col("distance") <= 0.5).alias("n_0_5"), F.count("*").alias("n_1"))
    # Sites and kinds are dimensions of a few rows each.
    every = sites.select("site").crossJoin(F.broadcast(facilities.select("kind").distinct()))
    return every.join(counts, ["site", "kind"], "left").fillna(0)


@query("nearest_node", sql("site", "facility") + """SELECT site, facility AS node, round(d, 6) AS distance FROM (
SELECT site, facility, sqrt(((lon - site_lon) * cos(radians(35.95e0)) * 111320) ** 2 + ((lat - site_lat) * 111320) ** 2) AS d FROM site, facility)
QUALIFY row_number() OVER (PARTITION BY site ORDER BY d, facility) = 1""")
def nearest_node(spark, sf_dir):
    """The nearest node of each site, by degrees scaled to metres."""
    nodes = entity(spark, sf_dir, "facility").select("facility", "lat", "lon")
    d = lambda n: geo.equirectangular_m(F.col("site_lat"), F.col("site_lon"), n["lat"], n["lon"], 35.95)
    # A cell is a hundredth of a degree of latitude high, so 1,113 m, and wider than that in the other direction.
    placed = spatial.nearest(entity(spark, sf_dir, "site"), nodes, d, ["facility", "lat", "lon"], "facility", (F.col("site_lon"), F.col("site_lat")), (F.col("lon"), F.col("lat")), (0.0125, 0.01, 1113.0))
    return placed.select("site", F.col("nearest.facility").alias("node"), F.round("nearest.distance", 6).alias("distance"))


@query("distance_filter", sql("site", "zone") + """SELECT site, min(CASE WHEN site_x >= x1 AND site_x < x2 AND site_y >= y1 AND site_y < y2 THEN 0e0
ELSE round(sqrt(greatest(x1 - site_x, 0, site_x - x2) ** 2 + greatest(y1 - site_y, 0, site_y - y2) ** 2), 6) END) AS distance FROM site, zone WHERE zone < 2 GROUP BY site HAVING distance <= 3000""")
def distance_filter(spark, sf_dir):
    """Sites within 3000 m of two zones, 0 inside them."""
    zones = entity(spark, sf_dir, "zone").where("zone < 2").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("z"))
    joined = entity(spark, sf_dir, "site").crossJoin(F.broadcast(zones))  # two zones
    zero = F.lit(0.0)

    def distance(z):
        dx = F.greatest(z["x1"] - F.col("site_x"), zero, F.col("site_x") - z["x2"])
        dy = F.greatest(z["y1"] - F.col("site_y"), zero, F.col("site_y") - z["y2"])
        return F.round(F.sqrt(dx * dx + dy * dy), 6)

    return joined.select("site", F.array_min(F.transform("z", distance)).alias("distance")).where("distance <= 3000")


@query("nearest_zone_partition", sql("site", "facility") + """SELECT site, count(*) AS n, round(sum(capacity), 4) AS capacity FROM (
SELECT facility, capacity, site FROM facility, site WHERE x BETWEEN 1000 AND 9000 AND y BETWEEN 1000 AND 9000
QUALIFY row_number() OVER (PARTITION BY facility ORDER BY sqrt((site_x - x) * (site_x - x) + (site_y - y) * (site_y - y)), site) = 1) GROUP BY site""")
def nearest_zone_partition(spark, sf_dir):
    """Membership in the cells of sites: the nearest one, inside the district."""
    inside = entity(spark, sf_dir, "facility").where("x BETWEEN 1000 AND 9000 AND y BETWEEN 1000 AND 9000")
    distance = lambda s: geo.planar(F.col("x"), F.col("y"), s["site_x"], s["site_y"])
    placed = spatial.nearest(inside, entity(spark, sf_dir, "site"), distance, ["site", "site_x", "site_y"], "site", (F.col("x"), F.col("y")), (F.col("site_x"), F.col("site_y")), (500.0, 500.0, 500.0))
    return placed.groupBy(F.col("nearest.site").alias("site")).agg(F.count("*").alias("n"), F.round(F.sum("capacity"), 4).alias("capacity"))


@query("angular_sample", sql("site", "facility") + """SELECT facility, n AS place FROM (SELECT facility, row_number() OVER (ORDER BY round(atan2(y - 5000, x - 5000), 9), facility) - 1 AS n
FROM facility WHERE sqrt((x - 5000) * (x - 5000) + (y - 5000) * (y - 5000)) <= 1200) WHERE n % 5 = 0""")
def angular_sample(spark, sf_dir):
    """Every fifth of the facilities around a centre, by angle."""
    near = entity(spark, sf_dir, "facility").where(geo.planar(F.col("x"), F.col("y"), F.lit(5000), F.lit(5000)) <= 1200)
    near = near.select("facility", F.round(F.atan2(F.col("y") - 5000, F.col("x") - 5000), 9).alias("angle"))
    return tables.numbered(near, ["angle", "facility"], "place").where("place % 5 = 0").select("facility", "place")


@query("union_anchors", sql("site", "facility") + """SELECT DISTINCT x, y FROM (SELECT x, y FROM facility WHERE facility % 3 = 0 UNION ALL SELECT site_x, site_y FROM site)""")
def union_anchors(spark, sf_dir):
    points = entity(spark, sf_dir, "facility").where("facility % 3 = 0").select("x", "y")
    return points.unionByName(entity(spark, sf_dir, "site").select(F.col("site_x").alias("x"), F.col("site_y").alias("y"))).distinct()


@query("central_reachable", PAIRS + """SELECT facility, round(total, 6) AS total FROM (SELECT facility, sum(d) AS total FROM pairs WHERE d <= 12 GROUP BY facility HAVING count(DISTINCT site) = (SELECT count(*) FROM site))
ORDER BY round(total, 6), facility LIMIT 1""")
def central_reachable(spark, sf_dir):
    """The facility that reaches every site within 12 miles with the least total distance."""
    sites = entity(spark, sf_dir, "site")
    met = P.near_pairs(entity(spark, sf_dir, "facility"), sites, 12.0).groupBy("facility").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 6).alias("total"))
    every = sites.agg(F.count("*").alias("_sites"))  # one row
    return met.crossJoin(F.broadcast(every)).where("n = _sites").select("facility", "total").orderBy("total", "facility").limit(1)


# Fixed values of the series, written out: third flattening, rectifying radius times scale, coefficients.
_SERIES = "0.0016792203863837047e0 AS n, 0.0818191908426215e0 AS e, 6367449.145823415e0 * 0.9996e0 AS r"
_UTM_SQL = f"""SELECT site, lat, lon, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t, radians(lon + 81) AS w, n, r FROM (SELECT site, site_lat AS lat, site_lon AS lon FROM site UNION ALL SELECT facility, lat, lon FROM facility), (SELECT {_SERIES})"""


@query("utm_places", sql("site", "facility") + f""", a AS ({_UTM_SQL}), b AS (SELECT *, atan2(t, cos(w)) AS xi, atanh(sin(w) / sqrt(t * t + 1)) AS eta, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 AS a2,
61 * n ** 3 / 240 - 103 * n ** 4 / 140 AS a3, 49561 * n ** 4 / 161280 AS a4 FROM a)
SELECT site AS place, round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 3) AS easting,
round(r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 3) AS northing, round(lat, 9) AS lat, round(lon, 9) AS lon FROM b""")
def utm_places(spark, sf_dir):
    """Sites and facilities in metres of their UTM zone, and back in degrees from these."""
    places = entity(spark, sf_dir, "site").selectExpr("site AS place", "site_lat AS lat", "site_lon AS lon").unionByName(entity(spark, sf_dir, "facility").selectExpr("facility AS place", "lat", "lon"))
    easting, northing = projection.utm(F.col("lat"), F.col("lon"), 17)
    metres = places.select("place", easting.alias("e"), northing.alias("n"))
    lat, lon = projection.from_utm(F.col("e"), F.col("n"), 17)
    return metres.select("place", F.round("e", 3).alias("easting"), F.round("n", 3).alias("northing"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))
