"""Queries on roads, exposure around sites, and rasters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import exposure as E
from ..operators import spatial, tables
from .adapters import entity, sql
from .registry import query, table


# The tables of the operators once more, written out, so that the SQL does not follow a change of theirs.
WEIGHT = """CASE WHEN class = 'service' THEN CASE service WHEN 'driveway' THEN 0.002e0 WHEN 'alley' THEN 0.003e0 WHEN 'drive-through' THEN 0.001e0 ELSE 0.005e0 END
ELSE CASE class WHEN 'motorway' THEN 1e0 WHEN 'motorway_link' THEN 0.8e0 WHEN 'trunk' THEN 0.6e0 WHEN 'trunk_link' THEN 0.48e0 WHEN 'primary' THEN 0.3e0 WHEN 'primary_link' THEN 0.24e0
WHEN 'secondary' THEN 0.15e0 WHEN 'secondary_link' THEN 0.12e0 WHEN 'tertiary' THEN 0.06e0 WHEN 'tertiary_link' THEN 0.048e0 WHEN 'unclassified' THEN 0.02e0 WHEN 'residential' THEN 0.01e0 WHEN 'living_street' THEN 0.005e0 END END"""
SPEED = """CASE class WHEN 'motorway' THEN 59e0 WHEN 'motorway_link' THEN 49e0 WHEN 'trunk' THEN 43e0 WHEN 'trunk_link' THEN 37e0 WHEN 'primary' THEN 34e0 WHEN 'primary_link' THEN 28e0
WHEN 'secondary' THEN 28e0 WHEN 'secondary_link' THEN 24e0 WHEN 'tertiary' THEN 24e0 WHEN 'service' THEN 11e0 WHEN 'living_street' THEN 11e0 ELSE 20e0 END * 0.44704e0"""
CONTROL = "CASE road % 8 WHEN 0 THEN 22e0 WHEN 1 THEN 11e0 WHEN 2 THEN 6e0 WHEN 3 THEN 3e0 WHEN 4 THEN 4e0 ELSE 0e0 END"
HEAT = "CASE class WHEN 10 THEN -0.6e0 WHEN 20 THEN -0.3e0 WHEN 30 THEN -0.1e0 WHEN 40 THEN -0.05e0 WHEN 50 THEN 1e0 WHEN 60 THEN 0.4e0 WHEN 80 THEN -0.5e0 WHEN 90 THEN -0.4e0 WHEN 95 THEN -0.4e0 END"
WEIGHTED = sql("road", "site") + f", weighted AS (SELECT *, {WEIGHT} AS weight, sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS len FROM road)"
POINTS = WEIGHTED + """, pieces AS (SELECT *, greatest(CAST(floor(len / 50e0) AS BIGINT), 1) AS n FROM weighted WHERE weight IS NOT NULL AND len > 0),
point AS (SELECT road, i AS piece, ax + (i + 0.5e0) / n * (ex - ax) AS x, ay + (i + 0.5e0) / n * (ey - ay) AS y, weight FROM pieces, LATERAL (SELECT unnest(range(n)) AS i))
"""


def weighted(spark, sf_dir):
    roads = entity(spark, sf_dir, "road").withColumn("weight", E.road_weight(F.col("class"), F.col("service")))
    return roads.withColumn("len", geo.planar(F.col("ax"), F.col("ay"), F.col("ex"), F.col("ey")))


def points(spark, sf_dir):
    return E.discretized(weighted(spark, sf_dir).where("weight IS NOT NULL"), 50.0)


@query("road_weights", WEIGHTED + "SELECT road, class, weight FROM weighted WHERE weight IS NOT NULL")
def road_weights(spark, sf_dir):
    return weighted(spark, sf_dir).where("weight IS NOT NULL").select("road", "class", "weight")


@query("road_class_summary", WEIGHTED + "SELECT class, count(*) AS n, round(avg(len), 4) AS mean_length, count(weight) AS n_weighted FROM weighted GROUP BY class")
def road_class_summary(spark, sf_dir):
    return weighted(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("len"), 4).alias("mean_length"), F.count("weight").alias("n_weighted"))


@query("edge_travel_time", WEIGHTED + f"""SELECT road, round(len / 1.12e0, 6) AS walk, round(len / 5.36e0, 6) AS bike, round(len / ({SPEED}) + {CONTROL}, 6) AS drive FROM weighted""")
def edge_travel_time(spark, sf_dir):
    tags = ("traffic_signals", "stop", "give_way", "crossing", "turning_circle", "motorway_junction", "unknown")
    control = F.get(F.array(*[F.lit(t) for t in tags]), (F.col("road") % 8).cast("int"))  # the last of eight has none
    return weighted(spark, sf_dir).select("road", *[F.round(E.travel_seconds(m, F.col("len"), F.col("class"), control), 6).alias(m) for m in ("walk", "bike", "drive")])


@query("discretize", POINTS + "SELECT road, piece, round(x, 4) AS x, round(y, 4) AS y, weight FROM point")
def discretize(spark, sf_dir):
    return points(spark, sf_dir).select("road", "piece", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "weight")


DISTANCE = "sqrt((x - site_x) * (x - site_x) + (y - site_y) * (y - site_y))"
RAW = POINTS + f""", raw AS (SELECT site, coalesce(sum(weight * exp(-0.003e0 * {DISTANCE})) FILTER ({DISTANCE} <= 500), 0) AS r500, coalesce(sum(weight * exp(-0.003e0 * {DISTANCE})) FILTER ({DISTANCE} <= 1000), 0) AS r1000 FROM site, point GROUP BY site)
"""


@query("radius_decay", RAW + "SELECT site, round(r500, 6) AS raw_500, round(r1000, 6) AS raw_1000 FROM raw")
def radius_decay(spark, sf_dir):
    out = E.decay_sums(entity(spark, sf_dir, "site"), points(spark, sf_dir), (500, 1000))
    return out.select("site", F.round("raw_500", 6).alias("raw_500"), F.round("raw_1000", 6).alias("raw_1000"))


@query("site_exposure", RAW + """SELECT site, round(r1000, 6) AS raw, round(r1000 / max(r1000) OVER () * 100, 4) AS raw_norm, rank() OVER (ORDER BY round(r1000, 6) DESC) AS rank_raw,
round(r1000 * (1 - least(0.56e0 * (site % 4) / 4e0, 0.8e0)), 6) AS net FROM raw""")
def site_exposure(spark, sf_dir):
    """Exposure by site: raw, as percent of the largest, ranked, and net of canopy. A row for each site: one partition for the ranks."""
    out = E.decay_sums(entity(spark, sf_dir, "site"), points(spark, sf_dir), (1000,)).withColumn("raw", F.round("raw_1000", 6))
    out = out.withColumn("raw_norm", F.round(F.col("raw_1000") / F.max("raw_1000").over(Window.partitionBy()) * 100, 4))
    out = tables.rank_min(out, "raw", "rank_raw")
    return out.select("site", "raw", "raw_norm", "rank_raw", F.round(E.mitigated(F.col("raw_1000"), F.col("site") % 4 / 4.0), 6).alias("net"))


GRID = ", cell AS (SELECT gx * 10 + gy AS site, gx * 1000e0 + 500 AS site_x, gy * 1000e0 + 500 AS site_y FROM range(10) a(gx), range(10) b(gy))"


@query("decay_grid", POINTS + GRID + f"SELECT site AS cell, round(coalesce(sum(weight * exp(-0.003e0 * {DISTANCE})), 0), 6) AS raw FROM cell LEFT JOIN point ON {DISTANCE} <= 1000 GROUP BY site")
def decay_grid(spark, sf_dir):
    grid = spark.range(10).withColumnRenamed("id", "gx").withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    cells = grid.select((F.col("gx") * 10 + F.col("gy")).alias("site"), (F.col("gx") * 1000 + 500).cast("double").alias("site_x"), (F.col("gy") * 1000 + 500).cast("double").alias("site_y"))
    return E.decay_sums(cells, points(spark, sf_dir), (1000,)).select(F.col("site").alias("cell"), F.round("raw_1000", 6).alias("raw"))


@query("top8_contributors", POINTS + f"""SELECT site, road, piece, rank, round(c, 6) AS contribution, round(c / total * 100, 4) AS share, rest FROM (
SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(c, 9) DESC, road, piece) AS rank, sum(c) OVER (PARTITION BY site) AS total, greatest(count(*) OVER (PARTITION BY site) - 8, 0) AS rest
FROM (SELECT site, road, piece, weight * exp(-0.003e0 * {DISTANCE}) AS c FROM site, point WHERE {DISTANCE} <= 1000) WHERE c > 1e-4) WHERE rank <= 8""")
def top8_contributors(spark, sf_dir):
    """The eight points that contribute most at each site, their share, and how many others there are."""
    d = geo.planar(F.col("x"), F.col("y"), F.col("site_x"), F.col("site_y"))
    x = lambda df: F.col("site_x") if "site_x" in df.columns else F.col("x")
    y = lambda df: F.col("site_y") if "site_y" in df.columns else F.col("y")
    near = spatial.within(points(spark, sf_dir), entity(spark, sf_dir, "site"), x, y, (1000.0, 1000.0), d, 1000.0)
    near = near.withColumn("c", F.col("weight") * F.exp(-E.DECAY * F.col("distance"))).where("c > 1e-4")
    # Totals are summed on both sides of their exchange, and of each task's points eight of a site at most go on to be ranked.
    totals = near.groupBy("site").agg(F.sum("c").alias("total"), F.greatest(F.count("*") - 8, F.lit(0)).alias("rest"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.round("c", 9).desc(), "road", "piece"))
    top = near.select("site", "road", "piece", "c").withColumn("rank", rank).where("rank <= 8").join(totals, "site")
    return top.select("site", "road", "piece", F.col("rank").cast("long").alias("rank"), F.round("c", 6).alias("contribution"), F.round(F.col("c") / F.col("total") * 100, 4).alias("share"), "rest")


SNAP = """t, sqrt((x - (ax + t * (ex - ax))) ** 2 + (y - (ay + t * (ey - ay))) ** 2) AS d FROM (SELECT *, CASE WHEN len > 0 THEN greatest(0e0, least(1e0, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / (len * len))) ELSE 0 END AS t FROM """


@query("station_snap", sql("station") + ", " + WEIGHTED.removeprefix("WITH ") + f"""SELECT station, road, round(d, 6) AS distance, round(greatest(0.001e0, least(2e0, (station * 37 + 400) / 50000e0)), 6) AS weight FROM (SELECT station, road, {SNAP} station, weighted)) WHERE d <= 50
QUALIFY row_number() OVER (PARTITION BY road ORDER BY station DESC) = 1""")
def station_snap(spark, sf_dir):
    """Roads with a traffic station within 50 m, the last station of each, and the weight that it gives."""
    last = spatial.last_near_segments(entity(spark, sf_dir, "station"), weighted(spark, sf_dir).select("road", "ax", "ay", "ex", "ey"), "station", "road", 50.0)
    return last.select("station", "road", F.round("distance", 6).alias("distance"), F.round(geo.clamp((F.col("station") * 37 + 400) / 50000.0, 0.001, 2.0), 6).alias("weight"))


def snapped(spark, sf_dir, rows, key: str, reach: float):
    """Pairs of points and the road segments within reach. Segments are spread over the cells of their box, widened by the reach."""
    size = 500.0
    spread = lambda a, b: F.explode(F.sequence(geo.cell(F.least(a, b) - reach, size), geo.cell(F.greatest(a, b) + reach, size)))
    roads = weighted(spark, sf_dir).withColumn("_cx", spread("ax", "ex")).withColumn("_cy", spread("ay", "ey"))
    met = rows.select(key, "x", "y").withColumn("_cx", geo.cell(F.col("x"), size)).withColumn("_cy", geo.cell(F.col("y"), size)).join(roads, ["_cx", "_cy"])
    ends = [F.col(c) for c in ("x", "y", "ax", "ay", "ex", "ey")]
    return met.withColumn("t", geo.along_segment(*ends)).withColumn("distance", geo.to_segment(*ends)).where(F.col("distance") <= reach)


@query("edge_snap", sql("facility") + ", " + WEIGHTED.removeprefix("WITH ") + f"""SELECT facility, road, round(d, 6) AS distance, round(t, 6) AS fraction FROM (SELECT facility, road, {SNAP} facility, weighted)) WHERE d <= 200
QUALIFY row_number() OVER (PARTITION BY facility ORDER BY round(d, 6), road) = 1""")
def edge_snap(spark, sf_dir):
    """The nearest road of each facility within 200 m and where along it."""
    roads = weighted(spark, sf_dir).select("road", "ax", "ay", "ex", "ey")
    near = spatial.nearest_segments(entity(spark, sf_dir, "facility"), roads, "facility", "road", 200.0)
    return near.select("facility", "road", "distance", F.round("t", 6).alias("fraction"))


CODES = (0, 10, 20, 30, 40, 50, 60, 80, 90, 95, 10)


def land_sql(rows: int, cols: int) -> str:
    return f"SELECT (o_orderkey * 104729 + 31) % 10009 * {rows} // 10009 AS row, (o_orderkey * 7919 + 29) % 10007 * {cols} // 10007 AS col, {list(CODES)}[CAST(min(o_orderkey) % 11 AS BIGINT) + 1] AS class FROM orders GROUP BY 1, 2"


LAND = sql("site", "facility") + f", land AS ({land_sql(100, 100)}), win AS (SELECT site, class FROM site, land WHERE abs(row - floor(site_y / 101e0)) <= 4 AND abs(col - floor(site_x / 101e0)) <= 4)"


def land(spark, sf_dir, rows: int = 100, cols: int = 100):
    """Land cover by cells; orders stand for what was seen, the first of a cell tells its class."""
    seen = table(spark, sf_dir, "orders").groupBy(F.expr(f"(o_orderkey * 104729 + 31) % 10009 * {rows} div 10009").alias("row"), F.expr(f"(o_orderkey * 7919 + 29) % 10007 * {cols} div 10007").alias("col"))
    return seen.agg(F.get(F.array(*[F.lit(c) for c in CODES]), (F.min("o_orderkey") % 11).cast("int")).alias("class"))


def window(spark, sf_dir):
    sites = entity(spark, sf_dir, "site").select("site", F.floor(F.col("site_y") / 101).alias("row0"), F.floor(F.col("site_x") / 101).alias("col0"))
    return E.window_cells(sites, land(spark, sf_dir), 4)


@query("canopy_fraction", LAND + "SELECT site, round(coalesce(count_if(class = 10) / CAST(nullif(count_if(class > 0), 0) AS DOUBLE), 0), 6) AS canopy FROM win GROUP BY site")
def canopy_fraction(spark, sf_dir):
    return E.canopy_fraction(window(spark, sf_dir)).select("site", F.round("canopy", 6).alias("canopy"))


@query("uhi_score", LAND + f"SELECT site, round(greatest(0, least(100, (avg(CASE WHEN class > 0 THEN {HEAT} END) + 0.6e0) / 1.6e0 * 100)), 4) AS uhi FROM win GROUP BY site")
def uhi_score(spark, sf_dir):
    return E.heat_score(window(spark, sf_dir)).select("site", F.round("uhi", 4).alias("uhi"))


CELLS = sql("facility") + ", cells AS (SELECT CAST(least(greatest(floor(y / (10009e0 / 40)), 0), 39) AS BIGINT) AS row, CAST(least(greatest(floor(x / (10007e0 / 40)), 0), 39) AS BIGINT) AS col, min(capacity) AS value FROM facility GROUP BY ALL)"


def raster(spark, sf_dir):
    return E.rasterized_least(entity(spark, sf_dir, "facility"), "capacity", (0.0, 0.0, 10007.0, 10009.0), 40, 40)


@query("rasterize_min", CELLS + "SELECT * FROM cells")
def rasterize_min(spark, sf_dir):
    return raster(spark, sf_dir)


FILL = """, {0} AS (SELECT row, col, value FROM {1} UNION ALL SELECT r, c, avg(value) FROM range(40) a(r), range(40) b(c), {1}
WHERE abs(row - r) <= 1 AND abs(col - c) <= 1 AND NOT EXISTS (SELECT 1 FROM {1} k WHERE k.row = r AND k.col = c) GROUP BY r, c)"""


@query("focal_fill", CELLS + FILL.format("one", "cells") + FILL.format("two", "one") + " SELECT row, col, round(value, 6) AS value FROM two")
def focal_fill(spark, sf_dir):
    """Two passes of filling empty cells from their surroundings."""
    return E.filled(raster(spark, sf_dir), 40, 40, 2).withColumn("value", F.round("value", 6))


@query("cell_lookup", CELLS + ", p AS (SELECT site, s.site_x, s.site_y FROM (" + sql("site") + """ SELECT * FROM site) s) SELECT site, value FROM p JOIN cells ON row = CAST(floor(site_y / (10009e0 / 40)) AS BIGINT) AND col = CAST(floor(site_x / (10007e0 / 40)) AS BIGINT)""")
def cell_lookup(spark, sf_dir):
    sites = entity(spark, sf_dir, "site").select("site", F.floor(F.col("site_y") / (10009 / 40)).alias("row"), F.floor(F.col("site_x") / (10007 / 40)).alias("col"))
    return sites.join(raster(spark, sf_dir), ["row", "col"]).select("site", "value")


@query("crop_grid", CELLS + "SELECT row - 10 AS row, col - 5 AS col, value FROM cells WHERE row BETWEEN 10 AND 20 AND col BETWEEN 5 AND 30")
def crop_grid(spark, sf_dir):
    return raster(spark, sf_dir).where("row BETWEEN 10 AND 20 AND col BETWEEN 5 AND 30").select((F.col("row") - 10).alias("row"), (F.col("col") - 5).alias("col"), "value")


@query("grid_points", sql("zone") + """SELECT row_number() OVER (ORDER BY i, j) - 1 AS grid_id, i * 250e0 AS x, j * 250e0 AS y FROM range(41) a(i), range(41) b(j) WHERE EXISTS (SELECT 1 FROM zone WHERE i * 250 >= x1 AND i * 250 < x2 AND j * 250 >= y1 AND j * 250 < y2)""")
def grid_points(spark, sf_dir):
    """A regular grid's points inside the zones, numbered column by column; the grid bounds the one partition of numbers."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(40)))
    grid = spark.range(41).withColumnRenamed("id", "i").withColumn("j", steps).select("i", "j", (F.col("i") * 250).cast("double").alias("x"), (F.col("j") * 250).cast("double").alias("y"), (F.col("i") * 41 + F.col("j")).alias("k"))
    z = entity(spark, sf_dir, "zone")
    xy = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    edges = spatial.rings_to_edges(z.select("zone", F.array(F.array(xy("x1", "y1"), xy("x2", "y1"), xy("x2", "y2"), xy("x1", "y2"))).alias("rings")), "zone")
    inside = spatial.point_in_polygon(grid.select("k", "x", "y"), edges, "k", "zone").select("k").distinct()
    w = Window.orderBy("i", "j")
    return grid.join(inside, "k").select((F.row_number().over(w) - 1).cast("long").alias("grid_id"), "x", "y")


@query("road_diagnostic", POINTS + f"SELECT site, class, count(DISTINCT road) AS n, round(sum(0.01e0 * exp(-0.003e0 * {DISTANCE})), 6) AS s FROM site, point JOIN road USING (road) WHERE {DISTANCE} <= 1000 GROUP BY ALL")
def road_diagnostic(spark, sf_dir):
    """Classes of roads near each site: how many, and what a minor road of each point would add."""
    d = geo.planar(F.col("x"), F.col("y"), F.col("site_x"), F.col("site_y"))
    x = lambda df: F.col("site_x") if "site_x" in df.columns else F.col("x")
    y = lambda df: F.col("site_y") if "site_y" in df.columns else F.col("y")
    near = spatial.within(points(spark, sf_dir), entity(spark, sf_dir, "site"), x, y, (1000.0, 1000.0), d, 1000.0)
    near = near.join(entity(spark, sf_dir, "road").select("road", "class"), "road")
    return near.groupBy("site", "class").agg(F.countDistinct("road").alias("n"), F.round(F.sum(F.lit(0.01) * F.exp(-E.DECAY * F.col("distance"))), 6).alias("s"))


@query("road_types_near", WEIGHTED + f"""SELECT site, class, weight IS NULL AS excluded, count(*) AS n, count_if(d <= 500) AS n_500, round(avg(len), 4) AS mean_length, round(sum(0.01e0 * exp(-0.003e0 * d)), 6) AS most
FROM (SELECT site, class, weight, len, {SNAP} (SELECT site, site_x AS x, site_y AS y FROM site), weighted)) WHERE d <= 1000 GROUP BY ALL""")
def road_types_near(spark, sf_dir):
    """Roads within 1000 m of each site by class: whether the analysis leaves the class out, how many, how long, and what they would add as minor roads."""
    sites = entity(spark, sf_dir, "site").select("site", F.col("site_x").alias("x"), F.col("site_y").alias("y"))
    near = snapped(spark, sf_dir, sites, "site", 1000.0).withColumn("excluded", F.col("weight").isNull())
    most = F.sum(F.lit(0.01) * F.exp(-E.DECAY * F.col("distance")))
    return near.groupBy("site", "class", "excluded").agg(F.count("*").alias("n"), F.count_if(F.col("distance") <= 500).alias("n_500"), F.round(F.avg("len"), 4).alias("mean_length"), F.round(most, 6).alias("most"))
