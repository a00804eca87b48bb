"""Queries on masks, windows of rasters, surfaces of single sites, tags of nodes and checks of inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import exposure as E
from ..operators import network as N
from ..operators import shapes, spatial, tables
from ..operators.cut import cut
from ..sources import inputs, readers
from .adapters import entity, sql
from .exposure import CELLS, LAND, land, raster
from .network import FLOWS, PATHS, SNAPS, changes, ways
from .registry import query, table


@query("other_race", """SELECT n_nationkey, greatest(0, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END, 0) + (n_nationkey % 4) - 6) AS other FROM nation""")
def other_race(spark, sf_dir):
    """What is left after the listed groups, not below 0; missing counts are 0."""
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS one", "n_nationkey % 4 AS two")
    return rows.select("n_nationkey", F.greatest(F.lit(0), F.coalesce("one", F.lit(0)) + F.col("two") - 6).alias("other"))


@query("children_counts", """SELECT c_nationkey AS bg, CAST(sum(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) + sum(CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS young, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1""")
def children_counts(spark, sf_dir):
    by = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("bg"))
    return by.agg((F.count_if(F.expr("c_custkey % 4 = 0")) + F.count_if(F.expr("c_custkey % 4 = 1"))).alias("young"), F.count("*").alias("n"))


@query("bbox_filter", sql("parcel") + "SELECT parcel FROM parcel WHERE x1 <= 4000 AND x2 >= 2000 AND y1 <= 5000 AND y2 >= 3000")
def bbox_filter(spark, sf_dir):
    """Parcels whose box meets a box."""
    meets = (F.col("x1") <= 4000) & (F.col("x2") >= 2000) & (F.col("y1") <= 5000) & (F.col("y2") >= 3000)
    return entity(spark, sf_dir, "parcel").where(meets).select("parcel")


@query("intersection_tags", sql("facility", "station") + """SELECT facility, CASE WHEN facility % 6 = 0 THEN 'kept' ELSE station_tag END AS tag FROM facility LEFT JOIN (
SELECT facility, 'signal-' || CAST(station AS VARCHAR) AS station_tag FROM (SELECT f.facility, s.station, sqrt((f.x - s.x) ** 2 + (f.y - s.y) ** 2) AS d FROM facility f, station s) WHERE d <= 250
QUALIFY row_number() OVER (PARTITION BY facility ORDER BY round(d, 6), station) = 1) USING (facility)""")
def intersection_tags(spark, sf_dir):
    """Tags of nodes: their own where they have one, else that of the nearest mapped control within reach."""
    nodes = entity(spark, sf_dir, "facility").select("facility", "x", "y", F.when(F.col("facility") % 6 == 0, F.lit("kept")).alias("own"))
    controls = entity(spark, sf_dir, "station").select("station", F.col("x").alias("site_x"), F.col("y").alias("site_y"))
    away = lambda s: geo.planar(F.col("x"), F.col("y"), s["site_x"], s["site_y"])
    near = lambda s: F.when(away(s) <= 250, F.round(away(s), 6))
    at, site_at = (F.col("x"), F.col("y")), (F.col("site_x"), F.col("site_y"))
    found = spatial.nearest(nodes, controls, near, ["station", "site_x", "site_y"], "station", at, site_at, (251.0, 251.0, 251.0), 250.0)
    return found.select("facility", F.coalesce("own", F.concat(F.lit("signal-"), F.col("nearest.station"))).alias("tag"))


@query("raster_window", LAND + "SELECT row, col, class FROM land WHERE row BETWEEN 20 AND 60 AND col BETWEEN 10 AND 70 AND class > 0 AND row % 3 = 0 AND col % 3 = 0")
def raster_window(spark, sf_dir):
    return readers.raster_window(land(spark, sf_dir), (20, 60), (10, 70), 3)


_CELL = "(col + 0.5e0) * (10007e0 / 40)", "(row + 0.5e0) * (10009e0 / 40)"
_OUTSIDE = f"sqrt(greatest(bx1 - {_CELL[0]}, 0, {_CELL[0]} - bx2) ** 2 + greatest(by1 - {_CELL[1]}, 0, {_CELL[1]} - by2) ** 2)"


@query("district_mask", CELLS + ", box AS (" + sql("zone") + f"""SELECT x1 AS bx1, y1 AS by1, x2 AS bx2, (y1 + y2) / 2 AS by2 FROM zone WHERE zone IN (0, 3) UNION ALL SELECT x1, (y1 + y2) / 2, (x1 + x2) / 2, y2 FROM zone WHERE zone IN (0, 3))
SELECT row, col, value FROM cells WHERE EXISTS (SELECT 1 FROM box WHERE {_OUTSIDE} <= 300)""")
def district_mask(spark, sf_dir):
    """Raster cells whose centre is within 300 m of the district: two zones with a corner cut out."""
    xy = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    xm, ym = (x1 + x2) / 2, (y1 + y2) / 2
    ring = F.array(xy(x1, y1), xy(x2, y1), xy(x2, ym), xy(xm, ym), xy(xm, y2), xy(x1, y2))
    district = spatial.rings_to_edges(entity(spark, sf_dir, "zone").where("zone IN (0, 3)").select("zone", F.array(ring).alias("rings")), "zone")
    cells = raster(spark, sf_dir).withColumn("cell", F.col("row") * 40 + F.col("col"))
    centres = cells.select("cell", ((F.col("col") + 0.5) * (10007 / 40)).alias("x"), ((F.col("row") + 0.5) * (10009 / 40)).alias("y"))
    near = shapes.point_distance(district, centres, "zone", "cell", 300.0, 500.0)
    return cells.join(near, "cell", "left_semi").select("row", "col", "value")


@query("population_mask", sql("facility", "parcel") + """, cells AS (SELECT CAST(least(greatest(floor(y / (10009e0 / 40)), 0), 39) AS BIGINT) AS row, CAST(least(greatest(floor(x / (10007e0 / 40)), 0), 39) AS BIGINT) AS col, min(capacity) AS value FROM facility GROUP BY ALL)
SELECT row, col, value FROM cells WHERE EXISTS (SELECT 1 FROM parcel WHERE x1 <= (col + 1) * 10007e0 / 40 AND x2 >= col * 10007e0 / 40 AND y1 <= (row + 1) * 10009e0 / 40 AND y2 >= row * 10009e0 / 40)""")
def population_mask(spark, sf_dir):
    """Raster cells that a parcel touches."""
    w, h = 10007 / 40, 10009 / 40
    span = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    touched = entity(spark, sf_dir, "parcel").withColumn("col", span("x1", "x2", w)).select("y1", "y2", "col").withColumn("row", span("y1", "y2", h)).select("row", "col").distinct()
    cells = E.rasterized_least(entity(spark, sf_dir, "facility"), "capacity", (0.0, 0.0, 10007.0, 10009.0), 40, 40)
    return cells.join(touched, ["row", "col"], "left_semi")


@query("per_site_grids", PATHS + SNAPS + """, facility AS (SELECT c_custkey AS pixel, (c_custkey * 7919) % 10007 AS x, (c_custkey * 104729) % 10009 AS y FROM customer)
SELECT site, CAST(floor(y / 1001e0) AS BIGINT) AS row, CAST(floor(x / 1001e0) AS BIGINT) AS col, round(min(time), 6) AS time FROM times JOIN facility USING (pixel) GROUP BY ALL""")
def per_site_grids(spark, sf_dir):
    """The least time of each cell to each site."""
    where = entity(spark, sf_dir, "facility").select(F.col("facility").alias("pixel"), F.floor(F.col("y") / 1001).alias("row"), F.floor(F.col("x") / 1001).alias("col"))
    to = ways(spark, sf_dir).select("pixel", "ways").join(where, "pixel")
    return N.times_of(to, "row", "col").groupBy("site", "row", "col").agg(F.round(F.min("time"), 6).alias("time"))


@query("significant_edges", FLOWS + """SELECT count(*) AS n, CAST(max(abs(d)) AS BIGINT) AS peak FROM (SELECT coalesce(b.amount, 0) - coalesce(a.amount, 0) AS d FROM (SELECT * FROM flow WHERE scenario = 'baseline') a FULL JOIN (SELECT * FROM flow WHERE scenario = 'close_0') b USING (u, v)) WHERE abs(d) >= 3""")
def significant_edges(spark, sf_dir):
    """How many edges a closure changes by three or more, and the largest change."""
    return changes(spark, sf_dir, "close_0").select(F.abs("diff").alias("d")).where("d >= 3").agg(F.count("*").alias("n"), F.max("d").alias("peak"))


@query("walk_zone_mask", sql("facility", "zone") + """SELECT facility FROM facility WHERE NOT EXISTS (SELECT 1 FROM zone WHERE zone IN (0, 2) AND x >= x1 AND x < x2 AND y >= y1 AND y < y2)""")
def walk_zone_mask(spark, sf_dir):
    """Facilities outside the walk zones of the open sites."""
    xy = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    walk = entity(spark, sf_dir, "zone").where("zone IN (0, 2)")
    edges = spatial.rings_to_edges(walk.select("zone", F.array(F.array(xy("x1", "y1"), xy("x2", "y1"), xy("x2", "y2"), xy("x1", "y2"))).alias("rings")), "zone")
    rows = entity(spark, sf_dir, "facility")
    return rows.select("facility").join(spatial.point_in_polygon(rows.select("facility", "x", "y"), edges, "facility", "zone"), "facility", "left_anti")


@query("model_inputs", """SELECT count(*) AS n, count_if(bad) > 0 AS any_dropped, round(sum(w) FILTER (NOT bad), 6) AS weight FROM (SELECT c_custkey, c_custkey % 13 / 13e0 AS w, c_custkey % 13 = 0 OR c_nationkey > 20 AS bad FROM customer)""")
def model_inputs(spark, sf_dir):
    """Checks before a model: fragments without weight or of unknown zones go, and whether any did."""
    known = table(spark, sf_dir, "nation").where("n_nationkey <= 20").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("known"))
    rows = table(spark, sf_dir, "customer").withColumn("w", F.col("c_custkey") % 13 / 13.0).join(known, "c_nationkey", "left")
    good = F.coalesce("known", F.lit(False)) & (F.col("w") > 1e-6)
    return rows.agg(F.count("*").alias("n"), (F.count_if(~good) > 0).alias("any_dropped"), F.round(F.sum(F.when(good, F.col("w"))), 6).alias("weight"))


_ZONES = {f"zone {i}": f"School {i}" for i in range(1, 11)}
_PUPILS = "count_if(o_orderdate < DATE '1995-01-01') AS old, count_if(o_orderdate >= DATE '1995-01-01') AS new"


@query("enrolment_inputs", f"""SELECT school, students, fragments, weight FROM (SELECT 'School ' || CAST(o_custkey % 10 + 1 AS VARCHAR) AS school, CAST(count_if(o_orderdate >= DATE '1995-01-01') AS BIGINT) AS students FROM orders GROUP BY 1)
JOIN (SELECT 'School ' || CAST(c_custkey % 11 AS VARCHAR) AS school, count(*) AS fragments, round(sum(c_custkey % 13 / 13e0), 6) AS weight FROM customer WHERE c_custkey % 11 > 0 AND c_custkey % 13 > 0 GROUP BY 1) USING (school)""")
def enrolment_inputs(spark, sf_dir):
    """Students of the year and fragments of each school under its canonical name, all checks passed; the total's row is told from the schools'."""
    by = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("school no. "), F.expr("o_custkey % 10 + 1")).alias("name")).agg(*[F.expr(e) for e in _PUPILS.split(", ")])
    counts = cut(by.unionByName(by.agg(F.lit("Total").alias("name"), F.sum("old").alias("old"), F.sum("new").alias("new"))))
    total = counts.where("name = 'Total'").first()["new"]
    fragments = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("zone "), F.expr("c_custkey % 11")).alias("zone"), (F.col("c_custkey") % 13 / 13.0).alias("weight"))
    names = list(_ZONES.values())
    kept, students = inputs.enrolment_inputs(fragments, _ZONES, counts, {f"school no. {i}": f"School {i}" for i in range(1, 11)}, "new", "Total", names, names, total)
    sums = kept.groupBy("school").agg(F.count("*").alias("fragments"), F.round(F.sum("weight"), 6).alias("weight"))
    return students.join(sums, "school").select("school", "students", "fragments", "weight")


@query("sorted_capacity", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS capacity, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END ASC NULLS LAST, c_custkey) AS place FROM customer""")
def sorted_capacity(spark, sf_dir):
    """Places by capacity within a nation, unknown ones last."""
    rows = table(spark, sf_dir, "customer").withColumn("capacity", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))
    rows = rows.withColumns({"unknown": F.col("capacity").isNull(), "nation": F.col("c_nationkey")})
    return tables.placed_within(rows, ["nation"], ["unknown", "capacity", "c_custkey"], "place").select("c_custkey", "capacity", "place")


@query("tile_union", sql("parcel") + "SELECT DISTINCT parcel, x1, y1 FROM parcel WHERE x1 < 6000")
def tile_union(spark, sf_dir):
    """Overlapping tiles as one table, what several hold once."""
    rows = entity(spark, sf_dir, "parcel").select("parcel", "x1", "y1")
    return readers.mosaic([rows.where("x1 < 3000"), rows.where("x1 BETWEEN 2500 AND 4500"), rows.where("x1 >= 4000 AND x1 < 6000")], ["parcel"])


@query("crosswalk", """SELECT name, n FROM (SELECT CASE n_nationkey WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East' END AS name, n_nationkey FROM nation) JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey WHERE name IS NOT NULL
UNION ALL SELECT 'Nowhere', 0""")
def crosswalk(spark, sf_dir):
    """Counts under the canonical names of a crosswalk; a canonical name that no row has gets 0."""
    by = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("school "), F.col("n_nationkey")).alias("raw")).join(by, "n_nationkey")
    found, missing = readers.known_names(rows, {"school 0": "North", "school 1": "South", "school 2": "East", "school 9999": "Nowhere"}, "raw", "n_nationkey")
    return found.select(F.col("canonical").alias("name"), "n").unionByName(missing.select(F.col("canonical").alias("name"), F.lit(0).cast("long").alias("n")))
