"""Queries on zones: points in them, parts of block groups, blocks, pixels and dots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.clean import flood_class, guarded_percent
from ..operators import interpolate as I
from ..operators import profile, shapes, simplify, spatial, tables, voronoi
from ..operators.cut import cut
from ..sources import readers
from .adapters import entity, sql
from .registry import query

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CELL = 1000.0
#: The cells in which shapes meet.
SIDE = 500.0

COUNTED = sql("block_group", "zone", "parcel") + """, census AS (SELECT CAST(c_nationkey AS BIGINT) AS bg, count(*) AS population, CAST(count_if(c_mktsegment = 'AUTOMOBILE') AS BIGINT) AS a, CAST(count_if(c_mktsegment = 'BUILDING') AS BIGINT) AS b,
  round(avg(c_acctbal), 4) AS income FROM customer GROUP BY 1),
res AS (SELECT * FROM parcel WHERE coalesce(luc, '') SIMILAR TO '(100|110|120|630|EXHA|EXED).*'),
frag AS (SELECT zone, bg, greatest(z.x1, g.x1) AS x1, greatest(z.y1, g.y1) AS y1, least(z.x2, g.x2) AS x2, least(z.y2, g.y2) AS y2, (g.x2 - g.x1) * (g.y2 - g.y1) AS whole FROM zone z, block_group g
  WHERE least(z.x2, g.x2) > greatest(z.x1, g.x1) AND least(z.y2, g.y2) > greatest(z.y1, g.y1)),
fr AS (SELECT f.zone, f.bg, any_value((f.x2 - f.x1) * (f.y2 - f.y1)) AS area, any_value(whole) AS whole, coalesce(sum((least(f.x2, p.x2) - greatest(f.x1, p.x1)) * (least(f.y2, p.y2) - greatest(f.y1, p.y1))) FILTER (p.parcel IS NOT NULL), 0) AS r
  FROM frag f LEFT JOIN res p ON least(f.x2, p.x2) > greatest(f.x1, p.x1) AND least(f.y2, p.y2) > greatest(f.y1, p.y1) GROUP BY ALL),
gr AS (SELECT g.bg, coalesce(sum((least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1))) FILTER (p.parcel IS NOT NULL), 0) AS t
  FROM block_group g LEFT JOIN res p ON least(g.x2, p.x2) > greatest(g.x1, p.x1) AND least(g.y2, p.y2) > greatest(g.y1, p.y1) GROUP BY ALL),
parts AS (SELECT zone, bg, area, least(area / whole, 1e0) AS weight_area, CASE WHEN t > 0 THEN least(r / t, 1e0) ELSE least(area / whole, 1e0) END AS weight FROM fr JOIN gr USING (bg))
"""


def census(spark, sf_dir):
    by = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").cast("long").alias("bg"))
    return by.agg(
        F.count("*").alias("population"), F.count_if(F.col("c_mktsegment") == "AUTOMOBILE").alias("a"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("b"),
        F.round(F.avg("c_acctbal"), 4).alias("income"),
    )


def homes(spark, sf_dir):
    return entity(spark, sf_dir, "parcel").where(F.coalesce("luc", F.lit("")).rlike("^(100|110|120|630|EXHA|EXED)"))


def fragments(spark, sf_dir):
    return I.fragments(entity(spark, sf_dir, "zone"), entity(spark, sf_dir, "block_group"), homes(spark, sf_dir), CELL)


@query("rect_overlay", sql("block_group", "zone") + """SELECT zone, bg, round((least(z.x2, g.x2) - greatest(z.x1, g.x1)) * (least(z.y2, g.y2) - greatest(z.y1, g.y1)), 4) AS area FROM zone z, block_group g
WHERE least(z.x2, g.x2) > greatest(z.x1, g.x1) AND least(z.y2, g.y2) > greatest(z.y1, g.y1)""")
def rect_overlay(spark, sf_dir):
    a, b = I._corners(entity(spark, sf_dir, "zone"), "a"), I._corners(entity(spark, sf_dir, "block_group"), "b")
    return spatial.overlay(a, b, CELL).select("zone", "bg", F.round("area", 4).alias("area"))


@query("residential_area", COUNTED + "SELECT bg, round(t, 4) AS residential FROM gr")
def residential_area(spark, sf_dir):
    out = I.residential_area(entity(spark, sf_dir, "block_group"), "bg", homes(spark, sf_dir), CELL)
    return out.withColumn("residential", F.round("residential", 4))


@query("fragment_weights", COUNTED + "SELECT zone, bg, round(weight_area, 6) AS weight_area, round(weight, 6) AS weight FROM parts")
def fragment_weights(spark, sf_dir):
    return fragments(spark, sf_dir).select("zone", "bg", F.round("weight_area", 6).alias("weight_area"), F.round("weight", 6).alias("weight"))


@query("zone_demographics", COUNTED + """SELECT zone, round(sum(population * weight), 4) AS population, round(sum(a * weight), 4) AS a, round(sum(b * weight), 4) AS b,
round(sum(CASE WHEN income > 0 THEN weight * population * income END) / sum(CASE WHEN income > 0 THEN weight * population END), 4) AS income,
round(CASE WHEN sum(population * weight) > 0 THEN sum(a * weight) / sum(population * weight) * 100 ELSE 0 END, 4) AS pct_a FROM parts JOIN census USING (bg) GROUP BY zone""")
def zone_demographics(spark, sf_dir):
    sums = I.zone_sums(fragments(spark, sf_dir), census(spark, sf_dir), ["population", "a", "b"], "income")
    out = I.derived_metrics(sums, {"pct_a": (F.col("a"), F.col("population"))})
    return out.select("zone", *[F.round(c, 4).alias(c) for c in ("population", "a", "b", "income", "pct_a")])


@query("conservation", COUNTED + """SELECT round(abs(s - t) / t, 6) AS error, abs(s - t) / t > 0.01 AS broken FROM (SELECT (SELECT sum(population * weight) FROM parts JOIN census USING (bg)) AS s, (SELECT CAST(sum(population) AS DOUBLE) FROM census) AS t)""")
def conservation(spark, sf_dir):
    """How far the zones' population is from the source's."""
    c = census(spark, sf_dir)
    placed = fragments(spark, sf_dir).join(c, "bg").agg(F.sum(F.col("population") * F.col("weight")).alias("s"))
    both = placed.crossJoin(F.broadcast(c.agg(F.sum("population").alias("t"))))  # a row each
    error = F.abs(F.col("s") - F.col("t")) / F.col("t")
    return both.select(F.round(error, 6).alias("error"), (error > 0.01).alias("broken"))


@query("derived_metrics", """SELECT c_nationkey, round(CASE WHEN count_if(c_acctbal > 5000) > 0 THEN count_if(c_acctbal > 5000 AND c_mktsegment = 'BUILDING') / CAST(count_if(c_acctbal > 5000) AS DOUBLE) * 100 ELSE 0 END, 4) AS pct_building,
round((1 - count_if(c_mktsegment = 'MACHINERY') / CAST(count(*) AS DOUBLE)) * 100, 4) AS pct_other FROM customer GROUP BY 1""")
def derived_metrics(spark, sf_dir):
    rich = F.col("c_acctbal") > 5000
    by = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey")
    rows = by.agg(F.count_if(rich).alias("n"), F.count_if(rich & (F.col("c_mktsegment") == "BUILDING")).alias("b"), F.count("*").alias("total"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("m"))
    out = I.derived_metrics(rows, {"pct_building": (F.col("b"), F.col("n")), "pct_other": (F.col("total") - F.col("m"), F.col("total"))})
    return out.select("c_nationkey", F.round("pct_building", 4).alias("pct_building"), F.round("pct_other", 4).alias("pct_other"))


BLOCKS = """, block AS (SELECT bg, q, bg * 4 + q AS block, x1 + (q % 2) * 1000 AS x1, y1 + CAST(floor(q / 2e0) AS BIGINT) * 1000 AS y1, x1 + (q % 2) * 1000 + 1000 AS x2, y1 + CAST(floor(q / 2e0) AS BIGINT) * 1000 + 1000 AS y2 FROM block_group, range(4) r(q)),
br AS (SELECT b.block, b.bg, coalesce(sum((least(b.x2, p.x2) - greatest(b.x1, p.x1)) * (least(b.y2, p.y2) - greatest(b.y1, p.y1))) FILTER (p.parcel IS NOT NULL), 0) AS r
  FROM block b LEFT JOIN res p ON least(b.x2, p.x2) > greatest(b.x1, p.x1) AND least(b.y2, p.y2) > greatest(b.y1, p.y1) GROUP BY ALL),
shares AS (SELECT block, bg, CASE WHEN sum(r) OVER w > 0 THEN least(r / sum(r) OVER w, 1) ELSE 0.25 END AS share FROM br WINDOW w AS (PARTITION BY bg))
"""


def blocks(spark, sf_dir):
    q = F.explode(F.sequence(F.lit(0), F.lit(3)))
    rows = entity(spark, sf_dir, "block_group").select("bg", "x1", "y1", q.alias("q"))
    x, y = F.col("x1") + F.col("q") % 2 * 1000, F.col("y1") + F.floor(F.col("q") / 2) * 1000
    return rows.select("bg", (F.col("bg") * 4 + F.col("q")).alias("block"), x.alias("x1"), y.alias("y1"), (x + 1000).alias("x2"), (y + 1000).alias("y2"))


def downscaled(spark, sf_dir):
    b = blocks(spark, sf_dir)
    rows = b.join(I.residential_area(b, "block", homes(spark, sf_dir), CELL), "block").withColumn("area", F.lit(1e6))
    return I.downscale(rows, census(spark, sf_dir), "bg", ["population", "a", "b"])


@query("downscale_blocks", COUNTED + BLOCKS + "SELECT block, bg, round(coalesce(population, 0) * share, 4) AS population, round(coalesce(a, 0) * share, 4) AS a FROM shares LEFT JOIN census USING (bg)")
def downscale_blocks(spark, sf_dir):
    return downscaled(spark, sf_dir).select("block", "bg", F.round("population", 4).alias("population"), F.round("a", 4).alias("a"))


@query("pixel_children", COUNTED + BLOCKS + """, pixel AS (SELECT px * 25 + py AS pixel, px * 400 + 150 AS x1, py * 400 + 150 AS y1, px * 400 + 550 AS x2, py * 400 + 550 AS y2 FROM range(24) a(px), range(24) b(py))
SELECT pixel, round(sum(coalesce(a, 0) * share * (least(p.x2, k.x2) - greatest(p.x1, k.x1)) * (least(p.y2, k.y2) - greatest(p.y1, k.y1)) / 1e6), 4) AS children
FROM pixel p JOIN block k ON least(p.x2, k.x2) > greatest(p.x1, k.x1) AND least(p.y2, k.y2) > greatest(p.y1, k.y1) JOIN shares s USING (block) LEFT JOIN census c ON c.bg = s.bg GROUP BY pixel""")
def pixel_children(spark, sf_dir):
    """Children of blocks spread over 400 m pixels by area."""
    n = lambda name: spark.range(24).withColumnRenamed("id", name)
    grid = n("px").withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(23))))
    side = lambda c, d: (F.col(c) * 400 + d).cast("double")
    pixels = grid.select((F.col("px") * 25 + F.col("py")).alias("pixel"), side("px", 150).alias("ax1"), side("py", 150).alias("ay1"), side("px", 550).alias("ax2"), side("py", 550).alias("ay2"))
    met = spatial.overlay(pixels, I._corners(downscaled(spark, sf_dir).select("a", "x1", "y1", "x2", "y2"), "b"), CELL)
    return met.groupBy("pixel").agg(F.round(F.sum(F.col("a") * F.col("area") / 1e6), 4).alias("children"))


@query("income_distribution", COUNTED + """, t AS (SELECT zone, unnest(['a', 'b']) AS bracket, unnest([sum(a * weight), sum(b * weight)]) AS n FROM parts JOIN census USING (bg) GROUP BY zone)
SELECT zone, bracket, round(n / sum(n) OVER (PARTITION BY zone) * 100, 4) AS pct FROM t""")
def income_distribution(spark, sf_dir):
    sums = I.zone_sums(fragments(spark, sf_dir), census(spark, sf_dir), ["population", "a", "b"], "income")
    long = sums.unpivot(["zone"], ["a", "b"], "bracket", "n")
    return long.select("zone", "bracket", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("zone")) * 100, 4).alias("pct"))


#: Forty-one counts of a block group: everyone, and five groups by eight ages; sixteen brackets of income.
AGES, BRACKETS = 8, 16
COUNTS = {"everyone": "true", **{f"{s.lower()}_{k}": f"c_mktsegment = '{s}' AND c_custkey % {AGES} = {k}" for s in SEGMENTS for k in range(AGES)}}
INCOMES = {f"bracket_{k}": f"c_acctbal >= {k * 700 - 1000} AND c_acctbal < {k * 700 - 300}" for k in range(BRACKETS)}


def _counted(counts: dict[str, str]) -> str:
    return f", many AS (SELECT CAST(c_nationkey AS BIGINT) AS bg, {', '.join(f'CAST(count_if({c}) AS BIGINT) AS {n}' for n, c in counts.items())} FROM customer GROUP BY 1)"


def counted(spark, sf_dir, counts: dict[str, str]):
    by = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").cast("long").alias("bg"))
    return by.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in counts.items()])


@query("zone_counts", COUNTED + _counted(COUNTS) + f"SELECT zone, {', '.join(f'round(sum({n} * weight), 4) AS {n}' for n in COUNTS)} FROM parts JOIN many USING (bg) GROUP BY zone")
def zone_counts(spark, sf_dir):
    """All forty-one counts of zones, weighed by the homes in each part of a block group."""
    weighed = fragments(spark, sf_dir).join(counted(spark, sf_dir, COUNTS), "bg")
    return weighed.groupBy("zone").agg(*[F.round(F.sum(F.col(n) * F.col("weight")), 4).alias(n) for n in COUNTS])


@query("income_brackets", COUNTED + _counted(INCOMES) + f""", t AS (SELECT zone, unnest({list(INCOMES)}) AS bracket, unnest([{', '.join(f'sum({n} * weight)' for n in INCOMES)}]) AS n FROM parts JOIN many USING (bg) GROUP BY zone)
SELECT zone, bracket, round(n, 4) AS n, round(CASE WHEN sum(n) OVER (PARTITION BY zone) > 0 THEN n / sum(n) OVER (PARTITION BY zone) * 100 ELSE 0 END, 4) AS pct FROM t""")
def income_brackets(spark, sf_dir):
    """How the households of each zone are spread over sixteen brackets."""
    weighed = fragments(spark, sf_dir).join(counted(spark, sf_dir, INCOMES), "bg")
    sums = weighed.groupBy("zone").agg(*[F.sum(F.col(n) * F.col("weight")).alias(n) for n in INCOMES])
    long = sums.unpivot(["zone"], list(INCOMES), "bracket", "n").withColumn("whole", F.sum("n").over(Window.partitionBy("zone")))
    return long.select("zone", "bracket", F.round("n", 4).alias("n"), F.round(guarded_percent(F.col("n"), F.col("whole")), 4).alias("pct"))


POINTS = sql("zone", "sale", "development", "facility", "parcel")


def in_zones(spark, sf_dir, name: str, key: str):
    """Rows of an entity with the first zone around them; zones are polygons here, given by their edges."""
    rows = entity(spark, sf_dir, name)
    xy = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(xy("x1", "y1"), xy("x2", "y1"), xy("x2", "y2"), xy("x1", "y2"))
    edges = spatial.rings_to_edges(entity(spark, sf_dir, "zone").select("zone", F.array(ring).alias("rings")), "zone")
    found = spatial.point_in_polygon(rows.select(key, "x", "y"), edges, key, "zone")
    return rows.join(spatial.first_match(found, key, "zone"), key)


INSIDE = "x >= x1 AND x < x2 AND y >= y1 AND y < y2"


@query("pip_attribution", POINTS + f"SELECT facility, min(zone) AS zone FROM facility JOIN zone ON {INSIDE} GROUP BY facility")
def pip_attribution(spark, sf_dir):
    return in_zones(spark, sf_dir, "facility", "facility").select("facility", "zone")


@query("zone_sales_stats", POINTS + f"SELECT zone, count(*) AS n, round(median(price), 4) AS median_price, round(median(price / 100), 4) AS median_unit FROM (SELECT sale, price, min(zone) AS zone FROM sale JOIN zone ON {INSIDE} GROUP BY ALL) GROUP BY zone")
def zone_sales_stats(spark, sf_dir):
    rows = cut(in_zones(spark, sf_dir, "sale", "sale").select("zone", "price", (F.col("price") / 100).alias("unit")))
    counts = rows.groupBy("zone").agg(F.count("*").alias("n"))
    return counts.join(profile.quantiles(rows, "price", ["zone"], {"median_price": 0.5}, 4), "zone").join(profile.quantiles(rows, "unit", ["zone"], {"median_unit": 0.5}, 4), "zone")


@query("zone_dev_sums", POINTS + f"SELECT zone, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, CAST(sum(students) AS BIGINT) AS students FROM (SELECT development, units, students, min(zone) AS zone FROM development JOIN zone ON {INSIDE} GROUP BY ALL) GROUP BY zone")
def zone_dev_sums(spark, sf_dir):
    by = in_zones(spark, sf_dir, "development", "development").groupBy("zone")
    return by.agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.sum("students").alias("students"))


@query("zone_bedrooms", POINTS + f"SELECT zone, students AS bedrooms, count(*) AS n FROM (SELECT development, students, min(zone) AS zone FROM development JOIN zone ON {INSIDE} GROUP BY ALL) GROUP BY ALL")
def zone_bedrooms(spark, sf_dir):
    """The bedrooms of a zone's developments: each number and how often it occurs, which is the list without its length."""
    by = in_zones(spark, sf_dir, "development", "development").groupBy("zone", F.col("students").alias("bedrooms"))
    return by.agg(F.count("*").alias("n"))


@query("contains_or_nearest", sql("site", "zone") + """SELECT site, coalesce(min(CASE WHEN site_x >= x1 AND site_x < x2 AND site_y >= y1 AND site_y < y2 THEN zone END), arg_min(zone, sqrt((site_x - (x1 + x2) / 2) ** 2 + (site_y - (y1 + y2) / 2) ** 2))) AS zone,
bool_or(site_x >= x1 AND site_x < x2 AND site_y >= y1 AND site_y < y2) AS inside FROM site, zone GROUP BY site""")
def contains_or_nearest(spark, sf_dir):
    """The zone around a site, or the one of the nearest centre."""
    packed = entity(spark, sf_dir, "zone").agg(F.sort_array(F.collect_list(F.struct("zone", "x1", "y1", "x2", "y2"))).alias("z"))
    rows = entity(spark, sf_dir, "site").crossJoin(F.broadcast(packed))  # a few zones in one row
    x, y = F.col("site_x"), F.col("site_y")
    holds = lambda z: (x >= z["x1"]) & (x < z["x2"]) & (y >= z["y1"]) & (y < z["y2"])
    far = lambda z: F.struct(F.sqrt(F.pow(x - (z["x1"] + z["x2"]) / 2, 2) + F.pow(y - (z["y1"] + z["y2"]) / 2, 2)).alias("d"), z["zone"].alias("zone"))
    held = F.filter("z", holds)
    return rows.select("site", F.coalesce(F.get(held, F.lit(0))["zone"], F.array_min(F.transform("z", far))["zone"]).alias("zone"), (F.size(held) > 0).alias("inside"))


@query("flood_overlap", sql("parcel") + """, flood AS (SELECT CAST(x * 500 AS DOUBLE) AS fx1, CAST(y * 500 AS DOUBLE) AS fy1, x * 500e0 + 200 AS fx2, y * 500e0 + 200 AS fy2, CASE WHEN (x + y) % 3 = 0 THEN 'AE' ELSE 'X' END AS z, CASE WHEN (x + y) % 3 = 1 THEN '0.2 PCT ANNUAL' END AS s FROM range(20) a(x), range(20) b(y))
SELECT parcel, class, round(sum((least(x2, fx2) - greatest(x1, fx1)) * (least(y2, fy2) - greatest(y1, fy1))) / 4046.86, 2) AS acres, round(sum((least(x2, fx2) - greatest(x1, fx1)) * (least(y2, fy2) - greatest(y1, fy1))) / any_value((x2 - x1) * (y2 - y1)) * 100, 1) AS pct
FROM (SELECT *, CASE WHEN z IN ('A', 'AE', 'AO', 'AH') THEN 100 WHEN s ILIKE '%0.2 PCT%' THEN 500 END::INTEGER AS class FROM flood) JOIN parcel ON least(x2, fx2) > greatest(x1, fx1) AND least(y2, fy2) > greatest(y1, fy1) WHERE class IS NOT NULL GROUP BY ALL""")
def flood_overlap(spark, sf_dir):
    """Area and percent of parcels in flood zones of either class; the zones of a class do not overlap."""
    grid = spark.range(20).withColumnRenamed("id", "x").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(19))))
    zone, subtype = F.when((F.col("x") + F.col("y")) % 3 == 0, "AE").otherwise("X"), F.when((F.col("x") + F.col("y")) % 3 == 1, "0.2 PCT ANNUAL")
    side = lambda c, d: (F.col(c) * 500 + d).cast("double")
    flood = grid.select(flood_class(zone, subtype).alias("class"), side("x", 0).alias("bx1"), side("y", 0).alias("by1"), side("x", 200).alias("bx2"), side("y", 200).alias("by2")).where("class IS NOT NULL")
    met = spatial.overlay(I._corners(entity(spark, sf_dir, "parcel").select("parcel", "x1", "y1", "x2", "y2"), "a"), flood, 500.0)
    whole = (F.col("ax2") - F.col("ax1")) * (F.col("ay2") - F.col("ay1"))
    return met.groupBy("parcel", "class").agg(F.round(F.sum("area") / 4046.86, 2).alias("acres"), F.round(F.sum("area") / F.first(whole) * 100, 1).alias("pct"))


DOTTED = COUNTED + BLOCKS + ", counts AS (SELECT block, bg, unnest(['a', 'b']) AS category, CAST(floor(unnest([coalesce(a, 0) * share, coalesce(b, 0) * share]) / 2) AS BIGINT) AS n FROM shares LEFT JOIN census USING (bg)) "


@query("dot_counts", DOTTED + "SELECT block, category, n, n AS inside FROM counts WHERE n > 0")
def dot_counts(spark, sf_dir):
    """Dots of two people each by block, and how many of them lie inside it."""
    b = downscaled(spark, sf_dir)
    d = I.dots(b, ["a", "b"], 2, 10.0).join(b.select("block", "x1", "y1", "x2", "y2"), "block")
    return d.groupBy("block", "category").agg(F.count("*").alias("n"), F.count_if(F.expr("x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")).alias("inside"))


@query("parcel_dots", DOTTED + """, lived AS (SELECT block FROM block b JOIN res p ON least(b.x2, p.x2) > greatest(b.x1, p.x1) AND least(b.y2, p.y2) > greatest(b.y1, p.y1) AND imp_vac ILIKE '%improved%'
GROUP BY block HAVING sum((least(b.x2, p.x2) - greatest(b.x1, p.x1)) * (least(b.y2, p.y2) - greatest(b.y1, p.y1))) > 10)
SELECT block, category, n, n AS in_block, CASE WHEN block IN (SELECT block FROM lived) THEN n ELSE 0 END AS in_homes FROM counts WHERE n > 0""")
def parcel_dots(spark, sf_dir):
    """Dots of two people each on the built-up homes of a block, or anywhere in it where it has none: how many, in the block, and on homes."""
    b = downscaled(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.floor(F.col(c) / 2).cast("long").alias("n")) for c in "ab"]))
    built = homes(spark, sf_dir).where(F.col("imp_vac").ilike("%improved%"))
    places = I.placement(shapes.box_trapezoids(b, "block"), shapes.box_trapezoids(built, "parcel"), "block", "parcel", SIDE)
    dots = I.placed_dots(places, b.select("block", each.alias("e")).select("block", "e.*"), "block").withColumn("id", F.struct("block", "category", "dot"))
    dots = cut(dots)
    on_homes = spatial.point_in_polygon(dots.select("id", "x", "y"), boxed(built, "parcel"), "id", "parcel").select("id").distinct().withColumn("home", F.lit(True))
    met = dots.join(on_homes, "id", "left").join(b.select("block", "x1", "y1", "x2", "y2"), "block")
    inside = F.expr("x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")
    return met.groupBy("block", "category").agg(F.count("*").alias("n"), F.count_if(inside).alias("in_block"), F.count_if(inside & F.col("home")).alias("in_homes"))


@query("dot_zone_demo", DOTTED + """SELECT bg, CAST(sum(n) AS BIGINT) AS n_dots, CAST(sum(CASE WHEN category = 'a' THEN n ELSE 0 END) AS BIGINT) AS n_a, round(sum(n * income) / sum(n), 4) AS mean_income, CAST(floor(sum(n) / 2) AS BIGINT) AS young, CAST(sum(n) - floor(sum(n) / 2) AS BIGINT) AS old
FROM counts JOIN census USING (bg) WHERE n > 0 GROUP BY bg""")
def dot_zone_demo(spark, sf_dir):
    """Aggregates over dots by block group: counts, the mean of block values over dots, a split in halves."""
    b = downscaled(spark, sf_dir)
    d = I.dots(b, ["a", "b"], 2, 10.0).join(b.select("block", "bg"), "block").join(census(spark, sf_dir).select("bg", "income"), "bg")
    out = d.groupBy("bg").agg(F.count("*").alias("n_dots"), F.count_if(F.col("category") == "a").alias("n_a"), F.round(F.avg("income"), 4).alias("mean_income"))
    return out.withColumn("young", F.floor(F.col("n_dots") / 2)).withColumn("old", F.col("n_dots") - F.col("young"))


@query("dot_medians", DOTTED + """SELECT bg % 5 AS zone, count(*) AS n_dots, round(median(income), 4) AS median_income, round(quantile_cont(income, 0.25), 4) AS q25_income, round(avg(income), 4) AS mean_income
FROM (SELECT bg, unnest(range(n)) AS i FROM counts WHERE n > 0) JOIN census USING (bg) GROUP BY 1""")
def dot_medians(spark, sf_dir):
    """The median over a zone's dots of the income where they lie, by the number of dots and none of them made."""
    rows = downscaled(spark, sf_dir).select("bg", F.explode(F.array("a", "b")).alias("people")).select((F.col("bg") % 5).alias("zone"), "bg", F.floor(F.col("people") / 2).alias("n"))
    rows = rows.where("n > 0").join(census(spark, sf_dir).select("bg", "income"), "bg")
    sums = rows.groupBy("zone").agg(F.sum("n").alias("n_dots"), F.round(F.sum(F.col("n") * F.col("income")) / F.sum("n"), 4).alias("mean_income"))
    return sums.join(profile.quantiles(rows, "income", ["zone"], {"median_income": 0.5, "q25_income": 0.25}, digits=4, weight="n"), "zone")


@query("distinct_zone_columns", COUNTED + "SELECT bg, population, a, b, income, round(t, 4) AS residential FROM census JOIN gr USING (bg)")
def distinct_zone_columns(spark, sf_dir):
    """A profile supplemented with the columns it lacks."""
    more = I.residential_area(entity(spark, sf_dir, "block_group"), "bg", homes(spark, sf_dir), CELL).withColumn("residential", F.round("residential", 4))
    return tables.supplement(census(spark, sf_dir), more.withColumn("population", F.lit(0)), "bg")


def _xy(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def shaped(zones):
    """Edges of zones that lack their upper right quarter and have a hole in the lower left one."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    xm, ym = (x1 + x2) / 2, (y1 + y2) / 2
    outer = F.array(_xy(x1, y1), _xy(x2, y1), _xy(x2, ym), _xy(xm, ym), _xy(xm, y2), _xy(x1, y2))
    hole = F.array(_xy(x1 + 100, y1 + 100), _xy(x1 + 100, y1 + 700), _xy(x1 + 500, y1 + 700), _xy(x1 + 500, y1 + 100))
    return spatial.rings_to_edges(zones.select("zone", F.array(outer, hole).alias("rings")), "zone")


def boxed(rows, key: str):
    """Edges of rectangles."""
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    return spatial.rings_to_edges(rows.select(key, F.array(F.array(*[_xy(F.col(x), F.col(y)) for x, y in corners])).alias("rings")), key)


def _shared(a: str, *boxes: str) -> str:
    """The area, in SQL, that a rectangle (x1, y1, x2, y2 as given) shares with others."""
    x1, y1, x2, y2 = (f"{f}({', '.join([c, *[f'{b}.{n}' for b in boxes]])})" for f, c, n in zip(("greatest", "greatest", "least", "least"), a.split("|"), ("x1", "y1", "x2", "y2"), strict=True))
    return f"(greatest({x2} - {x1}, 0) * greatest({y2} - {y1}, 0))"


def _of_shape(*boxes: str) -> str:
    whole, corner, hole = "z.x1|z.y1|z.x2|z.y2", "(z.x1 + z.x2) / 2|(z.y1 + z.y2) / 2|z.x2|z.y2", "z.x1 + 100|z.y1 + 100|z.x1 + 500|z.y1 + 700"
    return f"({_shared(whole, *boxes)} - {_shared(corner, *boxes)} - {_shared(hole, *boxes)})"


@query("polygon_overlay", sql("block_group", "zone") + f"SELECT zone, bg, round(area, 4) AS area FROM (SELECT zone, bg, {_of_shape('g')} AS area FROM zone z, block_group g) WHERE area > 0")
def polygon_overlay(spark, sf_dir):
    """The parts of block groups in zones of any shape."""
    met = shapes.shared_area([(shaped(entity(spark, sf_dir, "zone")), "zone"), (boxed(entity(spark, sf_dir, "block_group"), "bg"), "bg")], SIDE)
    return met.select("zone", "bg", F.round("area", 4).alias("area"))


def fragment_trapezoids(spark, sf_dir):
    zones, groups = shapes.trapezoids(shaped(entity(spark, sf_dir, "zone")), "zone", SIDE), shapes.trapezoids(boxed(entity(spark, sf_dir, "block_group"), "bg"), "bg", SIDE)
    return shapes.intersect(zones, groups, ["zone"], ["bg"], SIDE)


#: The two rectangles that the outer ring of a shaped zone is made of.
_RECTANGLES = "(SELECT zone, x1, y1, x2, (y1 + y2) / 2 AS y2 FROM zone UNION ALL SELECT zone, x1, (y1 + y2) / 2, (x1 + x2) / 2, y2 FROM zone)"


@query("polygon_fragments", sql("block_group", "zone") + f"""SELECT zone, bg, round(any_value(area), 4) AS area, min(greatest(w.x1, g.x1)) AS x_min, max(least(w.x2, g.x2)) AS x_max, min(greatest(w.y1, g.y1)) AS y_min, max(least(w.y2, g.y2)) AS y_max
FROM (SELECT zone, bg, {_of_shape('g')} AS area FROM zone z, block_group g) JOIN {_RECTANGLES} w USING (zone) JOIN block_group g USING (bg) WHERE area > 0 AND w.x1 < g.x2 AND w.x2 > g.x1 AND w.y1 < g.y2 AND w.y2 > g.y1 GROUP BY ALL""")
def polygon_fragments(spark, sf_dir):
    """The parts of block groups in zones as rings: their area by the corners, and their extent."""
    parts = shapes.rings(shapes.outline(fragment_trapezoids(spark, sf_dir), ["zone", "bg"]), ["zone", "bg"])
    return told(parts, ["zone", "bg"])


def _coordinate(corners, c):
    return F.transform(corners, lambda p: p[c])


def told(parts, keys):
    corners = F.flatten("rings")
    ends = {f"{c}_{n}": f(_coordinate(corners, c)) for c in "xy" for n, f in (("min", F.array_min), ("max", F.array_max))}
    return parts.select(*keys, F.round(shapes.ring_area(F.col("rings")), 4).alias("area"), *(e.alias(n) for n, e in ends.items()))


@query("parcel_clip", sql("zone", "parcel") + f"SELECT zone, parcel, round(area, 4) AS area FROM (SELECT zone, parcel, {_of_shape('p')} AS area FROM zone z JOIN parcel p ON p.x1 < z.x2 AND p.x2 > z.x1 AND p.y1 < z.y2 AND p.y2 > z.y1) WHERE area > 0")
def parcel_clip(spark, sf_dir):
    """Parcels cut to zones with corners and holes, as rings."""
    zones = shapes.trapezoids(shaped(entity(spark, sf_dir, "zone")), "zone", SIDE)
    met = shapes.intersect(zones, shapes.box_trapezoids(entity(spark, sf_dir, "parcel"), "parcel"), ["zone"], ["parcel"], SIDE)
    return told(shapes.rings(shapes.outline(met, ["zone", "parcel"]), ["zone", "parcel"]), ["zone", "parcel"]).select("zone", "parcel", "area")


@query("valid_faces", sql("parcel") + "SELECT parcel, 2 AS n_rings, round((x2 - x1) * (y2 - y1) / 2, 4) AS area FROM parcel WHERE x2 > x1")
def valid_faces(spark, sf_dir):
    """Parcels whose ring was drawn across itself, as the faces that it has."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ring = F.array(_xy(x1, y1), _xy(x2, y2), _xy(x2, y1), _xy(x1, y2))
    edges = spatial.rings_to_edges(entity(spark, sf_dir, "parcel").select("parcel", F.array(ring).alias("rings")), "parcel")
    return shapes.valid(edges, "parcel", 500.0).select("parcel", F.size("rings").alias("n_rings"), F.round(shapes.ring_area(F.col("rings")), 4).alias("area"))


_GAP = "sqrt(pow(greatest(w.x1 - p.x2, p.x1 - w.x2, 0), 2) + pow(greatest(w.y1 - p.y2, p.y1 - w.y2, 0), 2))"


@query("polygon_distance", sql("zone", "parcel") + f"SELECT zone, parcel, round(min({_GAP}), 6) AS distance FROM {_RECTANGLES} w JOIN parcel p ON {_GAP} <= 150 GROUP BY ALL")
def polygon_distance(spark, sf_dir):
    """Parcels in a buffer of 150 m of zones with a corner cut out, with their distance."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    xm, ym = (x1 + x2) / 2, (y1 + y2) / 2
    ring = F.array(_xy(x1, y1), _xy(x2, y1), _xy(x2, ym), _xy(xm, ym), _xy(xm, y2), _xy(x1, y2))
    zones = spatial.rings_to_edges(entity(spark, sf_dir, "zone").select("zone", F.array(ring).alias("rings")), "zone")
    met = shapes.polygon_distance(zones, boxed(entity(spark, sf_dir, "parcel"), "parcel"), "zone", "parcel", 150.0, SIDE)
    return met.select("zone", "parcel", F.round("distance", 6).alias("distance"))


#: A point's own zone goes by the nearest facility; a quarter of the district's square is cut off.
DISTRICT = ("dx >= 1000 AND dx <= 9000 AND dy >= 1000 AND dy <= 9000 AND NOT (dx > 5000 AND dy > 5000)", [(1000, 1000), (9000, 1000), (9000, 5000), (5000, 5000), (5000, 9000), (1000, 9000)])


@query("nearest_zone_rings", sql("facility", "development") + f"""SELECT kind, count(*) AS n, CAST(sum(units) AS BIGINT) AS units FROM (SELECT units, kind FROM (SELECT development, units, x + 0.137e0 AS dx, y + 0.291e0 AS dy FROM development) d, facility
WHERE {DISTRICT[0]} QUALIFY row_number() OVER (PARTITION BY development ORDER BY (x - dx) * (x - dx) + (y - dy) * (y - dy)) = 1) GROUP BY kind""")
def nearest_zone_rings(spark, sf_dir):
    """Developments in the zones, as polygons, of the kind of the nearest facility, inside a district."""
    points = entity(spark, sf_dir, "facility").select("facility", "kind", "x", "y")
    district = spark.createDataFrame([(0, [[{"x": float(x), "y": float(y)} for x, y in DISTRICT[1]]])], f"d int, {shapes.RINGS}")
    zones = voronoi.nearest_zones(points, "facility", "kind", spatial.rings_to_edges(district, "d"), (0.0, 0.0, 10010.0, 10010.0), 500.0, SIDE)
    places = entity(spark, sf_dir, "development").select("development", "units", (F.col("x") + 0.137).alias("x"), (F.col("y") + 0.291).alias("y"))
    edges = cut(spatial.spread(spatial.rings_to_edges(zones, "kind")))
    held = spatial.point_in_polygon(places, edges, "development", "kind", spatial.small_cells(edges, 250.0))
    return held.join(places, "development").groupBy("kind").agg(F.count("*").alias("n"), F.sum("units").alias("units"))


@query("polygon_residential", sql("block_group", "zone", "parcel") + f"""SELECT zone, bg, round(sum(area), 3) AS residential FROM (SELECT zone, bg, {_of_shape('g', 'p')} AS area FROM zone z JOIN block_group g ON z.x1 < g.x2 AND z.x2 > g.x1 AND z.y1 < g.y2 AND z.y2 > g.y1
JOIN parcel p ON p.x1 < g.x2 AND p.x2 > g.x1 AND p.y1 < g.y2 AND p.y2 > g.y1 AND p.x1 < z.x2 AND p.x2 > z.x1 AND p.y1 < z.y2 AND p.y2 > z.y1 WHERE coalesce(luc, '') SIMILAR TO '(100|110|120|630|EXHA|EXED).*') GROUP BY ALL HAVING sum(area) > 0""")
def polygon_residential(spark, sf_dir):
    """The area of homes in each part of a block group in a zone, all of any shape."""
    parts = fragment_trapezoids(spark, sf_dir)
    met = shapes.intersect(parts, shapes.box_trapezoids(homes(spark, sf_dir), "parcel"), ["zone", "bg"], ["parcel"], SIDE)
    return met.groupBy("zone", "bg").agg(F.round(F.sum(shapes.area_of()), 3).alias("residential"))


@query("polygon_points", sql("facility", "zone") + """SELECT facility, zone FROM facility JOIN zone ON x >= x1 AND x < x2 AND y >= y1 AND y < y2
WHERE NOT (x >= (x1 + x2) / 2 AND y >= (y1 + y2) / 2) AND NOT (x >= x1 + 100 AND x < x1 + 500 AND y >= y1 + 100 AND y < y1 + 700)""")
def polygon_points(spark, sf_dir):
    """Facilities in zones with corners and holes."""
    return spatial.point_in_polygon(entity(spark, sf_dir, "facility").select("facility", "x", "y"), shaped(entity(spark, sf_dir, "zone")), "facility", "zone")


@query("dissolved_zones", sql("block_group") + """, b AS (SELECT bg, bg % 3 AS label, x1, y1 FROM block_group) SELECT label, CAST(count(*) AS DOUBLE) * 4e6 AS area, round(sum(8000e0 - 2000e0 * (SELECT count(*) FROM b o WHERE o.label = b.label AND abs(o.x1 - b.x1) + abs(o.y1 - b.y1) = 2000)), 4) AS border FROM b GROUP BY label""")
def dissolved_zones(spark, sf_dir):
    """Block groups of a label as one zone: its area and the length of its border."""
    rows = entity(spark, sf_dir, "block_group")
    edges = boxed(rows, "bg").withColumn("label", F.col("bg") % 3)
    border = spatial.dissolved(edges, "label")
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    area = F.abs(F.sum((F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2))
    return border.groupBy("label").agg(area.alias("area"), F.round(F.sum(length), 4).alias("border"))


@query("union_area", """WITH s AS (SELECT s_suppkey % 4 AS k, CAST((s_suppkey * 7919 + 19) % 10007 AS DOUBLE) AS x, CAST((s_suppkey * 104729 + 23) % 10009 AS DOUBLE) AS y FROM supplier),
b AS (SELECT k, x AS x1, y AS y1, x + 1500 AS x2, y + 300 AS y2 FROM s UNION ALL SELECT k, x, y, x + 400, y + 900 FROM s),
xs AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) AS nx FROM (SELECT DISTINCT k, unnest([x1, x2]) AS x FROM b)), ys AS (SELECT k, y, lead(y) OVER (PARTITION BY k ORDER BY y) AS ny FROM (SELECT DISTINCT k, unnest([y1, y2]) AS y FROM b)),
hit AS (SELECT DISTINCT xs.k, x, nx, y, ny FROM xs JOIN b ON b.k = xs.k AND x1 <= x AND x2 >= nx JOIN ys ON ys.k = xs.k AND y1 <= y AND y2 >= ny) SELECT k, round(sum((nx - x) * (ny - y)), 4) AS area FROM hit GROUP BY k""")
def union_area(spark, sf_dir):
    """The area that overlapping shapes with a corner cut out cover together, by the rings of their union."""
    x, y = F.col("x"), F.col("y")
    ring = F.array(*[_xy(x + a, y + b) for a, b in ((0, 0), (1500, 0), (1500, 300), (400, 300), (400, 900), (0, 900))])
    rows = entity(spark, sf_dir, "station").select("station", F.array(ring).alias("rings"))
    edges = spatial.rings_to_edges(rows, "station").withColumn("k", F.col("station") % 4)
    return shapes.union(edges, "station", "k", 1000.0).select("k", F.round(shapes.ring_area(F.col("rings")), 4).alias("area"))


WALKED = {"WALK 0": "North", "WALK 1": "South", "WALK 3": "East", "WALK 4": "South"}


@query("walk_zones", sql("parcel") + """, w AS (SELECT CASE parcel % 6 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 3 THEN 'East' WHEN 4 THEN 'South' END AS school, parcel, x1, y1, x2, y2 FROM parcel WHERE parcel % 4 < 2),
unit AS (SELECT DISTINCT school, x, unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS y FROM (SELECT *, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x FROM w))
SELECT school, n, round(area, 4) AS area FROM (SELECT school, count(*) AS n FROM w GROUP BY 1) JOIN (SELECT school, CAST(count(*) AS DOUBLE) AS area FROM unit GROUP BY 1) USING (school)""")
def walk_zones(spark, sf_dir):
    """Walk zones by school: features marked 'Y', dissolved under the names of a crosswalk; several names may mean one school."""
    marked = F.expr("CASE parcel % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'Y' WHEN 2 THEN 'N' END")
    rows = entity(spark, sf_dir, "parcel").where(marked == "Y").withColumn("ename", F.concat(F.lit("WALK "), F.col("parcel") % 6))
    rows = readers.canonical(rows, WALKED, "ename").select(F.col("canonical").alias("school"), "parcel", "x1", "y1", "x2", "y2")
    area = shapes.covered(shapes.box_trapezoids(rows, "school"), "school", SIDE).groupBy("school").agg(F.round(F.sum(shapes.area_of()), 4).alias("area"))
    return rows.groupBy("school").agg(F.count("*").alias("n")).join(area, "school")


@query("hull_area", sql("facility") + """, p AS (SELECT DISTINCT nation AS k, x, y FROM facility), e AS (SELECT a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON a.k = b.k AND (a.x, a.y) != (b.x, b.y)
WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.k = a.k AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
OR (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - b.x) * (b.x - a.x) + (c.y - b.y) * (b.y - a.y) > 0 OR (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0)))) SELECT k, round(sum(x1 * y2 - x2 * y1) / 2, 4) AS area FROM e GROUP BY k HAVING count(*) > 2""")
def hull_area(spark, sf_dir):
    """The area of the hull around each nation's facilities."""
    points = entity(spark, sf_dir, "facility").select(F.col("nation").alias("k"), "x", "y")
    w = Window.partitionBy("k").orderBy("corner")
    corners = spatial.convex_hull(points, "k")
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in ("x", "y"))
    return corners.withColumn("a", F.col("x") * ny - nx * F.col("y")).groupBy("k").agg(F.round(F.sum("a") / 2, 4).alias("area"), F.count("*").alias("n")).where("n > 2").drop("n")


@query("simplified_zones", sql("block_group") + "SELECT bg, 4 AS corners, 4000000e0 AS area FROM block_group")
def simplified_zones(spark, sf_dir):
    """Block groups whose sides wind by up to three metres, simplified to five: neighbours keep one border."""
    winding = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((i * 250).alias("at"), F.when(i > 0, F.pmod(i * 5, F.lit(7)) - 3).otherwise(0).alias("off")))
    groups = entity(spark, sf_dir, "block_group").withColumn("i", winding)

    def side(x, y, dx, dy, back):
        # A side is the same line from either end: at 250, 500, ... from its lower left corner.
        points = F.reverse("i") if back else F.col("i")
        shift = lambda p: (F.when(p["at"] == 0, F.lit(2000)).otherwise(p["at"]) if back else p["at"]).cast("double")
        return F.transform(points, lambda p: _xy(F.col(x) + shift(p) * dx + p["off"] * dy, F.col(y) + shift(p) * dy + p["off"] * dx))

    ring = F.concat(side("x1", "y1", 1, 0, False), side("x2", "y1", 0, 1, False), F.array(_xy(F.col("x2"), F.col("y2"))), F.slice(side("x1", "y2", 1, 0, True), 1, 7), F.array(_xy(F.col("x1"), F.col("y2"))), F.slice(side("x1", "y1", 0, 1, True), 1, 7))
    edges = spatial.rings_to_edges(groups.select("bg", F.array(ring).alias("rings")), "bg")
    out = simplify.simplified(edges, "bg", 5.0)
    return out.select("bg", F.size(F.element_at("rings", 1)).alias("corners"), F.round(shapes.ring_area(F.col("rings")), 4).alias("area"))
