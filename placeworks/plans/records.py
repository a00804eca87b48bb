"""Queries on cleaning, linking, ranking and profiling of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, geo
from ..operators import profile, spatial, tables
from ..sources import geocoder
from .adapters import entity, sql
from .registry import query, table


@query("money_parse", """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS price FROM part""")
def money_parse(spark, sf_dir):
    text = "CASE WHEN p_partkey % 9 = 0 THEN 'n/a' WHEN p_partkey % 2 = 0 THEN concat('$', CAST(p_retailprice AS STRING)) ELSE CAST(p_retailprice AS STRING) END"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{text} AS t").select("p_partkey", clean.money(F.col("t")).alias("price"))


@query("address_fix", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) || ' Erwin Road' WHEN 1 THEN CAST(p_partkey AS VARCHAR) || ' Weaver Dairy Rd'
WHEN 2 THEN CAST(p_partkey AS VARCHAR) || ' Martin Luther King Blvd' WHEN 3 THEN CAST(p_partkey AS VARCHAR) || ' & ' || CAST(p_partkey + 1 AS VARCHAR) || ' Elm St' ELSE CAST(p_partkey AS VARCHAR) || '-B ' || p_name END AS address FROM part""")
def address_fix(spark, sf_dir):
    raw = """CASE p_partkey % 5 WHEN 0 THEN concat(p_partkey, '-', p_partkey + 8, ' Erwin Toad') WHEN 1 THEN concat(' ', p_partkey, ' and ', p_partkey + 2, ' Weaver Diary Rd')
    WHEN 2 THEN concat(p_partkey, ' - ', p_partkey + 1, ' Martin Luther Kind Blvd ') WHEN 3 THEN concat(p_partkey, ' & ', p_partkey + 1, ' Elm St') ELSE concat(p_partkey, '-B ', p_name) END"""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{raw} AS t")
    return rows.select("p_partkey", clean.fix_address(F.col("t")).alias("address"))


@query("recent_nonblank", """SELECT s_suppkey AS station, CASE WHEN s_suppkey % 4 = 2 THEN CAST('12' || CAST(100 + s_suppkey % 900 AS VARCHAR) AS DOUBLE) WHEN s_suppkey % 4 = 3 THEN s_suppkey * 37e0
WHEN s_suppkey % 3 = 1 THEN s_suppkey * 11e0 + 5 ELSE s_suppkey + 1e0 END AS aadt,
CAST(CASE WHEN s_suppkey % 4 IN (2, 3) THEN 2022 WHEN s_suppkey % 3 = 1 THEN 2021 ELSE 2020 END AS INTEGER) AS year FROM supplier""")
def recent_nonblank(spark, sf_dir):
    found = clean.latest_number([(y, F.col(f"aadt_{y}")) for y in (2020, 2021, 2022)])
    out = entity(spark, sf_dir, "station").withColumn("f", found)
    return out.select("station", F.col("f.value").alias("aadt"), F.col("f.year").alias("year")).where("aadt > 0")


@query("geoid_parent", """SELECT substr(geoid, 1, 12) AS parent, count(*) AS n FROM (SELECT '37' || '135' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') || CAST(q AS VARCHAR) || '000' AS geoid
FROM nation, range(1, 5) r(q)) GROUP BY ALL""")
def geoid_parent(spark, sf_dir):
    geoid = F.concat(F.lit("37135"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0"), F.col("quarter").cast("string"), F.lit("000"))
    blocks = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter"))
    return blocks.select(geoid.alias("g")).groupBy(clean.parent_geoid(F.col("g")).alias("parent")).agg(F.count("*").alias("n"))


@query("residential_filter", sql("parcel") + """SELECT parcel, value FROM parcel WHERE coalesce(luc, '') SIMILAR TO '(100|110|120|630|EXHA|EXED).*' AND imp_vac ILIKE '%Improved%'""")
def residential_filter(spark, sf_dir):
    kept = clean.is_residential(F.col("luc")) & clean.is_improved(F.col("imp_vac"))
    return entity(spark, sf_dir, "parcel").where(kept).select("parcel", "value")


@query("years_since_sale", """SELECT o_orderkey AS sale, 2026 - CAST(year(o_orderdate) AS INTEGER) AS years FROM orders""")
def years_since_sale(spark, sf_dir):
    return entity(spark, sf_dir, "sale").select("sale", (F.lit(2026) - F.year("sold")).alias("years"))


@query("parcel_left_join", """SELECT p.p_partkey, count(l.l_orderkey) AS n, round(coalesce(sum(l.l_extendedprice), 0e0), 2) AS total
FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey AND l.l_quantity > 45 GROUP BY ALL""")
def parcel_left_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey"))
    sums = lines.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return tables.dense(table(spark, sf_dir, "part").select("p_partkey"), sums, "p_partkey", ["n", "total"])


@query("dense_zone_counts", """SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY ALL""")
def dense_zone_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return tables.dense(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), counts, "n_nationkey", ["n"])


@query("baseline_delta", """WITH t AS (SELECT c_nationkey AS cell, c_mktsegment AS mode, CASE WHEN c_custkey % 3 = 0 THEN 'baseline' ELSE 'closed' || CAST(c_custkey % 3 AS VARCHAR) END AS scenario, round(min(c_acctbal), 2) AS v
FROM customer GROUP BY ALL) SELECT *, max(CASE WHEN scenario = 'baseline' THEN v END) OVER (PARTITION BY cell, mode) AS baseline,
round(v - max(CASE WHEN scenario = 'baseline' THEN v END) OVER (PARTITION BY cell, mode), 4) AS delta FROM t""")
def baseline_delta(spark, sf_dir):
    scenario = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'baseline' ELSE concat('closed', c_custkey % 3) END")
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cell"), F.col("c_mktsegment").alias("mode"), scenario.alias("scenario"))
    out = tables.against_baseline(rows.agg(F.round(F.min("c_acctbal"), 2).alias("v")), ["cell", "mode"], "scenario", "v")
    return out.withColumn("delta", F.round("delta", 4))


@query("unmapped_anti", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def unmapped_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("affected_semi", """SELECT c_nationkey, count(*) AS n, round(median(c_acctbal), 4) AS median_value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL""")
def affected_semi(spark, sf_dir):
    hit = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    kept = table(spark, sf_dir, "customer").join(hit, "c_custkey", "left_semi").select("c_nationkey", "c_acctbal")
    counts = kept.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return counts.join(profile.quantiles(kept, "c_acctbal", ["c_nationkey"], {"median_value": 0.5}, 4), "c_nationkey")


@query("affected_parcels", sql("parcel", "station") + """, p AS (SELECT parcel, value, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py FROM parcel),
n AS (SELECT parcel, value, station FROM p, station QUALIFY row_number() OVER (PARTITION BY parcel ORDER BY round(sqrt((x - px) ** 2 + (y - py) ** 2), 6), station) = 1)
SELECT scenario, mode, count(*) AS n, round(median(value), 4) AS median_value FROM n, range(3) a(scenario), range(2) b(mode) WHERE (station * 31 + scenario * 7 + mode * 5) % 11 - 6 > 0 GROUP BY ALL""")
def affected_parcels(spark, sf_dir):
    """By scenario and mode, the parcels whose nearest grid point takes longer than before: how many, and the median of their value."""
    points = entity(spark, sf_dir, "station").select("station", F.col("x").alias("site_x"), F.col("y").alias("site_y"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    delta = points.withColumn("scenario", each(3)).withColumn("mode", each(2)).withColumn("delta", F.expr("(station * 31 + scenario * 7 + mode * 5) % 11 - 6"))
    parcels = entity(spark, sf_dir, "parcel").select("parcel", "value", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    away = lambda s: F.round(geo.planar(F.col("x"), F.col("y"), s["site_x"], s["site_y"]), 6)
    at, site_at = (F.col("x"), F.col("y")), (F.col("site_x"), F.col("site_y"))
    near = spatial.nearest(parcels, points, away, ["station", "site_x", "site_y"], "station", at, site_at, (500.0, 500.0, 500.0)).select("parcel", "value", F.col("nearest.station").alias("station"))
    hit = near.join(delta.where("delta > 0").select("station", "scenario", "mode"), "station").select("scenario", "mode", "value")
    counts = hit.groupBy("scenario", "mode").agg(F.count("*").alias("n"))
    return counts.join(profile.quantiles(hit, "value", ["scenario", "mode"], {"median_value": 0.5}, 4), ["scenario", "mode"])


@query("latest_sale", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1""")
def latest_sale(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return tables.first_row(orders, ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")]).drop("o_orderdate")


@query("rank_min", """SELECT n_nationkey, n, rank() OVER (ORDER BY n DESC) AS rank FROM (SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)""")
def rank_min(spark, sf_dir):
    counts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return tables.rank_min(tables.dense(table(spark, sf_dir, "nation").select("n_nationkey"), counts, "n_nationkey", ["n"]), "n", "rank")


@query("pct_change_baseline", """WITH t AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT *, round((n - first_value(n) OVER w) / CAST(first_value(n) OVER w AS DOUBLE) * 100, 1) AS pct_change FROM t WINDOW w AS (PARTITION BY nation ORDER BY year)""")
def pct_change_baseline(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = joined.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return tables.change_from_first(counts, "nation", "year", "n")


@query("share_of_parent", """WITH t AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, CAST(count_if(c_acctbal > 9500) AS BIGINT) AS r, count(*) AS a FROM customer GROUP BY ALL)
SELECT nation, segment, round(least(CASE WHEN sum(r) OVER w > 0 THEN r / (sum(r) OVER w)::DOUBLE ELSE a / (sum(a) OVER w)::DOUBLE END, 1), 6) AS share FROM t WINDOW w AS (PARTITION BY nation)""")
def share_of_parent(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    rows = rows.agg(F.count_if(F.col("c_acctbal") > 9500).alias("r"), F.count("*").alias("a"))
    return rows.select("nation", "segment", F.round(tables.share_of(rows, ["nation"], "r", "a"), 6).alias("share"))


@query("topk_stations", """SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 15""")
def topk_stations(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(15)


@query("zscore_distinct", """WITH g AS (SELECT DISTINCT c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0), s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM g)
SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN (c_acctbal - m) / sd ELSE 0 END, 6) AS z FROM customer, s""")
def zscore_distinct(spark, sf_dir):
    out = tables.zscores(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal")
    return out.select("c_custkey", F.round("z", 6).alias("z"))


@query("census_chunk_merge", """SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS n_positive, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation""")
def census_chunk_merge(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select("n_nationkey")
    one = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_positive"))
    two = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers"))
    return tables.merge_columns([base, one, two], ["n_nationkey"]).fillna(0)


@query("geocode_cascade", """SELECT c.c_custkey, CASE WHEN c.c_custkey % 3 = 0 THEN c.c_acctbal WHEN c.c_custkey % 5 = 0 THEN -c.c_acctbal END AS lat, CASE WHEN c.c_custkey % 3 = 0 THEN 0::BIGINT WHEN c.c_custkey % 5 = 0 THEN 1 END AS source FROM customer c""")
def geocode_cascade(spark, sf_dir):
    """The first geocoder that knows an address wins."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    known = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("lat"))
    return tables.cascade(rows, "c_custkey", [known.where("c_custkey % 3 = 0"), known.where("c_custkey % 5 = 0").withColumn("lat", -F.col("lat"))], ["lat"])


_ASKED = "SELECT c_custkey AS k, -79.25e0 + (c_custkey * 7919 % 10007) / 20000e0 AS lon, 35.85e0 + (c_custkey * 104729 % 10009) / 40000e0 AS lat FROM customer"


@query("geocode_report", f"""WITH a AS ({_ASKED}), b AS (SELECT *, CASE WHEN k % 4 = 0 THEN 0 WHEN k % 3 = 0 THEN 1 WHEN k % 5 = 0 THEN 2 END AS source FROM a)
SELECT CAST(source AS BIGINT) AS source, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM b) AS DOUBLE), 6) AS share, count_if(source IS NOT NULL AND lon BETWEEN -79.1 AND -78.9 AND lat BETWEEN 35.88 AND 36.02) AS n_inside FROM b GROUP BY 1""")
def geocode_report(spark, sf_dir):
    """Addresses by what found them: a batch answer, one for a second city, a single search; and how many lie in the district.

    The answers are lines as the service writes them, with ties, lines cut short and places that are not numbers among those of no match.
    """
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS address", "-79.25D + (c_custkey * 7919 % 10007) / 20000D AS lon", "35.85D + (c_custkey * 104729 % 10009) / 40000D AS lat")

    def answered(asked, status: str, place: str):
        fields = ["CAST(k AS STRING)", "address", status, "'Exact'", "upper(address)", place, "'6051'", "'L'"]
        line = "concat('\"', concat_ws('\",\"', " + ", ".join(fields) + "), '\"')"
        return asked.selectExpr(f"CASE WHEN k % 4 = 3 AND k % 3 != 0 THEN concat('\"', k, '\",\"', address, '\",\"No_Match\"') ELSE {line} END AS line")

    place = "concat(CAST(lon AS STRING), ',', CAST(lat AS STRING))"
    first = geocoder.parsed(answered(rows, "CASE k % 4 WHEN 1 THEN 'Tie' ELSE 'Match' END", f"CASE k % 4 WHEN 2 THEN 'n/a,' WHEN 3 THEN '' ELSE {place} END"), "line", "k")
    second = geocoder.parsed(answered(geocoder.unmatched(rows, "k", first), "CASE WHEN k % 3 = 0 THEN 'Exact' ELSE 'No_Match' END", place), "line", "k")
    single = rows.where("k % 5 = 0").select("k", "lat", "lon")
    told = geocoder.geocoded(rows.select("k"), "k", [first, second, single])
    out = geocoder.report(told, F.expr("lon BETWEEN -79.1 AND -78.9 AND lat BETWEEN 35.88 AND 36.02"))
    return out.select("source", "n", F.round("share", 6).alias("share"), "n_inside")


@query("text_sections", """SELECT p_partkey AS line, p_name AS entry, CAST((p_partkey // 10) * 10 AS BIGINT) AS section FROM part WHERE p_partkey % 10 != 0""")
def text_sections(spark, sf_dir):
    """Lines under headings, each with its heading; every tenth line is one."""
    lines = table(spark, sf_dir, "part").selectExpr("p_partkey AS line", "CASE WHEN p_partkey % 10 = 0 THEN concat('== ', p_partkey, ' ==') ELSE p_name END AS text")
    header = F.nullif(F.regexp_extract("text", "^== ([0-9]+) ==$", 1), F.lit("")).cast("long")
    out = tables.carried_forward(lines, "line", header, "section")
    return out.where(~F.col("text").startswith("== ")).select("line", F.col("text").alias("entry"), "section")


@query("canonical_edges", """WITH e AS (SELECT p_partkey AS k, p_partkey AS u, (p_partkey * 7 + 3) % n AS v FROM part, (SELECT count(*) AS n FROM part)), b AS (SELECT * FROM e UNION ALL SELECT k + 1000000, v, u FROM e WHERE k % 2 = 0)
SELECT least(u, v) AS lo, greatest(u, v) AS hi, min(k) AS k FROM b WHERE u != v GROUP BY ALL""")
def canonical_edges(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    e = part.selectExpr("p_partkey AS k", "p_partkey AS u", f"(p_partkey * 7 + 3) % {part.count()}L AS v")
    both = e.unionByName(e.where("k % 2 = 0").selectExpr("k + 1000000 AS k", "v AS u", "u AS v")).where("u != v")
    return tables.undirected(both, "k").select("lo", "hi", "k")


@query("bidirectional_edges", """WITH e AS (SELECT DISTINCT p_partkey AS u, (p_partkey * 7 + 3) % n AS v, CAST(p_size AS BIGINT) AS w FROM part, (SELECT count(*) AS n FROM part))
SELECT * FROM e UNION ALL SELECT v, u, w FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.u = a.v AND b.v = a.u)""")
def bidirectional_edges(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return tables.bidirectional(part.selectExpr("p_partkey AS u", f"(p_partkey * 7 + 3) % {part.count()}L AS v", "CAST(p_size AS BIGINT) AS w"))


@query("set_differences", """SELECT n_nationkey AS missing FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""")
def set_differences(spark, sf_dir):
    have = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("missing")).subtract(have)


@query("profile_completeness", """WITH t AS (SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS "column", unnest([CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderstatus END, o_orderpriority]) AS v FROM orders)
SELECT "column", count(*) AS n, CAST(count_if(v IS NULL) AS BIGINT) AS n_null, CAST(count_if(trim(v) = '') AS BIGINT) AS n_blank, CAST(count_if(trim(v) != '') AS BIGINT) AS n_populated, round(CAST(count_if(trim(v) != '') AS BIGINT) / count(*)::DOUBLE * 100, 1) AS pct FROM t GROUP BY 1""")
def profile_completeness(spark, sf_dir):
    status = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderstatus END")
    return profile.completeness(table(spark, sf_dir, "orders").withColumn("o_orderstatus", status), ["o_orderstatus", "o_orderpriority"])


@query("profile_categorical", """SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*) FROM events GROUP BY ALL""")
def profile_categorical(spark, sf_dir):
    return profile.categories(table(spark, sf_dir, "events").withColumn("hour", F.hour("ts")), ["event_type", "hour"])


@query("dup_coords", """WITH m AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_places FROM m""")
def dup_coords(spark, sf_dir):
    return profile.repeated_places(table(spark, sf_dir, "orders").withColumn("one", F.lit(1)), "o_custkey", "one")


@query("numeric_stats", """SELECT event_type, count(value) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 4) AS mean, round(median(value), 6) AS mid FROM events GROUP BY ALL""")
def numeric_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").cast("string").try_cast("double").alias("v"))
    stats = rows.groupBy("event_type").agg(F.count("v").alias("n"), F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"), F.round(F.avg("v"), 4).alias("mean"))
    return stats.join(profile.quantiles(rows, "v", ["event_type"], {"mid": 0.5}), "event_type")


@query("date_stats", """SELECT o_orderpriority, min(d) AS first, max(d) AS last, count(*) AS n, CAST(count_if(o_orderkey % 3 = 2) AS BIGINT) AS n_years, count(DISTINCT d) AS n_days
FROM (SELECT o_orderpriority, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) ELSE make_date(year(o_orderdate), 1, 1) END AS d FROM orders WHERE o_orderkey % 3 != 1) GROUP BY o_orderpriority""")
def date_stats(spark, sf_dir):
    """Dates told as milliseconds or as years, and texts that are neither."""
    raw = F.expr("CASE o_orderkey % 3 WHEN 0 THEN CAST(unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS STRING) WHEN 1 THEN 'unknown' ELSE CAST(year(o_orderdate) AS STRING) END")
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", raw.alias("t")).withColumn("d", clean.interpreted_date(F.col("t"))).where("d IS NOT NULL")
    return rows.groupBy("o_orderpriority").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n"), F.count_if(F.length("t") == 4).alias("n_years"), F.count_distinct("d").alias("n_days"))


@query("quantile_scale", """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.05), 6) AS q05, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(quantile_cont(o_totalprice, 0.95), 6) AS q95 FROM orders GROUP BY 1""")
def quantile_scale(spark, sf_dir):
    return profile.quantiles(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])


@query("quantile_nonzero", """SELECT round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM (SELECT l_discount * l_extendedprice AS v FROM lineitem) WHERE v != 0""")
def quantile_nonzero(spark, sf_dir):
    """Percentiles of the values that are not 0, for a colour scale."""
    v = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * F.col("l_extendedprice")).alias("v")).where("v != 0")
    return profile.quantiles(v, "v", (), {"p05": 0.05, "p95": 0.95, "p99": 0.99})


@query("hist15", """SELECT b AS bin, count(c_custkey) AS n FROM range(15) r(b) LEFT JOIN customer ON c_acctbal >= 0 AND least(CAST(floor(c_acctbal / 500e0) AS BIGINT), 14) = b GROUP BY 1""")
def hist15(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 0.0, 7500.0)


@query("hist25", """SELECT b AS bin, count(o_orderkey) AS n FROM range(25) r(b) LEFT JOIN orders ON least(CAST(floor(o_totalprice / 20000e0) AS BIGINT), 24) = b AND o_totalprice >= 0 GROUP BY 1""")
def hist25(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0.0, 500_000.0, 25)


@query("bedroom_bins", """SELECT greatest(least(p_size // 8, 5), 1) AS bedrooms, count(*) AS n FROM part GROUP BY 1""")
def bedroom_bins(spark, sf_dir):
    """Five bins: 1 and fewer, 2, 3, 4, 5 and more."""
    bedrooms = F.greatest(F.least(F.floor(F.col("p_size") / 8), F.lit(5)), F.lit(1)).cast("int")
    return table(spark, sf_dir, "part").groupBy(bedrooms.alias("bedrooms")).agg(F.count("*").alias("n"))


@query("upper_median", """SELECT c_nationkey, list_sort(list(c_acctbal))[CAST(floor(count(*) / 2e0) AS BIGINT) + 1] AS median FROM customer GROUP BY 1""")
def upper_median(spark, sf_dir):
    return profile.upper_median(table(spark, sf_dir, "customer"), "c_acctbal", ["c_nationkey"])


@query("set_equality", """SELECT (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)) AS missing, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) AS unknown,
(SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)) + (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) = 0 AS equal""")
def set_equality(spark, sf_dir):
    """Whether two tables name the same keys, and how many of either the other lacks."""
    return tables.set_equality(table(spark, sf_dir, "nation"), "n_nationkey", table(spark, sf_dir, "customer"), "c_nationkey")


@query("equity_score", """SELECT n_nationkey, round(0.4e0 * (n_nationkey * 3 % 100) + 0.3e0 * coalesce(CASE WHEN n_nationkey % 4 != 0 THEN n_nationkey * 7 % 100 END, 0) + 30 * (n_nationkey % 2), 4) AS equity FROM nation""")
def equity_score(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_nationkey * 3 % 100 AS frl", "CASE WHEN n_nationkey % 4 != 0 THEN n_nationkey * 7 % 100 END AS minority", "n_nationkey % 2 AS title_i")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("n_nationkey", F.round(F.lit(0.4) * zero("frl") + F.lit(0.3) * zero("minority") + zero("title_i") * 30, 4).alias("equity"))


@query("cost_whatif", """SELECT s_suppkey, round(s_acctbal * 1000 + 15000000, 2) AS renovate, 10 * 1700000 - 10 * 200000 AS saved FROM supplier""")
def cost_whatif(spark, sf_dir):
    """Ten years of a site kept, against what closing it saves net of buses."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") * 1000 + 15000000, 2).alias("renovate"), (F.lit(10 * 1700000) - F.lit(10 * 200000)).alias("saved"))
