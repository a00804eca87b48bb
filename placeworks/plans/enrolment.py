"""The enrolment model over fragments of block groups, with the SQL that scores the same candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrolment as M
from .registry import query, table

RACES = ("white", "black", "asian", "hispanic", "other")
TARGET = 4771.0
#: Four of the eleven sites are magnets, two of them for the well-off; six of their pulls are stronger on one race.
MAGNETS, BY_INCOME = (1, 3, 6, 8), (3, 8)
BONUSES = ((1, "hispanic"), (6, "asian"), (3, "white"), (3, "asian"), (8, "white"), (8, "asian"))

FRAGMENT = ["c_custkey % 500 AS bg", "CASE WHEN c_custkey % 11 = 1 THEN 0 ELSE c_custkey % 11 END AS home", "(c_custkey % 97 + 1) / 100e0 AS weight"]
GROUP = [
    "bg", "CAST(bg % 41 + 3 AS DOUBLE) AS old", "CAST(bg % 37 + 1 AS DOUBLE) AS young", "CAST(CASE WHEN bg % 10 = 0 THEN -666666666 ELSE 30000 + bg * 211 % 90000 END AS DOUBLE) AS income",
    "bg % 50 + 10 AS white", "bg % 20 AS black", "bg % 13 AS asian", "bg % 17 AS hispanic", "bg % 7 AS other",
    "CASE WHEN bg % 9 = 0 THEN 0 ELSE bg % 50 + 10 + bg % 20 + bg % 13 + bg % 17 + bg % 7 END AS everyone",
]
CANDIDATE = [
    "c AS candidate", "1 + (c % 9) / 2e0 AS white_weight", "(c % 5) / 4e0 AS mu", "(c % 3) / 2e0 AS income_pull",
    "CASE WHEN c = 11 THEN 4e0 ELSE (c % 7 - 3) / 6e0 END AS income_weight",
]
BONUS = " OR ".join(f"site = {m} AND race = '{r}'" for m, r in BONUSES)
PULL = ["c AS candidate", "site", "race", f"(c * 7 + site * 3) % 11 / 5e0 - 1 + CASE WHEN {BONUS} THEN (c * 5 + site) % 4 / 2e0 ELSE 0e0 END AS pull", "site IN (3, 8) AS by_income"]

MODEL = f"""WITH fragment AS (SELECT {", ".join(FRAGMENT)} FROM customer), bgs AS (SELECT {", ".join(GROUP)} FROM (SELECT DISTINCT c_custkey % 500 AS bg FROM customer)),
spread AS (SELECT avg(income) AS m, stddev_pop(income) AS sd FROM bgs WHERE income > 0),
zed AS (SELECT bgs.*, CASE WHEN income > 0 THEN (income - m) / sd ELSE 0 END AS z FROM bgs, spread),
feature AS (SELECT bg, home, race, z, sum(old * weight * share) AS old, sum(young * weight * share) AS young FROM fragment JOIN (SELECT bg, z, old, young, unnest(['white', 'black', 'asian', 'hispanic', 'other']) AS race,
CASE WHEN everyone > 0 THEN unnest([white, black, asian, hispanic, other]) / CAST(everyone AS DOUBLE) ELSE 0 END AS share FROM zed) USING (bg) GROUP BY ALL),
candidate AS (SELECT {", ".join(CANDIDATE)} FROM range(12) r(c)),
pull AS (SELECT {", ".join(PULL)} FROM range(12) r(c), (SELECT unnest([1, 3, 6, 8]) AS site), (SELECT unnest(['white', 'black', 'asian', 'hispanic', 'other']) AS race)),
total AS (SELECT sum(old) AS o, sum(young) AS y FROM feature),
kid AS (SELECT candidate, bg, home, race, z, income_pull, 4771e0 * ((1 - mu) * old / o + mu * young / y) AS kids, CASE WHEN race = 'white' THEN white_weight ELSE 1 END * exp(income_weight * z) AS w FROM feature, total, candidate),
base AS (SELECT candidate, 0.1e0 * sum(kids) / sum(kids * w) AS b FROM kid GROUP BY candidate),
pool AS (SELECT kid.*, b * w AS rate, kids * (1 - b * w) AS stay FROM kid JOIN base USING (candidate)),
goal AS (SELECT candidate, bg, home, race, stay, home AS site, 0e0 AS u FROM pool UNION ALL
SELECT p.candidate, bg, home, p.race, stay, m.site, pull + CASE WHEN by_income THEN income_pull * z ELSE 0 END FROM pool p JOIN pull m ON m.candidate = p.candidate AND m.race = p.race AND m.site != home),
moved AS (SELECT candidate, bg, home, race, site, stay * exp(u) / sum(exp(u)) OVER (PARTITION BY candidate, bg, home, race) AS flow FROM goal),
actual AS (SELECT s_suppkey AS site, 300e0 + s_suppkey % 11 * 18 AS students FROM supplier WHERE s_suppkey < 11)
"""
SCORES = """, score AS (SELECT candidate, avg(abs(coalesce(n, 0) - students)) AS mae, sqrt(avg((coalesce(n, 0) - students) ** 2)) AS rmse FROM (SELECT candidate FROM candidate) CROSS JOIN actual LEFT JOIN (SELECT candidate, site, sum(flow) AS n FROM moved GROUP BY ALL) t USING (candidate, site) GROUP BY candidate),
possible AS (SELECT candidate, bool_and(rate >= 0 AND rate < 1) AS feasible FROM pool GROUP BY candidate)
"""


def features(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    groups = customers.selectExpr("c_custkey % 500 AS bg").distinct().selectExpr(*GROUP)
    return M.features(customers.selectExpr(*FRAGMENT), groups, RACES, "income")


def model(spark, sf_dir):
    """(pool, flows) of twelve candidates."""
    numbers = spark.range(12).withColumnRenamed("id", "c")
    values = lambda name, of: F.explode(F.array(*[F.lit(v) for v in of])).alias(name)
    pulls = numbers.select("c", values("site", MAGNETS)).select("c", "site", values("race", RACES)).selectExpr(*PULL)
    pool = M.pooled(features(spark, sf_dir), numbers.selectExpr(*CANDIDATE), TARGET, "white")
    return pool, M.flows(pool, pulls)


@query("enrolment_features", MODEL + "SELECT home, race, round(sum(old), 4) AS old, round(sum(young), 4) AS young, round(sum(old * z), 4) AS richness FROM feature GROUP BY ALL")
def enrolment_features(spark, sf_dir):
    """Children by home and race, and their income above the mean."""
    sums = [F.round(F.sum(v), 4).alias(name) for name, v in (("old", F.col("old")), ("young", F.col("young")), ("richness", F.col("old") * F.col("z")))]
    return features(spark, sf_dir).groupBy("home", "race").agg(*sums)


@query("enrolment_optout", MODEL + "SELECT candidate, race, round(sum(kids), 4) AS kids, round(sum(stay), 4) AS stay, round(max(rate), 6) AS top_rate FROM pool GROUP BY ALL")
def enrolment_optout(spark, sf_dir):
    """Who stays by race, and the highest rate of opting out, by candidate."""
    by = model(spark, sf_dir)[0].groupBy("candidate", "race")
    return by.agg(F.round(F.sum("kids"), 4).alias("kids"), F.round(F.sum("stay"), 4).alias("stay"), F.round(F.max("rate"), 6).alias("top_rate"))


@query("enrolment_flows", MODEL + "SELECT candidate, site, home, race, round(sum(flow), 5) AS flow FROM moved WHERE site != home GROUP BY ALL HAVING sum(flow) >= 1e-9")
def enrolment_flows(spark, sf_dir):
    """Pupils that each magnet draws from each zone, by race."""
    moved = model(spark, sf_dir)[1].where("site != home").groupBy("candidate", "site", "home", "race").agg(F.sum("flow").alias("flow"))
    return moved.where("flow >= 1e-9").withColumn("flow", F.round("flow", 5))


@query("enrolment_totals", MODEL + "SELECT candidate, site, race, round(sum(flow), 4) AS students FROM moved GROUP BY ALL")
def enrolment_totals(spark, sf_dir):
    return model(spark, sf_dir)[1].groupBy("candidate", "site", "race").agg(F.round(F.sum("flow"), 4).alias("students"))


@query("enrolment_objective", MODEL + SCORES + """SELECT candidate, round(mae + CASE WHEN feasible THEN 0 ELSE 100000 END, 4) AS mae, round(rmse + CASE WHEN feasible THEN 0 ELSE 100000 END, 4) AS rmse, feasible FROM score JOIN possible USING (candidate)""")
def enrolment_objective(spark, sf_dir):
    """All candidates' errors at once; those that lose more than all of a group are penalised."""
    pool, moved = model(spark, sf_dir)
    actual = table(spark, sf_dir, "supplier").where("s_suppkey < 11").selectExpr("s_suppkey AS site", "300e0 + s_suppkey % 11 * 18 AS students")
    out = M.objective(pool, moved, actual)
    return out.select("candidate", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), "feasible")
