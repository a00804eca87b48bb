"""The enrolment model in full: features of fragments, opt-out by race and income, pull of magnet sites, objective.

Many parameter sets (candidates) are scored in one job: fragments are summed by
block group, home and race first, so the rows that meet the candidates do not
grow with the fragments, and each row's destinations stay inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .choice import LOST_SHARE

#: What an infeasible candidate's error is raised by.
PENALTY = 1e5


def features(fragments: DataFrame, groups: DataFrame, races: Sequence[str], income: str) -> DataFrame:
    """(bg, home, race, z, old, young): children of each race by block group and home.

    fragments: bg, home, weight; groups: a row for each bg with `old`, `young`, the races' counts,
    their total `everyone` and the income. A group without people has no children
    of any race; an income that is not above 0 counts as the mean.
    """
    valid = F.when(F.col(income) > 0, F.col(income))
    spread = groups.agg(F.avg(valid).alias("_mean"), F.stddev_pop(valid).alias("_sd"))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    told = groups.crossJoin(F.broadcast(spread)).withColumn("z", F.coalesce((valid - F.col("_mean")) / sd, F.lit(0.0)))  # one row
    weights = fragments.groupBy("bg", "home").agg(F.sum("weight").alias("weight"))
    share = lambda r: F.when(F.col("everyone") > 0, F.col(r) / F.col("everyone")).otherwise(0.0)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("race"), share(r).alias("share")) for r in races])).alias("e")
    rows = weights.join(told, "bg").select("bg", "home", "weight", "z", "old", "young", each)
    part = F.col("weight") * F.col("e.share")
    return rows.select("bg", "home", "e.race", "z", (F.col("old") * part).alias("old"), (F.col("young") * part).alias("young"))


def pooled(rows: DataFrame, candidates: DataFrame, target: float, white: str) -> DataFrame:
    """rows for each candidate with kids, rate and stay.

    kids: the older and the younger children, mixed by the candidate's `mu` and scaled so that all add up to target.
    rate: a base times `white_weight` for one race and exp(income_weight * z), so that LOST_SHARE of all kids are lost.
    A candidate is a few numbers, and few of them are scored at a time.
    """
    totals = rows.agg(F.sum("old").alias("_old"), F.sum("young").alias("_young"))
    kids = target * ((1 - F.col("mu")) * F.col("old") / F.col("_old") + F.col("mu") * F.col("young") / F.col("_young"))
    weight = F.when(F.col("race") == white, F.col("white_weight")).otherwise(1.0) * F.exp(F.col("income_weight") * F.col("z"))
    told = rows.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(candidates)).withColumn("kids", kids).withColumn("_w", weight)
    base = told.groupBy("candidate").agg((LOST_SHARE * F.sum("kids") / F.sum(F.col("kids") * F.col("_w"))).alias("_base"))
    out = told.join(base, "candidate").withColumn("rate", F.col("_base") * F.col("_w"))
    return out.withColumn("stay", F.col("kids") * (1 - F.col("rate"))).select("candidate", "bg", "home", "race", "z", "income_pull", "kids", "rate", "stay")


def flows(pool: DataFrame, pulls: DataFrame) -> DataFrame:
    """(candidate, bg, home, race, site, flow): those who stay, split over their home and the magnets other than it.

    pulls: candidate, race, site, pull, by_income; the utility of a magnet is its pull, and income_pull * z more
    where by_income; that of home is 0. A race without pulls goes nowhere else.
    """
    lists = pulls.groupBy("candidate", "race").agg(F.collect_list(F.struct("site", "pull", "by_income")).alias("_m"))
    rows = pool.join(lists, ["candidate", "race"], "left")
    extra = F.col("income_pull") * F.col("z")
    utility = lambda m: F.struct(m["site"].alias("site"), (m["pull"] + F.when(m["by_income"], extra).otherwise(0.0)).alias("u"))
    magnets = F.transform(F.filter(F.coalesce("_m", F.array()), lambda m: m["site"] != F.col("home")), utility)
    rows = rows.withColumn("_to", F.concat(F.array(F.struct(F.col("home").alias("site"), F.lit(0.0).alias("u"))), magnets))
    rows = rows.withColumn("_top", F.array_max(F.transform("_to", lambda m: m["u"])))
    rows = rows.withColumn("_sum", F.aggregate("_to", F.lit(0.0), lambda s, m: s + F.exp(m["u"] - F.col("_top"))))
    rows = rows.select("candidate", "bg", "home", "race", "stay", "_top", "_sum", F.explode("_to").alias("m"))
    return rows.select("candidate", "bg", "home", "race", F.col("m.site").alias("site"), (F.col("stay") * F.exp(F.col("m.u") - F.col("_top")) / F.col("_sum")).alias("flow"))


def objective(pool: DataFrame, moved: DataFrame, actual: DataFrame) -> DataFrame:
    """(candidate, mae, rmse, feasible): errors of each site's total against actual (site, students); sites that nobody goes to have 0.

    Where a rate is 1 or more, or below 0, the candidate is not feasible and PENALTY is added.
    """
    possible = pool.groupBy("candidate").agg(F.bool_and((F.col("rate") >= 0) & (F.col("rate") < 1)).alias("feasible"))
    every = possible.crossJoin(F.broadcast(actual))  # a row for each site
    totals = moved.groupBy("candidate", "site").agg(F.sum("flow").alias("_n"))
    error = F.coalesce("_n", F.lit(0.0)) - F.col("students")
    out = every.join(totals, ["candidate", "site"], "left").groupBy("candidate", "feasible").agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    raised = F.when(F.col("feasible"), 0.0).otherwise(PENALTY)
    return out.select("candidate", (F.col("mae") + raised).alias("mae"), (F.col("rmse") + raised).alias("rmse"), "feasible")
