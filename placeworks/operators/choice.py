"""A choice model of enrolment: opt-out, softmax over destinations, fit measures and calibration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOST_SHARE = 0.10


def retained(rows: DataFrame, weight: Column) -> DataFrame:
    """rows (kids) with `rate` and `stay`: opt-out in proportion to the weight, so that LOST_SHARE of all kids are lost.

    A base that would lose more than all of some row is not feasible: rate is then null.
    """
    told = rows.withColumn("_w", weight)
    base = told.agg((F.lit(LOST_SHARE) * F.sum("kids") / F.sum(F.col("kids") * F.col("_w"))).alias("_base"))
    out = told.crossJoin(F.broadcast(base)).withColumn("rate", F.col("_base") * F.col("_w"))  # one number
    feasible = (F.col("rate") >= 0) & (F.col("rate") < 1)
    return out.withColumn("rate", F.when(feasible, F.col("rate"))).withColumn("stay", F.col("kids") * (1 - F.col("rate"))).drop("_w", "_base")


def softmax_flows(choices: DataFrame, keys: list[str], utility: str, amount: str, least: float = 1e-9) -> DataFrame:
    """choices with `flow`: the amount of each key split over its destinations by exp(utility); flows below `least` go.

    Destinations that are not open to a key are rows that are not there.
    """
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(utility) - F.max(utility).over(w))
    return choices.withColumn("_e", e).withColumn("flow", F.col(amount) * F.col("_e") / F.sum("_e").over(w)).drop("_e").where(F.col("flow") >= least)


def fit(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """mae and rmse."""
    error = F.col(predicted) - F.col(actual)
    return rows.agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))


def calibrate(objective: Callable[[np.ndarray], float], low: np.ndarray, high: np.ndarray, seed: int = 42, size: int = 24, rounds: int = 120) -> tuple[np.ndarray, float]:
    """The best parameters between low and high by differential evolution; the objective works on a table of sites, small by nature."""
    rng = np.random.default_rng(seed)
    people = low + rng.random((size, len(low))) * (high - low)
    scores = np.array([objective(p) for p in people])
    for _ in range(rounds):
        best = people[scores.argmin()]
        for i in range(size):
            a, b = people[rng.choice(size, 2, replace=False)]
            mutant = np.clip(people[i] + 0.7 * (best - people[i]) + 0.7 * (a - b), low, high)
            trial = np.where(rng.random(len(low)) < 0.8, mutant, people[i])
            if (s := objective(trial)) < scores[i]:
                people[i], scores[i] = trial, s
        if scores.max() - scores.min() < 1e-10:
            break
    return people[scores.argmin()], float(scores.min())


def curvature(objective: Callable[[np.ndarray], float], at: np.ndarray, step: float = 1e-3) -> tuple[np.ndarray, float]:
    """The matrix of second differences at a point, and its condition number."""
    n, f0 = len(at), objective(at)
    eye = np.eye(n) * step
    h = np.array([[(objective(at + eye[i] + eye[j]) - objective(at + eye[i] - eye[j]) - objective(at - eye[i] + eye[j]) + objective(at - eye[i] - eye[j])) / (4 * step * step) if i != j else (objective(at + eye[i]) - 2 * f0 + objective(at - eye[i])) / (step * step) for j in range(n)] for i in range(n)])
    return h, float(np.linalg.cond(h))
