"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

MAX_ROUNDS = 60


def _pointed(edges: DataFrame, minima: DataFrame) -> DataFrame:
    # Both sides are plain scans, so a node with very many edges is a skewed
    # join that adaptive execution splits.
    return edges.join(written(minima, "minima"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    minima = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _pointed(both, minima).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    minima = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _pointed(edges, minima).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(minima.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Null ends and loops are left out; an empty table gives an empty table. With
    `rounds` it stops after so many: equal components are then reachable from
    each other, but a component may still be in several parts.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = written(now.distinct(), "edges")
    if rounds is not None:
        for _ in range(rounds):
            now = written(_large_star(now).distinct(), "edges")
            now = written(_small_star(now).distinct(), "edges")
        # A node can still point at several; the least of them is its label.
        labels = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return labels.unionByName(tops.join(labels.select("node"), "node", "left_anti"))
    before = _state(now)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        now = written(_large_star(now).distinct(), "edges")
        now = written(_small_star(now).distinct(), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
