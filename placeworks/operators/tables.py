"""Relational building blocks: dense counts, deltas, ranks, shares, latest rows, top-k, set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def dense(dimension: DataFrame, measured: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A row for each key of the dimension, with 0 for measures that are missing."""
    return dimension.join(measured, key, "left").fillna(0, subset=list(columns))


def merge_columns(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tables of the same keys side by side; the first one's rows stay."""
    return reduce(lambda a, b: a.join(b, list(keys), "left"), parts)


def supplement(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """base with those columns of `more` that it lacks."""
    new = [c for c in more.columns if c not in base.columns]
    return base.join(more.select(key, *new), key, "left") if new else base


def against_baseline(rows: DataFrame, keys: Sequence[str], scenario: str, value: str, baseline: str = "baseline") -> DataFrame:
    """rows with the baseline scenario's value of the same keys, and the difference."""
    w = Window.partitionBy(*keys)
    base = F.max(F.when(F.col(scenario) == baseline, F.col(value))).over(w)
    return rows.withColumn("baseline", base).withColumn("delta", F.col(value) - F.col("baseline"))


def first_row(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: the first in the given order, which has to be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rank_min(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from the largest, equals sharing the least; for tables of sites, whose number bounds the one partition."""
    return rows.withColumn(name, F.rank().over(Window.orderBy(F.col(value).desc())).cast("long"))


def share_of(rows: DataFrame, keys: Sequence[str], value: str, fallback: str) -> Column:
    """A row's share of its parent's total, of the fallback's where that is 0; 1 at most."""
    w = Window.partitionBy(*keys)
    total, other = F.sum(value).over(w), F.sum(fallback).over(w)
    share = F.when(total > 0, F.col(value) / F.when(total > 0, total)).otherwise(F.when(other > 0, F.col(fallback) / F.when(other > 0, other)).otherwise(0.0))
    return F.least(share, F.lit(1.0))


def change_from_first(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Percent change from the first period, to one digit."""
    first = F.first(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("pct_change", F.round((F.col(value) - first) / first * 100, 1))


def zscores(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with z: the value standardised over distinct keys with a value above 0, by the population's deviation; others get the mean, so 0."""
    good = rows.select(key, value).distinct().where(F.col(value) > 0)
    stats = good.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.when((F.col(value) > 0) & (F.col("_sd") > 0), (F.col(value) - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd"))).otherwise(0.0)
    return rows.crossJoin(F.broadcast(stats)).withColumn("z", z).drop("_mean", "_sd")  # one row of two numbers


def cascade(rows: DataFrame, key: str, sources: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """rows with the columns of the first source that has the key, and the source's number; null where none has it."""
    out = rows
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.struct(*columns, F.lit(i).cast("long").alias("source")).alias(f"_s{i}")), key, "left")
    found = F.coalesce(*[F.col(f"_s{i}") for i in range(len(sources))])
    return out.select(*rows.columns, *[found[c].alias(c) for c in [*columns, "source"]])


def undirected(edges: DataFrame, order: str) -> DataFrame:
    """One of the edges (u, v) between two nodes in either direction: the first in order."""
    ends = edges.withColumn("lo", F.least("u", "v")).withColumn("hi", F.greatest("u", "v"))
    return first_row(ends, ["lo", "hi"], [F.col(order)])


def bidirectional(edges: DataFrame) -> DataFrame:
    """edges (u, v, ...) with the missing reverses, which keep all other columns of the edge."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in edges.columns if c not in ("u", "v")])
    return edges.unionByName(back.join(edges.select("u", "v"), ["u", "v"], "left_anti"))


def set_equality(a: DataFrame, key: str, b: DataFrame, other: str) -> DataFrame:
    """One row: how many keys of a are not in b (missing), how many of b are not in a (unknown), and whether none is."""
    mine, theirs = a.select(F.col(key).alias("k")).distinct(), b.select(F.col(other).alias("k")).distinct()
    told = mine.withColumn("s", F.lit(1)).unionByName(theirs.withColumn("s", F.lit(2))).groupBy("k").agg(F.sum("s").alias("s"))
    out = told.agg(F.count_if(F.col("s") == 1).alias("missing"), F.count_if(F.col("s") == 2).alias("unknown"))
    return out.withColumn("equal", F.col("missing") + F.col("unknown") == 0)


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows with their place, from 0, in an order that has to be total: one range exchange, and a row for each partition to number them."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))  # partitions, not rows
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33)).cast("long")).drop("_part", "_at", "_before")


def placed_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with their place, from 1, among those of the same keys (null ones are a key as well), in an order that has to be total.

    Places are those of the whole table less what comes before the key, so the rows of one key are in as many tasks as they fill.
    """
    out = numbered(rows, [*keys, *order], name)
    first = out.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(name).alias("_first"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return out.join(first, same).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first", *[f"_k{i}" for i in range(len(keys))])


def carried_forward(lines: DataFrame, order: str, header: Column, name: str) -> DataFrame:
    """Each line with the last header up to it. Lines are sorted in ranges; what a range begins with comes from the ranges before."""
    placed = cut(lines.withColumn("_h", header).repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    ends = placed.groupBy("_part").agg(F.max(F.when(F.col("_h").isNotNull(), F.struct(order, "_h"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("_part", before["_h"].alias("_before"))  # partitions, not lines
    own = F.last("_h", ignorenulls=True).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.coalesce(own, "_before")).drop("_h", "_part", "_before")
