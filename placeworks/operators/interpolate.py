"""Demographic areal interpolation: parts of block groups in zones, blocks and pixels, by residential area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import guarded_percent
from . import shapes, spatial
from .cut import cut
from .tables import share_of


def _corners(df: DataFrame, p: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{p}{c}" for c in ("x1", "y1", "x2", "y2")})


def residential_area(areas: DataFrame, key: str, parcels: DataFrame, size: float) -> DataFrame:
    """key and the area of parcels inside each rectangle; those without any have 0."""
    met = spatial.overlay(_corners(areas.select(key, "x1", "y1", "x2", "y2"), "a"), _corners(parcels.select("x1", "y1", "x2", "y2"), "b"), size)
    return areas.select(key).join(met.groupBy(key).agg(F.sum("area").alias("residential")), key, "left").fillna(0.0, subset=["residential"])


def fragments(zones: DataFrame, groups: DataFrame, parcels: DataFrame, size: float) -> DataFrame:
    """(zone, bg, area, weight_area, weight): the parts of block groups in zones.

    weight_area is the part of the group's area; weight that of its parcels'
    area, or of its area where the group has no parcels.
    """
    met = spatial.overlay(_corners(zones.select("zone", "x1", "y1", "x2", "y2"), "a"), _corners(groups.select("bg", "x1", "y1", "x2", "y2"), "b"), size)
    parts = met.select("zone", "bg", "area", F.greatest("ax1", "bx1").alias("x1"), F.greatest("ay1", "by1").alias("y1"), F.least("ax2", "bx2").alias("x2"), F.least("ay2", "by2").alias("y2"))
    parts = parts.withColumn("part", F.struct("zone", "bg"))
    inside = residential_area(parts, "part", parcels, size)
    whole = residential_area(groups, "bg", parcels, size).withColumnRenamed("residential", "total")
    joined = parts.join(inside, "part").join(whole, "bg").join(groups.select("bg", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("whole")), "bg")
    by_area = F.least(F.col("area") / F.col("whole"), F.lit(1.0))
    dasymetric = F.when(F.col("total") > 0, F.least(F.col("residential") / F.when(F.col("total") > 0, F.col("total")), F.lit(1.0))).otherwise(by_area)
    return joined.select("zone", "bg", "area", by_area.alias("weight_area"), dasymetric.alias("weight"))


def zone_sums(parts: DataFrame, groups: DataFrame, counts: Sequence[str], median: str, weight: str = "weight") -> DataFrame:
    """Weighted sums of the groups' counts by zone, and the mean of their medians, by population, over those above 0."""
    joined = parts.join(groups, "bg")
    w = F.col(weight)
    valid = F.when(F.col(median) > 0, w * F.col("population"))
    sums = [F.sum(F.col(c) * w).alias(c) for c in counts]
    mean = F.try_divide(F.sum(valid * F.col(median)), F.sum(valid)).alias(median)
    return joined.groupBy("zone").agg(*sums, mean)


def downscale(blocks: DataFrame, groups: DataFrame, parent: str, counts: Sequence[str]) -> DataFrame:
    """blocks (residential, area) with their share of each of the parent's counts and `share` itself."""
    told = blocks.withColumn("share", share_of(blocks, [parent], "residential", "area"))
    return told.join(groups, parent, "left").select(*told.columns, *[(F.coalesce(F.col(c), F.lit(0)) * F.col("share")).alias(c) for c in counts])


def derived_metrics(rows: DataFrame, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rows with a guarded percent column for each (part, whole)."""
    return rows.withColumns({name: guarded_percent(part, whole) for name, (part, whole) in parts.items()})


def dots(blocks: DataFrame, counts: Sequence[str], per_dot: int, least_area: float) -> DataFrame:
    """A row for each dot: count div per_dot of them in each block and category, placed inside the block's rectangle.

    Places come from hashes of block, category and number, so every run puts
    them at the same place; blocks smaller than least_area get none.
    """
    big = blocks.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= least_area)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.floor(F.col(c) / per_dot).cast("long").alias("n")) for c in counts]))
    rows = big.select("block", "x1", "y1", "x2", "y2", each.alias("e")).where("e.n > 0")
    rows = rows.select("block", "x1", "y1", "x2", "y2", "e.category", F.explode(F.sequence(F.lit(1).cast("long"), F.col("e.n"))).alias("dot"))
    uniform = lambda axis: F.pmod(F.xxhash64("block", "category", "dot", F.lit(axis)), F.lit(1 << 30)) / float(1 << 30)
    x, y = (F.col(f"{a}1") + uniform(a) * (F.col(f"{a}2") - F.col(f"{a}1")) for a in "xy")
    return rows.select("block", "category", "dot", x.alias("x"), y.alias("y"))


def placement(areas: DataFrame, homes: DataFrame, key: str, home: str, size: float, least_area: float = 10.0) -> DataFrame:
    """Where the dots of each area may lie: disjoint trapezoids (key, l, r, ...) of what it shares with homes, which may overlap.

    An area that shares no more than least_area with them is taken whole; one
    that is smaller than that itself has no place. areas and homes are
    trapezoids as `shapes` makes them, those of an area disjoint.
    """
    shared = shapes.intersect(areas, homes, [key], [home], size).select(key, *shapes.PLACES)
    inside = cut(shapes.covered(shared, key, size))
    large = lambda traps, enough: traps.groupBy(key).agg(F.sum(shapes.area_of()).alias("area")).where(enough).select(key)
    settled = large(inside, F.col("area") > least_area)
    whole = areas.select(key, *shapes.PLACES).join(settled, key, "left_anti")
    whole = whole.join(large(whole, F.col("area") >= least_area), key, "left_semi")
    return inside.join(settled, key, "left_semi").unionByName(whole)


def placed_dots(places: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(key, category, dot, x, y): n dots of each (key, category, n) inside the disjoint trapezoids of the key, as many in each as its area asks for.

    A trapezoid takes the dots whose numbers fall on its part of the area, so
    counts come out exactly and no dot is searched for. Inside it a dot is
    placed by hashes of key, category and number, evenly by area; every run
    puts it at the same place. Keys without trapezoids get no dots.
    """
    order = Window.partitionBy(key).orderBy(*shapes.PLACES)
    parts = places.withColumn("_area", shapes.area_of()).where("_area > 0")
    parts = parts.withColumn("_upto", F.sum("_area").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumns({"_from": F.coalesce(F.lag("_upto").over(order), F.lit(0.0)), "_total": F.max("_upto").over(Window.partitionBy(key))})
    uniform = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)
    rows = parts.join(counts.where("n > 0").select(key, "category", "n"), key)
    number = lambda c: F.floor(F.col(c) / F.col("_total") * F.col("n") + uniform(key, "category")).cast("long")
    rows = rows.withColumns({"_first": number("_from") + 1, "_last": number("_upto")}).where("_first <= _last")
    rows = rows.select(key, "category", *shapes.PLACES, F.explode(F.sequence("_first", "_last")).alias("dot"))
    # The place along the base at which the wanted part of the trapezoid's area is on the left.
    left, right = (shapes.height("t", F.col(c)) - shapes.height("b", F.col(c)) for c in "lr")
    u = uniform(key, "category", "dot", F.lit("x"))
    part = F.coalesce(F.try_divide(u * (left + right), left + F.sqrt(left * left + u * (right * right - left * left))), F.lit(0.0))
    rows = rows.withColumn("x", F.least(F.col("l") + part * (F.col("r") - F.col("l")), F.col("r")))
    low, high = (shapes.height(line, F.col("x")) for line in "bt")
    return rows.select(key, "category", "dot", "x", (low + uniform(key, "category", "dot", F.lit("y")) * (high - low)).alias("y"))
