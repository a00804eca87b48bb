"""Profiles of columns: completeness, categories, quantiles, histograms, repeated places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut

QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
#: Values of a key that one task may hold, and parts into which an interval of more is counted.
MANY, BINS = 100_000, 1024


def completeness(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: rows, nulls, blanks after trimming, populated, and percent populated; one pass."""
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    by = rows.select(told.alias("x")).groupBy(F.col("x.column").alias("column"))
    out = by.agg(
        F.count("*").alias("n"), F.count_if(F.col("x.value").isNull()).alias("n_null"), F.count_if(F.trim("x.value") == "").alias("n_blank")
    ).withColumn("n_populated", F.col("n") - F.col("n_null") - F.col("n_blank"))
    return out.withColumn("pct", F.round(F.col("n_populated") / F.col("n") * 100, 1))


def categories(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value and n; a null is a value of its own."""
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(told.alias("x")).groupBy(F.col("x.column").alias("column"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def quantiles(rows: DataFrame, value: str, by: Sequence[str] = (), probabilities: dict[str, float] = QUANTILES, digits: int = 6, weight: str | None = None) -> DataFrame:
    """Interpolated quantiles of each key, rounded, as columns of the given names; nulls and NaN are left out, and a key of nothing else has nulls.
    A row stands for `weight` equal values, a whole number; one of none, or less, or null for nothing.

    Keys of up to MANY values are aggregated as they are; where one has more,
    values_at searches for the ranks.
    """
    number = F.col(value).cast("double")
    times = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("long") if weight else F.lit(1).cast("long")
    rows = rows.select(*by, F.when(~F.isnan(number) & (times > 0), number).alias("_v"), times.alias("_w"))
    counts = rows.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))), F.lit(0)).alias("_n"), F.count("_v").alias("_rows"))
    if (counts.agg(F.max("_rows")).first()[0] or 0) <= MANY:
        found = rows.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(q) for q in probabilities.values()]), F.col("_w")).alias("_q"))
        return found.select(*by, *[F.round(F.col("_q")[i], digits).alias(name) for i, name in enumerate(probabilities)])
    ends = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("_n") - 1)).alias("at")) for name, q in probabilities.items()]))
    wanted = cut(counts.where("_n > 0").select(*by, ends.alias("e")).select(*by, "e.*"))
    places = wanted.select(*by, F.explode(F.array(F.floor("at").cast("long"), F.ceil("at").cast("long"))).alias("place")).distinct()
    values = values_at(rows, "_v", by, places, "_w")
    low = values.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("place").alias("_low"), F.col("value").alias("low"))
    high = values.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("place").alias("_high"), F.col("value").alias("high"))
    same = lambda: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    out = wanted.join(low, [*same(), F.floor("at") == F.col("_low")]).drop(*[f"_{c}" for c in by]).join(high, [*same(), F.ceil("at") == F.col("_high")]).drop(*[f"_{c}" for c in by])
    told = F.round(F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at")), digits)
    out = out.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, told)).alias(name) for name in probabilities])
    if not by:
        return out
    every = counts.select(*[F.col(c).alias(f"_{c}") for c in by])
    return every.join(out, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").select(*[F.col(f"_{c}").alias(c) for c in by], *probabilities)


def values_at(rows: DataFrame, value: str, by: Sequence[str], places: DataFrame, weight: str | None = None) -> DataFrame:
    """(by, place, value) of places (by, place) in the sorted values of each key, from 0; a row stands for `weight` equal values.

    The values of a key never meet in one task: each round counts them in BINS
    equal parts of the interval that holds a place, and goes on with the part
    that the place is in, until an interval has MANY distinct rows at most or
    one value.
    """
    key = F.struct(*by) if by else F.lit(0)
    rows = rows.select(key.alias("_k"), F.col(value).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).where("v IS NOT NULL AND NOT isnan(v) AND w > 0")
    spans = rows.groupBy("_k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("inside")).withColumnRenamed("_k", "_s")
    now = cut(places.select(key.alias("_k"), "place").join(spans, F.col("_k").eqNullSafe(F.col("_s"))).select("_k", "place", "lo", "hi", "inside", F.lit(0).cast("long").alias("below")))
    while True:
        open_ = now.where((F.col("inside") > MANY) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        # An interval for each key and place at most, so few.
        spans = open_.select(F.col("_k").alias("_s"), "lo", "hi").distinct()
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        counted = rows.join(spans, F.col("_k").eqNullSafe(F.col("_s")) & F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("_s", "lo", "hi", part.alias("part"))
        counted = counted.agg(F.sum("w").alias("n"), F.count("*").alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("n").over(Window.partitionBy("_s", "lo", "hi").orderBy("part")) - F.col("n")
        counted = counted.withColumn("before", before).withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
        met = open_.join(counted, F.col("_k").eqNullSafe(F.col("_s")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")))
        met = met.where((F.col("place") - F.col("below") >= F.col("before")) & (F.col("place") - F.col("below") < F.col("before") + F.col("n")))
        met = met.select("_k", "place", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("rows").alias("inside"), (F.col("below") + F.col("before")).alias("below"))
        now = cut(met.unionByName(now.where((F.col("inside") <= MANY) | (F.col("lo") >= F.col("hi")))))
    spans = now.select(F.col("_k").alias("_s"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
    held = rows.join(spans, F.col("_k").eqNullSafe(F.col("_s")) & F.col("v").between(F.col("_lo"), F.col("_hi"))).groupBy("_s", "_lo", "_hi", "v").agg(F.sum("w").alias("n"))
    held = held.withColumn("before", F.sum("n").over(Window.partitionBy("_s", "_lo", "_hi").orderBy("v")) - F.col("n"))
    at = F.col("place") - F.col("below")
    out = now.join(held, F.col("_k").eqNullSafe(F.col("_s")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (at >= F.col("before")) & (at < F.col("before") + F.col("n")))
    return out.select(*[F.col(f"_k.{c}").alias(c) for c in by], "place", F.col("v").alias("value"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int = 15) -> DataFrame:
    """bin and n of every bin; values below low are left out, those above high are in the last."""
    width = (high - low) / bins
    placed = rows.where(F.col(value) >= low).select(F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("long").alias("bin"))
    every = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(placed.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").fillna(0, subset=["n"])


def upper_median(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The value at half the count, from 0, of the sorted values: the greater of the middle two."""
    number = F.col(value).cast("double")
    places = rows.groupBy(*by).agg(F.floor(F.count_if(number.isNotNull() & ~F.isnan(number)) / 2).cast("long").alias("place"))
    return values_at(rows, value, by, places).select(*by, F.col("value").alias("median"))


def repeated_places(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n_rows at places that occur more than once, and n_places, their number."""
    many = rows.groupBy(x, y).agg(F.count("*").alias("n")).where("n > 1")
    return many.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count("*").alias("n_places"))
