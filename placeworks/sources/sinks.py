"""Sinks: CSV files, GeoJSON lines, packed number columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number formats of packed columns.
FORMATS = {"f4": "<f4", "i2": "<i2", "i1": "<i1", "u4": "<u4"}


def to_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """A CSV folder with headers; `single` makes one file of a small result."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True)


def by_place(rows: DataFrame, path: str, columns: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), bits: int = 16, group_bytes: int = 8 << 20) -> None:
    """A Parquet folder whose row groups hold boxes near each other, so that `readers.in_box` skips nearly all of them.

    Rows are ordered by the middle of their box along a Z-shaped curve, `bits`
    deep in either direction; rows without a box come first. What tells the
    groups apart are the least and greatest values that Parquet keeps of the
    four columns.
    """
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in columns)
    middles = ((x1 + x2) / 2, (y1 + y2) / 2)
    ends = rows.agg(*[f(m) for m in middles for f in (F.min, F.max)]).first()
    code = F.lit(0).cast("long")
    for n, (m, lo, hi) in enumerate(zip(middles, ends[::2], ends[1::2], strict=True)):
        width = (hi - lo) if lo is not None and hi > lo else 1.0
        place = F.least(F.floor((m - F.lit(lo)) / F.lit(width) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
        for i in range(bits):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(place, i).bitwiseAND(F.lit(1).cast("long")), 2 * i + n))
    # Other columns may be called anything, so the code has a name of its own only while rows are ordered.
    boxed = rows.select(F.struct("*").alias("row"), code.alias("code"))
    placed = boxed.repartitionByRange("code").sortWithinPartitions("code").select("row.*")
    placed.write.option("parquet.block.size", group_bytes).mode("overwrite").parquet(path)


def rounded(ring: Column, digits: int = 6) -> Column:
    """The coordinates of a ring (array of structs x, y), rounded."""
    return F.transform(ring, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))


def geojson(rows: DataFrame, rings: str, properties: list[str], digits: int = 6) -> DataFrame:
    """A feature, as JSON, for each row with a polygon of rings."""
    closed = F.transform(rings, lambda r: rounded(F.concat(r, F.slice(r, 1, 1)), digits))
    geometry = F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def packed(rows: DataFrame, keys: list[str], order: str, value: str, kind: str = "f4") -> DataFrame:
    """keys and `data`: the values of each key in order, as base64 of little-endian numbers; nulls are NaN, or 0 in whole numbers."""
    lists = rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for values in batch["_v"].to_pylist():
                x = np.array([np.nan if v is None else v for v in values], np.float64)
                data.append((x if kind == "f4" else np.nan_to_num(x).round()).astype(FORMATS[kind]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(data, pa.binary())], names=[*keys, "data"])

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return lists.mapInArrow(run, f"{fields}, data binary").withColumn("data", F.base64("data"))
