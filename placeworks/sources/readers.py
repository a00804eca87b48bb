"""Sources: typed records, boxes of places, rasters, networks, paged JSON, texts and pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import blank_to_null
from .sinks import FORMATS


def records(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """A CSV with a header, of the given schema; blanks are null, rows without a required field go. Identifiers should be strings."""
    wanted = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
    raw = spark.read.schema(text).csv(path, header=True, multiLine=True, escape='"')
    out = raw.select(*[_typed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in wanted.fields])
    return out.dropna(subset=list(required)) if required else out


def _typed(text: Column, kind: T.DataType) -> Column:
    clean = blank_to_null(text)
    if isinstance(kind, T.StringType):
        return clean
    if isinstance(kind, T.BooleanType):
        return F.lower(clean) == "true"
    return clean.try_cast(kind.simpleString())


def either(paths: Sequence[str], read: Callable[[str], DataFrame]) -> DataFrame | None:
    """What the first of the paths that is there holds, older places last; None where none is."""
    for path in paths:
        try:
            return read(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def geocoded(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Records geocoded before, from the first of the paths that is there, with `geocoded` false where it is not said; no rows where no path is."""
    found = either(paths, lambda path: records(spark, path, schema))
    rows = spark.createDataFrame([], schema) if found is None else found
    return rows.withColumn("geocoded", F.coalesce("geocoded", F.lit(False)))


def unpacked(rows: DataFrame, keys: Sequence[str], kind: str = "f4", data: str = "data") -> DataFrame:
    """keys, pos (from 0) and value of the numbers in base64 that `sinks.packed` writes; NaN is null, and data that is null has no rows."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [None if d is None else np.frombuffer(d, FORMATS[kind]).astype(np.float64) for d in batch["_data"].to_pylist()]
            values = pa.array([None if v is None else np.where(np.isnan(v), None, v).tolist() for v in told], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), values], names=[*keys, "_values"])

    fields = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    lists = rows.select(*keys, F.unbase64(data).alias("_data")).mapInArrow(run, f"{fields}_values array<double>")
    return lists.select(*keys, F.posexplode("_values").alias("pos", "value"))


def in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Rows of a Parquet table whose box meets the given one; the comparisons reach the scan and skip row groups."""
    x1, y1, x2, y2 = (F.col(c) for c in columns)
    return spark.read.parquet(path).where((x1 <= box[2]) & (x2 >= box[0]) & (y1 <= box[3]) & (y2 >= box[1]))


def raster_window(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int], step: int = 1) -> DataFrame:
    """Cells (row, col, class) of a window, every step-th of them, without nodata (0)."""
    window = cells.where(F.col("row").between(*rows) & F.col("col").between(*cols) & (F.col("class") > 0))
    return window.where((F.col("row") % step == 0) & (F.col("col") % step == 0)) if step > 1 else window


def mosaic(tiles: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Tiles as one table; what several hold is kept once."""
    return reduce(DataFrame.unionByName, tiles).dropDuplicates(list(key))


def pages(spark: SparkSession, path: str, items: str, fields: str) -> DataFrame:
    """Items of JSON pages (a document a file, each with an array of items), a task for each group of files; repeated ones stay."""
    wanted = spark.read.schema(f"`{items}` array<{fields}>").json(path, multiLine=True)
    return wanted.select(F.inline(items))


def census(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of arrays as a map from the names in its first row; numbers are left as text."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("a"))
    told = F.transform(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), lambda r: F.map_from_arrays(F.get("a", F.lit(0)), r))
    return rows.select(F.explode(told).alias("row"))


def embedded_json(spark: SparkSession, path: str, variable: str, schema: str) -> DataFrame:
    """The value of a script variable in HTML pages: `const name = {...};` on one line."""
    text = spark.read.text(path).select(F.regexp_extract("value", rf"(?:const|let|var)\s+{variable}\s*=\s*(.*?);\s*$", 1).alias("v")).where("v != ''")
    return text.select(F.from_json("v", schema).alias("value"))


def network(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of Parquet tables; the first of several classes of an edge counts."""
    e = spark.read.parquet(edges)
    if isinstance(e.schema["highway"].dataType, T.ArrayType):
        e = e.withColumn("highway", F.get("highway", F.lit(0)))
    return spark.read.parquet(nodes), e


def known_names(rows: DataFrame, names: dict[str, str], column: str, order: str) -> tuple[DataFrame, DataFrame]:
    """rows whose name is in the crosswalk, under its canonical name and once each; and the canonical names that no row has."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(names.items()), f"{column} string, canonical string")  # a crosswalk of literals
    found = rows.join(F.broadcast(table), column).withColumn("_k", F.struct(order))
    first = found.groupBy("canonical").agg(F.min_by(F.struct(*rows.columns), "_k").alias("r")).select("canonical", "r.*")
    return first, table.select("canonical").distinct().join(first.select("canonical"), "canonical", "left_anti")


def canonical(rows: DataFrame, names: dict[str, str], column: str) -> DataFrame:
    """rows under `canonical`, what a crosswalk makes of their name; those it does not know, or without a name, are dropped."""
    table = rows.sparkSession.createDataFrame(list(names.items()), f"{column} string, canonical string")  # a crosswalk of literals
    return rows.join(F.broadcast(table), column)
