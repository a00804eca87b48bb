"""Batch geocoding without the network: request files in chunks, parsed responses, a second city for what is unmatched, a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import tables

# Fixed values of the batch service: rows in a request, fields that a matched line has at least, what it calls a match.
CHUNK, FIELDS, MATCHES = 1000, 6, ("Match", "Exact")


def requests(rows: DataFrame, key: str, address: str, city: str, state: str, size: int = CHUNK) -> DataFrame:
    """(chunk, n, content): request files of `size` addresses at most, a line `key,"address",city,state,` each, without an address none.

    Rows are counted inside their partitions, so nothing is numbered in one task; the last chunk of each is a smaller one.
    """
    place = F.monotonically_increasing_id()
    line = F.concat(F.col(key).cast("string"), F.lit(',"'), F.replace(F.trim(address), F.lit('"'), F.lit("")), F.lit(f'",{city},{state},'))
    told = rows.where(F.col(key).isNotNull() & (F.trim(address) != "")).select(F.col(key).alias("_k"), line.alias("_line"), place.alias("_at"))
    chunk = F.struct(F.shiftright("_at", 33).alias("part"), F.expr(f"(_at & {(1 << 33) - 1}) div {size}").alias("number"))
    lines = F.array_sort(F.collect_list(F.struct("_k", "_line")))
    return told.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), F.concat_ws("\n", F.transform(lines, lambda s: s["_line"])).alias("content"))


def parsed(lines: DataFrame, column: str, key: str) -> DataFrame:
    """(key, lat, lon) of the matched lines of responses; blank, short and unmatched ones, and those with other than two numbers for a place, have none.

    Where a key has several, the least (lat, lon) is taken.
    """
    bare = lambda c: F.btrim(c, F.lit('"'))
    parts = lines.select(F.transform(F.split(F.trim(column), '","'), bare).alias("p")).where(F.size("p") >= FIELDS)
    place = F.split(F.get("p", F.lit(5)), ",")
    number = lambda i: F.get(place, F.lit(i)).try_cast("double")
    found = parts.where(F.get("p", F.lit(2)).isin(*MATCHES) & (F.size(place) == 2)).select(F.get("p", F.lit(0)).try_cast("long").alias(key), number(1).alias("lat"), number(0).alias("lon"))
    return found.dropna().groupBy(key).agg(F.min(F.struct("lat", "lon")).alias("at")).select(key, "at.lat", "at.lon")


def unmatched(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """What the next request asks for."""
    return rows.join(found.select(key), key, "left_anti")


def geocoded(rows: DataFrame, key: str, answers: Sequence[DataFrame]) -> DataFrame:
    """rows with lat, lon and source, the number of the first of the answers (key, lat, lon) that has them; null where none has."""
    return tables.cascade(rows, key, answers, ["lat", "lon"])


def report(places: DataFrame, inside: Column) -> DataFrame:
    """(source, n, share, n_inside) by source, null for what was not found: rows, their part of all, and those in the district."""
    by = places.groupBy("source").agg(F.count("*").alias("n"), F.count_if(inside & F.col("lat").isNotNull()).alias("n_inside"))
    total = places.agg(F.count("*").alias("_all"))  # one row
    return by.join(F.broadcast(total)).select("source", "n", (F.col("n") / F.col("_all")).alias("share"), "n_inside")
