"""Inputs of the enrolment model: two crosswalks, and the checks that stop a run on tables that do not belong together."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import readers

#: Fragments of less weight have no children that count.
LEAST_WEIGHT = 1e-6
#: Names that an error lists.
NAMED = 20


def enrolment_inputs(
    fragments: DataFrame, zones: dict[str, str], counts: DataFrame, schools: dict[str, str], year: str, total_row: str, known: Collection[str], homes: Collection[str], total: int
) -> tuple[DataFrame, DataFrame]:
    """Fragments (zone, weight, ...) with `school`, their zone's canonical name, and (school, students) of one year of counts (name, a column a year).

    Fragments of zones that the crosswalk does not know, or without weight, are
    dropped; so is the row of counts that holds the total. ValueError where a
    row of counts has no canonical name or no whole number, two have the same
    one, the schools are not `known`, those of fragments are not `homes`, or
    the students do not add up to `total`. Counts have a row for each school;
    of fragments only the distinct names are looked at.
    """
    rows = counts.where(F.col("name").isNull() | (F.col("name") != total_row))
    told = rows.join(F.broadcast(_crosswalk(rows, schools)), "name", "left").select("name", "school", F.col(f"`{year}`").try_cast("long").alias("students"))
    _stop("without a canonical name", told.where("school IS NULL").select("name"))
    _stop(f"without students in {year}", told.where("students IS NULL").select("name"))
    _stop("told twice", told.groupBy("school").count().where("count > 1").select("school"))
    _same("schools", told, known)
    kept = readers.canonical(fragments, zones, "zone").withColumnRenamed("canonical", "school").where(F.col("weight") > LEAST_WEIGHT)
    _same("homes of fragments", kept, homes)
    found = told.agg(F.sum("students")).first()[0] or 0
    if found != total:
        raise ValueError(f"students of {year} add up to {found}, not to {total}")
    return kept, told.select("school", "students")


def _crosswalk(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.sparkSession.createDataFrame(list(names.items()), "name string, school string")  # literals


def _stop(what: str, rows: DataFrame) -> None:
    if bad := [r[0] for r in rows.limit(NAMED).collect()]:
        raise ValueError(f"{what}: {bad}")


def _same(what: str, rows: DataFrame, names: Collection[str]) -> None:
    """ValueError unless the schools of rows are these names; of others NAMED at most are fetched."""
    found = rows.select("school").distinct()
    strange = [r.school for r in found.where(~F.col("school").isin(list(names))).limit(NAMED).collect()]
    there = {r.school for r in found.where(F.col("school").isin(list(names))).collect()}
    if strange or there != set(names):
        raise ValueError(f"{what}: unknown {strange}, missing {sorted(set(names) - there)}")
