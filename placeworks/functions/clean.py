"""Cleaning of text fields as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typos of street names, residential land-use prefixes and flood zone codes.
ADDRESS_TYPOS = (("Erwin Toad", "Erwin Road"), ("Weaver Diary", "Weaver Dairy"), ("Martin Luther Kind", "Martin Luther King"))
RESIDENTIAL_PREFIXES = ("100", "110", "120", "630", "EXHA", "EXED")
FLOOD_100 = ("A", "AE", "AO", "AH")


def money(value: Column) -> Column:
    """The number in a text such as "$1,234"; null where there is none."""
    return F.regexp_replace(value, "[$,]", "").try_cast("double")


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def is_residential(code: Column) -> Column:
    return F.coalesce(code, F.lit("")).rlike("^(" + "|".join(RESIDENTIAL_PREFIXES) + ")")


def is_improved(status: Column) -> Column:
    return F.coalesce(F.lower(status).contains("improved"), F.lit(False))


def flood_class(zone: Column, subtype: Column) -> Column:
    """100, 500 or null."""
    return F.when(zone.isin(*FLOOD_100), 100).when(F.coalesce(subtype, F.lit("")).rlike("(?i)0.2 PCT"), 500)


def parent_geoid(geoid: Column, digits: int = 12) -> Column:
    return F.substring(geoid, 1, digits)


def latest_number(columns: Sequence[tuple[int, Column]]) -> Column:
    """(value, year) of the last year, of (year, text) pairs, whose text is a number other than "0"; null if none is."""
    found = []
    for year, text in sorted(columns, key=lambda c: -c[0]):
        clean = F.trim(F.regexp_replace(text, ",", ""))
        number = F.when(~clean.isin("", "0"), clean.try_cast("double"))
        found.append(F.when(number.isNotNull(), F.struct(number.alias("value"), F.lit(year).alias("year"))))
    return F.coalesce(*found)


def fix_address(address: Column, replacements: Sequence[tuple[str, str]] = ADDRESS_TYPOS) -> Column:
    """Known typos replaced, and two house numbers joined by "and" or a dash cut to the first."""
    out = F.trim(address)
    for wrong, right in replacements:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.trim(F.regexp_replace(out, r"^([0-9]+)(?:\s+and\s+|\s*-\s*)[0-9]+\s+", "$1 "))


def interpreted_date(value: Column) -> Column:
    """The date that a number stands for: a year, or milliseconds since 1970; null for other texts."""
    number = value.try_cast("long")
    return F.when(number.between(1000, 9999), F.make_date(number.cast("int"), F.lit(1), F.lit(1))).otherwise(F.to_date(F.timestamp_millis(number)))


def guarded_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is not positive."""
    return F.when(whole > 0, part / F.when(whole > 0, whole) * 100).otherwise(F.lit(0.0))
