"""Distances, cells and rectangles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3959.0
METERS_PER_DEGREE = 111320.0


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def equirectangular_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, center_lat: float) -> Column:
    """Metres by degrees scaled with the cosine of one latitude."""
    scale = F.cos(F.radians(F.lit(center_lat)))
    dx, dy = (lon2 - lon1) * scale * METERS_PER_DEGREE, (lat2 - lat1) * METERS_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def along_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The part of a segment, from 0 to 1, at which it is nearest to a point; 0 where it has no length."""
    length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    dot = (px - ax) * (bx - ax) + (py - ay) * (by - ay)
    return F.when(length2 > 0, F.least(F.greatest(dot / F.when(length2 > 0, length2), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = along_segment(px, py, ax, ay, bx, by)
    return planar(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def overlap_area(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """The area that two rectangles share."""
    width = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0.0))
    height = F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0.0))
    return width * height


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def cells_around(value: Column, size: float) -> Column:
    """The cell of a value and its two neighbours."""
    return F.array(*[cell(value, size) + F.lit(d) for d in (-1, 0, 1)])


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
