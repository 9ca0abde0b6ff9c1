"""Distances and boxes on the globe, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES, METRES_PER_MILE = 3958.8, 1609.344


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(a))


def plausible(lat: Column, lng: Column) -> Column:
    """In the box around North America; NaN is on neither side of a bound here."""
    return F.coalesce((lat > 17) & (lat < 72) & (lng > -180) & (lng < -64) & (lat != 0) & (lng != 0), F.lit(False))


def in_box(lat: Column, lng: Column, south: Column, north: Column, west: Column, east: Column, pad: float = 0.5) -> Column:
    """True too where the box isn't known."""
    return F.coalesce(lat.between(south - pad, north + pad) & lng.between(west - pad, east + pad), F.lit(True))


def grid_cell(lat: Column, lng: Column, degrees: float) -> tuple[Column, Column]:
    return F.floor(lat / degrees).cast("int"), F.floor(lng / degrees).cast("int")


def heat(count: Column) -> Column:
    return F.log1p(count)
