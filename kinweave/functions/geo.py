"""Coordinates: validity, distance, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radius of the earth, and the distance from which on places have nothing in common, in metres.
EARTH, FAR = 6_371_000, 150_000


def valid(lat: Column, lon: Column) -> Column:
    """Whether both are there and in range."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a great circle, by haversines."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    a = half(lat1, lat2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) ** 2
    return 2 * EARTH * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def similarity(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """1 at the same place, 0 from FAR on, null where a side is invalid."""
    d = distance(lat1, lon1, lat2, lon2)
    return F.when(valid(lat1, lon1) & valid(lat2, lon2), F.when(d >= FAR, F.lit(0.0)).otherwise(F.round(1 - d / FAR, 6)))
