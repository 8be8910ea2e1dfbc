"""Numeric scalars as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Two sites of the 95 % interval use two roundings.
Z95, Z95_LONG = 1.96, 1.959964


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of a rate; both 0 for no trials. The half width is cut where it would leave 0 to 1."""
    p, d = hits / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def backoff_seconds(attempts: Column) -> Column:
    return F.pow(F.lit(2.0), F.least(attempts, F.lit(10)))
