"""Places and moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.numbers import haversine_km


def conflicts(stays: DataFrame, least_km: float) -> DataFrame:
    """Pairs of one person's stays at different places that overlap in time and are further apart than ``least_km``. A missing bound overlaps all."""
    a, b = (stays.select("person_id", *[F.col(c).alias(f"{c}_{s}") for c in ("place_id", "since", "until", "lat", "lon")]) for s in "ab")
    overlap = (F.col("since_a").isNull() | F.col("until_b").isNull() | (F.col("since_a") <= F.col("until_b"))) & (F.col("since_b").isNull() | F.col("until_a").isNull() | (F.col("since_b") <= F.col("until_a")))
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.join(b, "person_id").where("place_id_a < place_id_b").where(overlap).withColumn("km", F.round(km, 3)).where(F.col("km") > least_km).select("person_id", "place_id_a", "place_id_b", "km")


def moves(visits: DataFrame) -> DataFrame:
    """Consecutive visits of a person at different places."""
    w = Window.partitionBy("person_id").orderBy("seen_at", "visit_id")
    v = visits.select("person_id", F.lag("place_id").over(w).alias("from_place"), F.col("place_id").alias("to_place"), "seen_at", "visit_id")
    return v.where("from_place IS NOT NULL AND from_place <> to_place")


def cells(lat: str, lon: str, degrees: float):
    """The cell of a grid over latitude and longitude, as two columns; an equi-join key for nearness and a key to prune by."""
    return F.floor((F.col(lat) + 90) / degrees).alias("cell_lat"), F.floor((F.col(lon) + 180) / degrees).alias("cell_lon")


def within(points: DataFrame, key: str, km: float) -> DataFrame:
    """a, b (a < b) of points (key, lat, lon) at most ``km`` apart, by great circles.

    Points meet in cells of latitude of the radius' height; the neighbours below and above are looked at too, and
    longitude is left to the exact distance near the poles and across the date line, where cells of it mean little.
    """
    degrees = km / 111.0
    wide = lambda lat: F.least(F.lit(180.0), degrees / F.greatest(F.lit(1e-9), F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + degrees)))))
    p = points.select(F.col(key).alias("k"), "lat", "lon", F.floor((F.col("lat") + 90) / degrees).alias("band"))
    a = p.select(F.col("k").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    apart = F.abs(F.col("lon1") - F.col("lon"))
    met = a.join(p, "band").where(F.col("a") < F.col("k")).where(F.least(apart, 360 - apart) <= F.greatest(wide(F.col("lat1")), wide(F.col("lat"))))
    return met.where(haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")) <= km).select("a", F.col("k").alias("b"))
