"""Index tables: written once, read in part. Results are those of a scan, but for the vector index, whose recall is measured."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import vectors
from kinweave.shared import scratch_path, written


def _cut(text):
    """Distinct character trigrams of lower-cased text, across words: what a substring search can ask for."""
    # by characters: substring() counts them from the front each time, which long texts would pay for squared
    chars = F.split(F.lower(text), "")
    joined = lambda x, y: F.concat(x, y)
    three = F.zip_with(F.zip_with(chars, F.slice(chars, 2, F.size(chars)), joined), F.slice(chars, 3, F.size(chars)), joined)
    return F.array_distinct(F.filter(three, lambda g: g.isNotNull()))


def postings(rows: DataFrame, key: str, text: str, buckets: int = 64) -> DataFrame:
    """A table of (bucket, gram, key), partitioned by bucket of the gram, so that a search reads the buckets of its grams alone."""
    spark = rows.sparkSession
    made = rows.select(F.explode(_cut(F.col(text))).alias("gram"), key).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    path = scratch_path(spark, "postings")
    # a gram that most rows hold is a large bucket; ranges of keys split it among tasks and files
    made.repartitionByRange(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket", "gram", key).write.partitionBy("bucket").parquet(path)
    return spark.read.parquet(path)


def holding(rows: DataFrame, index: DataFrame, key: str, text: str, phrase: str, buckets: int = 64) -> DataFrame:
    """Rows whose text holds the phrase (of three characters at least), whatever its case."""
    phrase = phrase.lower()
    grams = sorted({phrase[i : i + 3] for i in range(len(phrase) - 2)})
    if not grams:
        raise ValueError("three characters at least")
    spark = rows.sparkSession
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    where = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    met = index.where(F.col("bucket").isin(where) & F.col("gram").isin(grams)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select(key)
    return rows.join(met, key, "left_semi").where(F.contains(F.lower(F.col(text)), F.lit(phrase)))


def grid(points: DataFrame, lat: str, lon: str, degrees: float = 15.0) -> DataFrame:
    """Points in files by cell of latitude and longitude; points without a place are not kept."""
    spark = points.sparkSession
    path = scratch_path(spark, "grid")
    cells = {"cell_lat": F.floor((F.col(lat) + 90) / degrees).cast("int"), "cell_lon": F.floor((F.col(lon) + 180) / degrees).cast("int")}
    points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns(cells).write.partitionBy("cell_lat", "cell_lon").parquet(path)
    return spark.read.parquet(path)


def in_box(index: DataFrame, south: float, west: float, north: float, east: float, lat: str = "lat", lon: str = "lon", degrees: float = 15.0) -> DataFrame:
    if not (-90 <= south <= north <= 90 and -180 <= west <= east <= 180):
        raise ValueError("not a box on the map")
    cell = lambda x, shift: int((x + shift) // degrees)
    touched = F.col("cell_lat").between(cell(south, 90), cell(north, 90)) & F.col("cell_lon").between(cell(west, 180), cell(east, 180))
    return index.where(touched).where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def cells(rows: DataFrame, key: str, vector: str, most_centres: int = 64, sample: int = 4096, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Vectors by cell of the nearest of some centres, fitted on at most ``sample`` vectors (chosen by a hash of the key); all vectors are indexed."""
    picked = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).toPandas()
    spark = rows.sparkSession
    x = np.array(picked[vector].tolist(), dtype=np.float64).reshape(len(picked), -1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.random.default_rng(seed).permutation(len(x))[: max(1, min(most_centres, int(len(x) ** 0.5)))]]
    for _ in range(8):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[of == k].sum(axis=0) if (of == k).any() else c for k, c in enumerate(centres)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series((np.stack(v.to_list()).astype(np.float64) @ shared.value.T).argmax(axis=1).astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    kept = rows.where(F.col(vector).isNotNull()).select(key, vector).withColumn("cell", cell(vector))
    return written(kept, "vector_cells"), centres


def nearest(index: tuple[DataFrame, np.ndarray], asked: DataFrame, key: str, vector: str, k: int, share: float = 0.8) -> DataFrame:
    """query, key, score, place: the k nearest in the cells whose centres are nearest to the query, a share of all cells."""
    rows, centres = index
    probes = max(1, round(share * len(centres)))
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        order = np.argsort(-(np.stack(v.to_list()).astype(np.float64) @ shared.value.T), axis=1)[:, :probes].astype(np.int32) if len(v) else []
        return pd.Series([list(map(int, o)) for o in order])

    q = asked.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("_v")).withColumn("cell", F.explode(near("_v")))
    there = vectors.in_blocks(rows.select(key, F.col(vector).alias("_r"), "cell"), [key, "_r"], vectors.ROWS, by="cell")
    return vectors.top(there, vectors.in_blocks(q, ["query", "_v"], vectors.ASKED, by="cell"), key, k, by="cell")


def nearest_exact(rows: DataFrame, asked: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The same over all rows."""
    there = vectors.in_blocks(rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("_r")), [key, "_r"], vectors.ROWS)
    return vectors.top(there, vectors.in_blocks(asked.select(F.col(key).alias("query"), F.col(vector).alias("_v")), ["query", "_v"], vectors.ASKED), key, k)
