"""Ranks over a whole table without a single task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.shared import written


def global_rank(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with ``name``: 1 for the first row in order, gapless. Ranges are sorted alone and shifted by the sizes of those before.

    One number a range comes to the driver. The order should be total; rows that tie in it are ranked as they come.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = written(df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    before, seen = [], 0
    for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).orderBy("_part").collect():
        before.append((r["_part"], r["first"] - seen - 1))
        seen += r["n"]
    shift = df.sparkSession.createDataFrame(before, "_part int, _shift long")
    return dealt.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") - F.col("_shift")).drop("_part", "_at", "_shift")
