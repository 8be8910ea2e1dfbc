"""The activity feed as a stream: an extension, since the batch queries need none.

Late events within the watermark still count; a batch that runs twice writes its windows once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources.readers import append_new


def events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Zone-less times are read as the session's zone, UTC: a watermark needs an instant."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def into_table(counts: DataFrame, path: str, checkpoint: str):
    """Start writing finished windows; (start, event_type) is the key."""
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_new(df, path, ["start", "event_type"])).start()
