"""Where intermediate tables go: the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; one is set only where none is and all tasks run on this machine (tests, local mode)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.sparkContext.setCheckpointDir(there)
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/kinweave-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table (and the folder that scratch_path made for it) before the JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back: lineage ends here, and a lost executor costs no recomputation.

    ``batch_rows``: for as long as the write takes, Arrow batches have that many rows at most; for plans whose Python
    steps read whole texts, where ten thousand rows may be more than a worker should hold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(ARROW_ROWS)
    if batch_rows:
        spark.conf.set(ARROW_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    spark.sparkContext._jvm.System.gc()  # Spark's cleaner removes shuffle files that nothing refers to any more
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables made by written() that no plan will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            drop_path(df.sparkSession, file.rsplit("/", 1)[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
