"""Session defaults for tests, the bench and ad-hoc use; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "kinweave", **conf: str) -> SparkSession:
    """A local session with AQE, UTC and as many shuffle partitions as threads."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
