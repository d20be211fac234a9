"""A session with the settings that results depend on: UTC, ANSI, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", app: str = "tidewire", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Shuffle partitions: as many as the master's cores locally, Spark's own default elsewhere; AQE joins small ones and splits skewed ones."""
    b = SparkSession.builder.master(master).appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    # A checkpoint goes with the table that it was made for.
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
