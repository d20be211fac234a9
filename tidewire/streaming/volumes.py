"""The volume tables over a stream: watermarks, tumbling and session windows, dedup within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream; times become TIMESTAMP, which watermarks ask for."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    alone = any(f.endswith("/events.parquet") for f in table.inputFiles())
    rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    # A source of streams is a folder: of a single file, its folder narrowed to it.
    found = rows.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else rows.parquet(f"{sf_dir}/events.parquet")
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_volumes(events: DataFrame, width: str = "1 day", late: str = "1 day", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """window start, key, count, actors (approximate); events later than `late` are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key))
    return w.agg(F.count(F.lit(1)).alias("count"), F.approx_count_distinct("user_id").alias("actors")).select(F.col("w.start").alias("start"), key, "count", "actors")


def session_volumes(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """key, session start and end, count."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), F.col(key))
    return s.agg(F.count(F.lit(1)).alias("count")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "count")


def dedup_stream(events: DataFrame, key: str = "event_id", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
