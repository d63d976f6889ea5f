"""Structured Streaming forms: causal filters with state, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolake.operators.particle_filter import Options, stream_filter

MEASURED = "seq long, t int, joint int, " + ", ".join(f"o{k} double" for k in range(9)) + ", mask boolean, confidence double"


def filtered_files(spark: SparkSession, folder: str, options: Options = Options(), files_per_batch: int = 1) -> DataFrame:
    """Estimates of measurement files as they appear in ``folder``; later files hold later frames."""
    source = spark.readStream.schema(MEASURED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream_filter(source, options)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) of tumbling windows over ``events`` (ts, event_type, value); what comes later than ``late`` is dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def user_sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n) of sessions that end after ``gap`` without an event."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n")
