"""Event-time windows over a stream of landing files: an extension, offered beside the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total per tumbling window; rows later than ``late`` are dropped by the watermark of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "top")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return reachable(spark).readStream.schema(SCHEMA).parquet(folder)
