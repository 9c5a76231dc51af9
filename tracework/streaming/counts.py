"""Streaming forms of the counts and sessions; each works on a batch table as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.event_log import LOG_SCHEMA

#: The driver's event table, as files of a stream.
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def log_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The nested JSON log as a file stream, ``files`` files a batch at most."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files).json(path)


def event_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """``start_ts, event_type, n`` per tumbling or sliding window; later events than ``late`` are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    n = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start_ts"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """``user_id, start_ts, end_ts, n``.  A gap of exactly ``gap`` begins a new session here, while
    ``sequence.gap_sessions`` keeps it together."""
    n = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")
