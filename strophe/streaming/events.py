"""Histograms and sessions over streams of events (seq_id, sym, ts). Rows later than the watermark do not count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream(spark, path: str, schema: str) -> DataFrame:
    """Events of Parquet files that arrive in a folder."""
    return spark.readStream.format("parquet").schema(schema).load(path)


def windowed_hist(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of symbols by sequence and tumbling window."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "seq_id", "sym").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "seq_id", "sym", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of a sequence: events with no longer gap between them; their first time, last time and number."""
    e = events.withWatermark("ts", late)
    s = e.groupBy(F.session_window("ts", gap).alias("w"), "seq_id").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return s.select("seq_id", "start", "last", "n")
