"""Structured Streaming forms: sessions by a gap, tumbling counts, and appends without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n, value_sum) of sessions that end after `gap` without an event; events later than `late` are dropped."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value_sum")


def tumbling(stream: DataFrame, keys: list[str], ts: str, width: str, late: str) -> DataFrame:
    s = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), *keys, "n")


def first_only(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Rows whose keys weren't seen within the watermark: the streaming form of a resumable append."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Handles what is there and stops; run again, it goes on from the checkpoint."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
