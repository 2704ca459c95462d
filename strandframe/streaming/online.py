"""Streaming forms of deduplication and statistics (beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(df: DataFrame, column: str) -> DataFrame:
    """A time column without zone as a timestamp, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def deduplicate_stream(stream: DataFrame, key: Column, time: str, late: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark; state ends with it."""
    keyed = timed(stream, time).withColumn("_key", F.sha2(key.cast("string"), 256)).withWatermark(time, late)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_stats(stream: DataFrame, time: str, value: str, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count, sum, least, largest and mean of a value in tumbling (or sliding) windows."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    grouped = timed(stream, time).withWatermark(time, late).groupBy(w.alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total", "least", "most", "mean")
