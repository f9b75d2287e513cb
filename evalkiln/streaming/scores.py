"""An incremental monitor: errors of arriving predictions by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_scores(stream: DataFrame, time_col: str = "ts", key: str = "producer", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """n and mean absolute error per key and tumbling window; rows later than ``late`` behind the newest are dropped.

    Works on a stream and on a table alike. ``stream`` has value and y. State is one row per open window and key.
    """
    rows = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    rows = rows.withWatermark(time_col, late) if stream.isStreaming else rows
    agg = rows.groupBy(F.window(time_col, window).alias("w"), key).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("value") - F.col("y"))).alias("mae"))
    return agg.select(F.col("w.start").alias("window_start"), key, "n", "mae")
