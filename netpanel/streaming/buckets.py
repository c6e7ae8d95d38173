"""Windows over event streams: an extension, the panel operators themselves are batch jobs.

Tumbling buckets are the streaming form of calendar aggregates, sliding windows that of
rolling samples. Late rows are taken until the watermark; state is one row a key and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _aggregated(events: DataFrame, window: F.Column, key: str, value: str, time: str, late: str) -> DataFrame:
    lo, hi = F.min(value), F.max(value)
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # event time needs a time zone
    agg = events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), lo.alias("lo"), hi.alias("hi")
    )
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "mean", "lo", "hi")


def tumbling(events: DataFrame, length: str = "1 day", key: str = "event_type", value: str = "value", time: str = "ts", late: str = "1 hour") -> DataFrame:
    return _aggregated(events, F.window(time, length), key, value, time, late)


def sliding(events: DataFrame, length: str = "7 days", step: str = "1 day", key: str = "event_type", value: str = "value", time: str = "ts", late: str = "1 hour") -> DataFrame:
    return _aggregated(events, F.window(time, length, step), key, value, time, late)


def sessions(events: DataFrame, gap: str = "6 hours", key: str = "user_id", value: str = "value", time: str = "ts", late: str = "1 hour") -> DataFrame:
    return _aggregated(events, F.session_window(time, gap), key, value, time, late)
