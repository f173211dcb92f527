"""Daily rates over a stream, for the batch drift rules to follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(events: DataFrame, *, delay: str = "1 day", span: str = "1 day", slide: str | None = None) -> DataFrame:
    """event_type, window and mean of a stream (ts, event_type, value); windows close when the watermark passes them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    own = F.window("ts", span, slide) if slide else F.window("ts", span)
    return timed.groupBy("event_type", own.alias("window")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
