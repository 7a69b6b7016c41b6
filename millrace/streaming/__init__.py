"""Windows over event time. The same function serves tables and streams: on a stream it adds the watermark that bounds its state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], *aggregates, late: str = "10 minutes") -> DataFrame:
    """Aggregates by windows of `width` and keys: window_start, keys, aggregates."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(F.window(time, width).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])
