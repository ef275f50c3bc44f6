"""An extension: classes below k per tumbling window of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unsafe_windows(events: DataFrame, ts: str, qi: list[str], k: int, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Per window and class: n and whether it is unsafe. Works on batches and streams alike; late rows beyond the watermark go."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *qi).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"),
        *qi,
        "n",
        (F.col("n") < k).alias("unsafe"),
    )
