"""Request and token rates of a stream: late data bounded by a watermark, windows that slide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_rates(events: DataFrame, at: str, by: str, weight: str, window: str = "1 minute", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests and weight of each key in each sliding window; works on streams and on tables."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, window, slide), by).agg(F.count("*").alias("requests"), F.sum(weight).alias("weight"))
        .select(F.col("window.start").alias("start"), by, "requests", "weight")
    )


def append_new(events: DataFrame, key: str, at: str, late: str = "2 minutes") -> DataFrame:
    """Each key once within the watermark: re-sent records do not count twice."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
