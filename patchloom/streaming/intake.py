"""The state operators on streams: deduplication by key and fixed-window limits, with bounded state.

The batch forms in ``operators.state`` are the reference; these are for sources that never end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(rows: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once, while a repeat comes no later than ``late``; older state is dropped."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def requests_by_window(rows: DataFrame, client: str, ts: str, limit: int, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """client, window_start, requests, refused: how many requests of a window pass its limit."""
    counts = rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), client).agg(F.count("*").alias("requests"))
    return counts.select(client, F.col("w.start").alias("window_start"), "requests", F.greatest(F.lit(0), F.col("requests") - limit).alias("refused"))


def status_counts(rows: DataFrame, status: str, ts: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Runs by status in each window."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), status, "n")
