"""Streaming control-chart status against fixed limits, and windowed counts of late-tolerant events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chart_status(stream: DataFrame, limits: DataFrame, group: str, value: str) -> DataFrame:
    """A stream's points with pass, warning or fail; limits (group, centre, sd) has one row per group.

    Without spread any point off the centre fails.  Spark broadcasts the limits only where they are small.
    """
    off = F.abs(F.col(value) - F.col("centre"))
    z = F.when(F.col("sd") > 0, off / F.when(F.col("sd") > 0, F.col("sd"))).otherwise(F.when(off > 0, float("inf")).otherwise(0.0))
    joined = stream.join(limits, group)
    return joined.withColumn("status", F.when(z > 3, "fail").when(z > 2, "warning").otherwise("pass"))


def failures_by_window(points: DataFrame, time: str, group: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by status, group and tumbling window, with a watermark."""
    return points.withWatermark(time, late).groupBy(F.window(time, width), group, "status").count()
