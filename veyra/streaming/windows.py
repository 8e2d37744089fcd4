"""Weighted statistics of event-time windows: sums that a stream keeps up, and what follows from them.

The same plan runs on a table. Rows later than the watermark are left out; state is one row for each open window and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_windows(events: DataFrame, time: str, x: str, w: str | None, by: Sequence[str] = (), *, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, by, n, sum_w, wmean and wvar (population) of each window."""
    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    value, known = F.col(x).cast("double"), F.col(x).isNotNull()
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    sums = rows.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(F.when(known, weight)).alias("sum_w"), F.sum(value * weight).alias("_s"), F.sum(value * value * weight).alias("_q"))
    mean = F.try_divide(F.col("_s"), F.col("sum_w"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "sum_w", mean.alias("wmean"), F.greatest(F.lit(0.0), F.try_divide(F.col("_q"), F.col("sum_w")) - mean * mean).alias("wvar"))
