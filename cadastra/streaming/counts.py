"""Traffic counts as a stream: daily sums and a trailing day per site, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import traffic

LATE = "15 minutes"


def daily(counts: DataFrame, late: str = LATE) -> DataFrame:
    """Sums by study, names and day (ts is a timestamp); a day is sent when the watermark passes it."""
    day = F.window("ts", "1 day")
    out = counts.withWatermark("ts", late).groupBy(day.alias("w"), *traffic.NAMES).agg(F.sum("count_15_minutes").alias("total"), F.count(F.lit(1)).alias("intervals"))
    return out.select(F.col("w.start").alias("day"), *traffic.NAMES, "total", "intervals")


def trailing_day(counts: DataFrame, late: str = LATE) -> DataFrame:
    """Sums by site over sliding days, a new one each quarter hour."""
    w = F.window("ts", "1 day", "15 minutes")
    out = counts.withWatermark("ts", late).groupBy(w.alias("w"), "site").agg(F.sum("total").alias("sum_total"), F.count(F.lit(1)).alias("interval_count"))
    return out.select(F.col("w.end").alias("window_end"), "site", "sum_total", "interval_count")
