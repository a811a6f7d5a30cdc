"""The hourly-to-daily bucket as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_extremes(hourly: DataFrame, late: str = "2 days") -> DataFrame:
    """hourly stream: station_id, ts (local), t. A day is given out once it is past the watermark, if it has 24 hours."""
    day = F.window("ts", "1 day")
    hours = F.size(F.collect_set(F.hour("ts")))
    got = hourly.withWatermark("ts", late).groupBy("station_id", day).agg(F.max("t").alias("tmax"), F.min("t").alias("tmin"), hours.alias("hours"))
    return got.where("hours = 24").select("station_id", F.to_date("window.start").alias("day"), "tmax", "tmin")
