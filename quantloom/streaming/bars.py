"""Bars over streams of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ohlc(ticks: DataFrame, width: str = "1 day", late: str = "2 hours", key: str = "user_id", at: str = "ts", price: str = "value") -> DataFrame:
    """Bars of a tumbling window per key; ticks later than `late` are dropped once their bar is out."""
    t = ticks.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    first = F.struct(at, "event_id")
    out = t.groupBy(F.window(at, width).alias("w"), F.col(key).alias("code")).agg(F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, first).alias("close"), F.count("*").alias("ticks"))
    return out.select("code", F.col("w.start").alias("start"), "open", "high", "low", "close", "ticks")
