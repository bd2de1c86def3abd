"""The flagship query: a screen from bars to ranked picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded, with_percentiles
from quantloom.operators.indicators import moving_averages
from quantloom.sources import tables


def flagship(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The latest bar of each instrument, ranked by its distance from its 20-row mean, and whether it is
    above it; instruments without a full mean come last."""
    bars = moving_averages(tables.daily_bars(spark, sf_dir))
    last = bars.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).where("n = 1").drop("n")
    last = last.withColumn("above", F.coalesce(F.col("close") > F.col("ma20"), F.lit(False)))
    scored = with_percentiles(last, {"score": (F.col("close") / F.col("ma20") - 1, False, 0)})
    return rounded(scored.select("code", "date", "close", "ma5", "ma20", "ma60", "above", "score").orderBy(F.desc("score"), "code").limit(k), 4)
