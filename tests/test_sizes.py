"""Plans whose cost must follow the input: exchanges, and windows over no more than they need."""

import re

from pyspark.sql import functions as F

from quantloom.functions.columns import percentile_score
from quantloom.operators import indicators as ind
from quantloom.plans import feature_queries
from quantloom.sources import tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def _exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\((\w+)", _plan(df))


def test_daily_features_shuffle_lines_once(spark, sf_dir):
    assert _exchanges(ind.daily_features(tables.daily_bars(spark, sf_dir, rows_at_once=500))) == ["code"]


def test_percentiles_of_a_day_shuffle_lines_once(spark, sf_dir):
    bars = tables.daily_bars(spark, sf_dir, by="date", rows_at_once=500)
    score = percentile_score(F.col("close"), lower_is_better=False, missing=50, by=[F.col("date")])
    assert _exchanges(bars.select("code", "date", score.alias("score"))) == ["date"]


def test_tasks_follow_the_table(spark, sf_dir):
    few, many = (tables.daily_bars(spark, sf_dir, rows_at_once=n) for n in (1_000_000, 500))
    assert few.rdd.getNumPartitions() == 1
    assert int(re.search(r"Exchange hashpartitioning\(code#\d+L?, (\d+)\)", _plan(many))[1]) >= 10


def test_windows_of_daily_features_see_the_end_alone(spark):
    """The change over 60 rows reaches back to the first close of all, however long the history."""
    bars = spark.range(100).select((F.col("id") * 0 + 1).alias("code"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), *[(F.col("id") + 50.0).alias(x) for x in ("open", "high", "low")], F.when(F.col("id") != 39, F.col("id") + 50.0).alias("close"), F.lit(1.0).alias("volume"), F.lit(1.0).alias("amount"))
    out = ind.daily_features(bars)
    (row,) = out.collect()
    assert "posexplode" in _plan(out).split("Window")[-1]
    assert row["daily_data_points"] == 99 and row["date"].isoformat() == "2020-04-09"
    assert abs(row["change_60d"] - (149 / 50 - 1) * 100) < 1e-9 and row["ma60"] is not None and row["ma5"] == 147.0


def test_features_are_made_once(spark, sf_dir, monkeypatch):
    """What is published is told from the written features, not from a second pass over all lines."""
    made, features = [], feature_queries._features
    monkeypatch.setattr(feature_queries, "_features", lambda s, d: made.append(d) or features(s, d))
    feature_queries._decided(spark, sf_dir)
    assert len(made) == 1
