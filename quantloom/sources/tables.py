"""Views of the test tables as market data: bars, snapshots, signals, a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ohlc(rows: DataFrame, *keys: str) -> DataFrame:
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.withColumn("price", F.col("l_extendedprice") / F.col("l_quantity")).groupBy(*keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"))


def daily_bars(spark: SparkSession, sf_dir: str, by: str = "code", rows_at_once: int = 75_000) -> DataFrame:
    """code, date, open, high, low, close, volume, amount: one bar per supplier and ship date.

    A bar has few lines, so summing up before the shuffle would save nothing. Lines are dealt out once by code,
    or by date for cross-sections, to as many tasks as there are `rows_at_once` lines; bars and whatever follows
    by that column need no other shuffle, and a task's memory doesn't grow with the table.
    """
    rows = table(spark, sf_dir, "lineitem")
    tasks = max(1, -(-rows.count() // rows_at_once))
    rows = rows.withColumns({"code": F.col("l_suppkey"), "date": F.to_date("l_shipdate")})
    return _ohlc(rows.select("code", "date", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").repartition(tasks, by), "code", "date")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per nation of the supplier and week; a week has several lines, so ranges are real."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.withColumns({"code": F.col("s_nationkey").cast("long"), "date": F.date_sub(F.next_day(F.to_date("l_shipdate"), "Mon"), 7)})
    return _ohlc(rows, "code", "date")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier: its last bar with labels and stand-ins for valuation ratios."""
    last = daily_bars(spark, sf_dir).groupBy("code").agg(F.max(F.struct("date", "open", "close", "volume", "amount")).alias("b")).select("code", "b.*")
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    out = last.join(s, F.col("code") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("code")
    return out.select("code", F.col("s_name").alias("name"), F.col("close").alias("price"), "amount", F.col("s_acctbal").alias("total_mv"), F.col("n_name").alias("industry"), F.col("r_name").alias("concepts"),
        ((k * 7 % 23 - 11) / 1.0).alias("change_pct"), F.when(k % 13 != 0, (k * 31 % 700 - 60) / 1.0).alias("pe_ratio"), F.when(k % 11 != 0, (k * 17 % 60 - 4) / 1.0).alias("pb_ratio"),
        (k * 5 % 90 / 10).alias("volume_ratio"), (k * 3 % 200 / 10).alias("turnover_rate"), ((k * 29 % 131 - 60) / 1.0).alias("change_60d"), F.when(k % 9 != 0, (k * 41 % 101) / 1.0).alias("signal_score"),
        F.element_at(F.array(F.lit("bullish"), F.lit("bearish"), F.lit("neutral")), (k % 3 + 1).cast("int")).alias("macd_status"), F.element_at(F.array(F.lit("oversold"), F.lit("overbought"), F.lit("neutral")), (k % 5 % 3 + 1).cast("int")).alias("rsi_status"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, open, high, low, close of each user's values per day."""
    e = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("user_id").alias("code"), "date").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"))


def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded advice: one per event; its type stands for the action."""
    e = table(spark, sf_dir, "events")
    action = F.create_map(*[F.lit(x) for x in ("purchase", "buy", "error", "sell", "view", "hold", "click", "add", "signup", "wait")])
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("code"), F.to_date("ts").alias("date"), action[F.col("event_type")].alias("action"), "ts")


#: The same views for DuckDB, as common table expressions.
_PRICE = "l_extendedprice / l_quantity"
_ORDER = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice"
_OHLC = f"list({_PRICE} {_ORDER})[1] AS open, max({_PRICE}) AS high, min({_PRICE}) AS low, list({_PRICE} {_ORDER})[-1] AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount"
BARS_SQL = f"bars AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, {_OHLC} FROM lineitem GROUP BY 1, 2)"
WEEKLY_SQL = f"bars AS (SELECT CAST(s_nationkey AS BIGINT) AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {_OHLC} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
EVENTS_SQL = "ebars AS (SELECT user_id AS code, CAST(ts AS DATE) AS date, list(value ORDER BY ts, event_id)[1] AS open, max(value) AS high, min(value) AS low, list(value ORDER BY ts, event_id)[-1] AS close FROM events GROUP BY 1, 2)"
ADVICE_SQL = "advice AS (SELECT event_id AS id, user_id AS code, CAST(ts AS DATE) AS date, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'sell' WHEN 'view' THEN 'hold' WHEN 'click' THEN 'add' WHEN 'signup' THEN 'wait' END AS action, ts FROM events)"
SNAPSHOT_SQL = BARS_SQL + """, snap AS (
  SELECT b.code, s_name AS name, close AS price, amount, s_acctbal AS total_mv, n_name AS industry, r_name AS concepts,
    CAST(b.code * 7 % 23 - 11 AS DOUBLE) AS change_pct, CASE WHEN b.code % 13 <> 0 THEN CAST(b.code * 31 % 700 - 60 AS DOUBLE) END AS pe_ratio,
    CASE WHEN b.code % 11 <> 0 THEN CAST(b.code * 17 % 60 - 4 AS DOUBLE) END AS pb_ratio, (b.code * 5 % 90) / 10 AS volume_ratio, (b.code * 3 % 200) / 10 AS turnover_rate,
    CAST(b.code * 29 % 131 - 60 AS DOUBLE) AS change_60d, CASE WHEN b.code % 9 <> 0 THEN CAST(b.code * 41 % 101 AS DOUBLE) END AS signal_score,
    ['bullish', 'bearish', 'neutral'][b.code % 3 + 1] AS macd_status, ['oversold', 'overbought', 'neutral'][b.code % 5 % 3 + 1] AS rsi_status
  FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1) b
  JOIN supplier ON b.code = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
