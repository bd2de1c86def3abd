"""Queries of loose provider rows and broker files, each with its SQL twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources import readers, tables
from quantloom.sources.scratch import shared_folder

c = F.col
t = tables.table
NOW = dt.datetime(2001, 10, 5, 15, 0)


def _loose(s: SparkSession, d: str) -> DataFrame:
    """Lines as a provider's bars: dates in three forms, some closes and volumes no numbers."""
    k, p = c("l_orderkey"), c("l_partkey")
    form = lambda x: F.date_format("l_shipdate", x)
    date = F.when(k % 97 == 0, "soon").when(k % 3 == 0, form("yyyy-MM-dd")).when(k % 3 == 1, form("yyyyMMdd")).otherwise(F.concat(form("yyyy/M/d"), F.lit(" 15:00")))
    price = F.when(p % 41 == 0, "--").when(p % 43 == 0, "1,000").otherwise(F.concat(F.lit(" "), p.cast("string"), F.lit(".25")))
    volume = F.when((k + p) % 53 != 0, c("l_quantity").cast("int").cast("string"))
    return t(s, d, "lineitem").select(c("l_suppkey").alias("code"), (k * 10 + c("l_linenumber")).alias("position"), date.alias("date"), price.alias("close"), volume.alias("volume"))


def s4_clean_bars(s: SparkSession, d: str) -> DataFrame:
    """How many rows are told apart for which reason, and the sums of the good ones by month."""
    good, bad = readers.clean_bars(_loose(s, d))
    kept = good.groupBy(F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("close"), F.sum("volume").alias("volume")).withColumn("problem", F.lit("none"))
    lost = bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(lost, allowMissingColumns=True)


_LOOSE_SQL = """loose AS (SELECT l_suppkey AS code, l_orderkey * 10 + l_linenumber AS position, CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_shipdate AS DATE) END AS date, CASE WHEN l_partkey % 41 <> 0 AND l_partkey % 43 <> 0 THEN l_partkey + 0.25 END AS close, CASE WHEN (l_orderkey + l_partkey) % 53 <> 0 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE) END AS volume FROM lineitem)"""
S4_SQL = f"""WITH {_LOOSE_SQL}, p AS (SELECT *, CASE WHEN date IS NULL THEN 'date' WHEN close IS NULL THEN 'close' WHEN volume IS NULL THEN 'volume' ELSE 'none' END AS problem FROM loose)
SELECT problem, CASE WHEN problem = 'none' THEN CAST(date_trunc('month', date) AS DATE) END AS month, count(*) AS n, CASE WHEN problem = 'none' THEN CAST(sum(close) AS DOUBLE) END AS close, CASE WHEN problem = 'none' THEN sum(volume) END AS volume FROM p GROUP BY problem, month"""


def s6_alert_bars(s: SparkSession, d: str) -> DataFrame:
    """Each instrument's rows, last row and last date once an unfinished bar is out."""
    bars = readers.alert_bars(_loose(s, d).withColumnRenamed("close", " Close_Price "), ["close", "volume"], NOW)
    return bars.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("position"), F.max_by("date", "position").alias("date"), F.sum("close").alias("close"))


S6_SQL = f"""WITH {_LOOSE_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY position DESC) AS back FROM loose WHERE close IS NOT NULL AND volume IS NOT NULL)
SELECT code, count(*) AS n, max(position) AS position, list(date ORDER BY position DESC)[1] AS date, CAST(sum(close) AS DOUBLE) AS close FROM b WHERE NOT (back = 1 AND (date IS NULL OR date = DATE '{NOW.date()}')) GROUP BY code"""


def s8_provider_snapshot(s: SparkSession, d: str) -> DataFrame:
    """Parts as a provider's snapshot under its own names."""
    k = c("p_partkey")
    raw = t(s, d, "part").select(k.cast("string").alias("股票代码"), c("p_name").alias("名称"), F.when(k % 17 == 0, "-").when(k % 19 == 0, "0").otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("最新价"), (k % 7 - 3).cast("string").alias("涨跌幅"), F.when(k % 5 != 0, c("p_size").cast("string")).alias("市盈率(动)"), c("p_brand").alias("所属行业"), c("p_type").alias("题材"), "p_size")
    return readers.provider_snapshot(raw, "efinance")


S8_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_partkey + 0.5::DOUBLE AS price, CAST(p_partkey % 7 - 3 AS DOUBLE) AS change_pct, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS pe_ratio, p_brand AS industry, p_type AS concepts, p_size FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0"


def s10_broker_trades(s: SparkSession, d: str) -> DataFrame:
    """Lines written as a broker's files and imported; copies of one line stay apart."""
    k = c("l_orderkey")
    side = F.when(k % 23 == 0, "分红").when(c("l_returnflag") == "R", "证券卖出").otherwise("买 入")
    rows = t(s, d, "lineitem").select(F.date_format("l_shipdate", "yyyyMMdd").alias("日期"), F.concat(F.lit("sh"), c("l_suppkey")).alias("证券代码"), side.alias("交易方向"), F.when(c("l_quantity") > 1, F.format_number(c("l_quantity") * 100, 0)).otherwise("0").alias("成交股数"), c("l_partkey").cast("string").alias("成交价"), c("l_linenumber").cast("string").alias("佣金"), F.lit("0.5").alias("过户费"), F.lit("cny").alias("币种"))
    path = shared_folder(s, "broker")
    rows.write.option("header", True).csv(path)
    good, bad = readers.broker_trades(readers.read_broker_files(s, path), "cmb")
    kept = good.groupBy("side", "symbol", "currency").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum("price").alias("price"), F.sum("fee").alias("fee"))
    return kept.unionByName(bad.groupBy(c("problem").alias("side")).agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


S10_SQL = """WITH r AS (SELECT *, CASE WHEN l_orderkey % 23 = 0 THEN 'side' WHEN NOT l_quantity > 1 THEN 'quantity' WHEN l_partkey <= 0 THEN 'price' END AS problem FROM lineitem)
SELECT CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, 'SH' || l_suppkey AS symbol, 'CNY' AS currency, count(*) AS n, CAST(sum(l_quantity * 100) AS DOUBLE) AS quantity, CAST(sum(l_partkey) AS DOUBLE) AS price, sum(l_linenumber + 0.5::DOUBLE) AS fee FROM r WHERE problem IS NULL GROUP BY ALL
UNION ALL SELECT problem, NULL, NULL, count(*), NULL, NULL, NULL FROM r WHERE problem IS NOT NULL GROUP BY problem"""

QUERIES = {"s4_clean_bars": s4_clean_bars, "s6_alert_bars": s6_alert_bars, "s8_provider_snapshot": s8_provider_snapshot, "s10_broker_trades": s10_broker_trades}
ORACLES = {"s4_clean_bars": S4_SQL, "s6_alert_bars": S6_SQL, "s8_provider_snapshot": S8_SQL, "s10_broker_trades": S10_SQL}
