"""Queries of the streaming operators, run until their input is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.sources import tables
from quantloom.sources.scratch import shared_folder
from quantloom.streaming import alerts, bars

c = F.col
RULES = [alerts.LevelRule("high", 20.0), alerts.LevelRule("low", 5.0, "below", "info", 7200), alerts.LevelRule("spike", 80.0, "above", "critical", 0)]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = tables.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def run_stream(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for the input there is, from a table of Parquet files."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    name, store = alerts.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    try:
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").drop("batch")


def stream_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_stream(bars.ohlc(_events(spark, sf_dir)), "update")
    return rounded(out.groupBy("code", F.to_date("start").alias("date")).agg(F.max(F.struct("ticks", "open", "high", "low", "close")).alias("b")).select("code", "date", "b.open", "b.high", "b.low", "b.close", "b.ticks"))


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of three rules; ticks of the last two hours still wait for the watermark."""
    out = run_stream(alerts.alerts(_events(spark, sf_dir), RULES), "append")
    return rounded(out.groupBy("rule", "code", "severity").agg(F.count("*").alias("alerts"), F.sum("price").alias("prices"), F.unix_micros(F.max("at")).alias("last_us")))


def d8_told_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, of two readers, and counts once for its user, type and second."""
    events = _events(spark, sf_dir).withColumn("second", F.date_trunc("second", "ts"))
    out = run_stream(alerts.told_once(events.unionByName(events), ["user_id", "event_type", "second"], "ts"), "append")
    return out.groupBy("user_id").agg(F.count("*").alias("triggers"))


QUERIES = {"stream_ohlc": stream_ohlc, "stream_alerts": stream_alerts, "d8_told_once": d8_told_once}

_RULES = ", ".join(f"('{r.name}', '{r.severity}', {r.level}::DOUBLE, {r.direction == 'above'}, {r.cooldown_s})" for r in RULES)
ORACLES = {
    "stream_ohlc": "SELECT user_id AS code, CAST(ts AS DATE) AS date, round(list(value ORDER BY ts, event_id)[1], 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(list(value ORDER BY ts, event_id)[-1], 6) AS close, count(*) AS ticks FROM events GROUP BY 1, 2",
    "stream_alerts": f"""WITH RECURSIVE r(rule, severity, level, up, pause) AS (VALUES {_RULES}), e AS (SELECT user_id AS code, epoch_us(ts) AS tm, value AS x, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 86400000000 THEN lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS p, event_id FROM events WHERE value IS NOT NULL),
      k AS (SELECT rule, severity, pause, code, tm, x, row_number() OVER (PARTITION BY rule, code ORDER BY tm, event_id) AS n FROM e, r WHERE CASE WHEN up THEN p <= level AND level < x ELSE p >= level AND level > x END AND tm <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 7200000000),
      f AS (SELECT rule, code, 0::BIGINT AS n, 0::BIGINT AS until, 0::BIGINT AS told, 0::DOUBLE AS sum, NULL::BIGINT AS last FROM k GROUP BY 1, 2
        UNION ALL SELECT f.rule, f.code, k.n, CASE WHEN k.tm >= until THEN k.tm + pause::BIGINT * 1000000 ELSE until END, told + CASE WHEN k.tm >= until THEN 1 ELSE 0 END, sum + CASE WHEN k.tm >= until THEN x ELSE 0 END, CASE WHEN k.tm >= until THEN k.tm ELSE last END FROM f JOIN k ON k.rule = f.rule AND k.code = f.code AND k.n = f.n + 1)
      SELECT rule, code, severity, told AS alerts, round(sum, 6) AS prices, last AS last_us FROM f JOIN (SELECT rule, severity FROM r) USING (rule) WHERE f.n > 0 QUALIFY row_number() OVER (PARTITION BY rule, code ORDER BY n DESC) = 1""",
    "d8_told_once": "SELECT user_id, count(DISTINCT (event_type, date_trunc('second', ts))) AS triggers FROM events GROUP BY 1",
}
