"""Queries of the feature store and its sinks, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import feature_store as fs
from quantloom.sources import sinks, tables
from quantloom.sources.scratch import shared_folder, written

c = F.col
t = tables.table
AT = fs.Publication(cutoff="2003-12-31 00:00:00", date_from="1996-01-01", date_to="2000-12-01", warmup=6)
#: dependency, consumer
EDGES = [("high", "spread"), ("low", "days"), ("lines", "quantity"), ("spread", "days"), ("orders", "parts")]
CORRECTED = ["high"]


def _line_edges(s: SparkSession, d: str) -> DataFrame:
    """A part depends on the one a line before it in the order, if that has the smaller number."""
    line = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = line.select("l_orderkey", (c("l_linenumber") - 1).alias("l_linenumber"), c("l_partkey").alias("consumer"))
    return line.join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey < consumer").select(c("l_partkey").alias("dependency"), "consumer")


def m14_affected(s: SparkSession, d: str) -> DataFrame:
    fixed = t(s, d, "lineitem").where("l_returnflag = 'R' AND l_quantity = 50 AND l_discount = 0").select(c("l_partkey").alias("instance"))
    return fs.affected(_line_edges(s, d), fixed).select("instance", (c("steps") == 0).alias("corrected"))


M14_SQL = """WITH RECURSIVE edges AS (SELECT DISTINCT a.l_partkey AS dependency, b.l_partkey AS consumer FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber AND a.l_partkey < b.l_partkey),
roots AS (SELECT DISTINCT l_partkey AS instance FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_discount = 0),
reach AS (SELECT instance FROM roots UNION SELECT consumer FROM reach JOIN edges ON dependency = instance)
SELECT instance, instance IN (SELECT instance FROM roots) AS corrected FROM reach"""


def _features(s: SparkSession, d: str) -> DataFrame:
    """Monthly figures of each nation's lines, with a row that is late and warm-up rows that are partial."""
    line = t(s, d, "lineitem").join(t(s, d, "supplier"), c("l_suppkey") == c("s_suppkey"))
    month = line.groupBy(c("s_nationkey").cast("long").alias("entity"), F.trunc("l_shipdate", "month").alias("date")).agg(
        F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("spread"), F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").alias("quantity"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_shipdate").alias("days"))
    names = ["high", "low", "spread", "lines", "quantity", "orders", "parts", "days"]
    tall = month.unpivot(["entity", "date"], [c(n).cast("decimal(18,2)").alias(n) for n in names], "instance", "value")
    partial = (c("instance") == "low") & (c("date") < AT.date_from)
    late = (c("instance") == "quantity") & (c("date") == "1998-02-01")
    return tall.select("instance", "entity", "date", "value", F.when(partial, "PARTIAL").otherwise("COMPLETE").alias("quality"), F.when(late, F.lit("2004-01-01")).otherwise(c("date").cast("string")).cast("timestamp").alias("available_at"))


def _published(features: DataFrame) -> DataFrame:
    """What is published: other rows of high and parts, the same of orders and spread."""
    f = features.where(c("date").between(AT.date_from, AT.date_to)).where(c("instance").isin("high", "parts", "orders", "spread"))
    other = c("instance").isin("high", "parts") & (c("date") == "1998-06-01")
    return sinks.content_hashes(f.withColumn("value", F.when(other, c("value") + 1).otherwise(c("value")).cast("decimal(18,2)")), ["instance"]).withColumn("revision", F.lit(1))


def _decided(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = written(_features(s, d), "features")
    nations = t(s, d, "supplier").select(c("s_nationkey").cast("long").alias("entity"))
    months = s.range(1).select(F.explode(F.sequence(F.lit(AT.date_from).cast("date"), F.lit(AT.date_to).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("date"))
    edges = s.createDataFrame(EDGES, "dependency string, consumer string")
    corrected = s.createDataFrame([(x,) for x in CORRECTED], "instance string")
    return f, fs.decide(fs.gate(f, nations, months, AT), edges, _published(f), corrected)


def m15_decisions(s: SparkSession, d: str) -> DataFrame:
    return _decided(s, d)[1]


def m15_published(s: SparkSession, d: str) -> DataFrame:
    """The rows read back after publishing twice."""
    f, decided = _decided(s, d)
    path = shared_folder(s, "features")
    for _ in range(2):
        fs.publish(f, decided, AT, path)
    return s.read.schema("entity long, date date, value decimal(18,2), quality string, available_at timestamp, revision int, instance string").parquet(path).select("instance", "entity", "date", c("value").cast("double").alias("value"), "revision")


_TEXT = lambda names: " || ',' || ".join(f"coalesce(CAST(length(CAST({n} AS VARCHAR)) AS VARCHAR) || ':' || CAST({n} AS VARCHAR), '~')" for n in sorted(names))
_SUMS = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS w{i + 1}" for i in range(4))
_HASH = "sha256(concat_ws('|', n_rows, w1, w2, w3, w4))"
_COLS = ["instance", "entity", "date", "value", "quality", "available_at"]
FEATURES_SQL = f"""month AS (SELECT CAST(s_nationkey AS BIGINT) AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, max(l_extendedprice) AS high, min(l_extendedprice) AS low, max(l_extendedprice) - min(l_extendedprice) AS spread, count(*) AS lines,
  sum(l_quantity) AS quantity, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_shipdate) AS days FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
tall AS ({" UNION ALL ".join(f"SELECT '{n}' AS instance, entity, date, CAST({n} AS DECIMAL(18,2)) AS value FROM month" for n in ("high", "low", "spread", "lines", "quantity", "orders", "parts", "days"))}),
f AS (SELECT instance, entity, date, value, CASE WHEN instance = 'low' AND date < DATE '{AT.date_from}' THEN 'PARTIAL' ELSE 'COMPLETE' END AS quality, CASE WHEN instance = 'quantity' AND date = DATE '1998-02-01' THEN TIMESTAMP '2004-01-01' ELSE CAST(date AS TIMESTAMP) END AS available_at FROM tall),
o AS (SELECT * FROM f WHERE date BETWEEN DATE '{AT.date_from}' AND DATE '{AT.date_to}'),
hashed AS (SELECT instance, n_rows, {_HASH} AS content_hash FROM (SELECT instance, count(*) AS n_rows, {_SUMS} FROM (SELECT instance, sha256({_TEXT(_COLS)}) AS h FROM o) GROUP BY 1)),
was AS (SELECT instance, {_HASH} AS old FROM (SELECT instance, count(*) AS n_rows, {_SUMS} FROM (SELECT instance, sha256({_TEXT(_COLS)}) AS h FROM (SELECT * REPLACE (CAST(CASE WHEN instance IN ('high', 'parts') AND date = DATE '1998-06-01' THEN value + 1 ELSE value END AS DECIMAL(18,2)) AS value) FROM o WHERE instance IN ('high', 'parts', 'orders', 'spread'))) GROUP BY 1)),
edges AS (SELECT * FROM (VALUES {", ".join(map(str, EDGES))}) e(dependency, consumer)),
want AS (SELECT count(DISTINCT s_nationkey) AS n FROM supplier),
cover AS (SELECT instance, min(n) AS least, count(*) AS n_dates FROM (SELECT instance, date, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1),
warm AS (SELECT instance, min(n) AS least_warm FROM (SELECT instance, entity, count(*) FILTER (date < DATE '{AT.date_from}') AS n FROM f GROUP BY 1, 2 HAVING count(*) FILTER (date BETWEEN DATE '{AT.date_from}' AND DATE '{AT.date_to}') > 0) GROUP BY 1),
whole AS (SELECT instance, max(available_at) > TIMESTAMP '{AT.cutoff}' AS late, count(*) FILTER (date < DATE '{AT.date_from}') AS n_warmup, bool_or(date < DATE '{AT.date_from}' AND quality <> 'COMPLETE') AS warm_poor FROM f GROUP BY 1),
gated AS (SELECT w.instance, coalesce(n_rows, 0) AS n_rows, n_warmup, content_hash, CASE WHEN late THEN 'late' WHEN n_rows IS NULL THEN 'empty' WHEN warm_poor THEN 'warm-up quality' WHEN least_warm < {AT.warmup} THEN 'warm-up evidence' WHEN least <> (SELECT n FROM want) THEN 'entities' WHEN n_dates <> 60 THEN 'dates' END AS problem
  FROM whole w LEFT JOIN hashed USING (instance) LEFT JOIN cover USING (instance) LEFT JOIN warm USING (instance)),
lineage AS (SELECT 'high' AS instance UNION SELECT consumer FROM lineage JOIN edges ON dependency = instance),
checked AS (SELECT g.*, old, l.instance IS NOT NULL AS corr, coalesce(problem, CASE WHEN old IS NOT NULL AND l.instance IS NULL AND old <> content_hash THEN 'undeclared' END) AS p FROM gated g LEFT JOIN lineage l USING (instance) LEFT JOIN was USING (instance)),
held AS (SELECT instance FROM checked WHERE p IS NOT NULL UNION SELECT consumer FROM held JOIN edges ON dependency = instance),
decided AS (SELECT k.instance, n_rows, n_warmup, content_hash, coalesce(p, CASE WHEN h.instance IS NOT NULL THEN 'dependency' END) AS problem, CASE WHEN h.instance IS NOT NULL THEN 'held' WHEN old IS NULL THEN 'new' WHEN corr THEN 'correction' ELSE 'kept' END AS action, old FROM checked k LEFT JOIN held h USING (instance)),
final AS (SELECT * EXCLUDE (old), CASE WHEN action = 'new' THEN 1 WHEN action = 'correction' THEN 2 WHEN old IS NOT NULL THEN 1 END AS revision FROM decided)"""
M15_SQL = f"WITH RECURSIVE {FEATURES_SQL} SELECT * FROM final"
M15_ROWS_SQL = f"WITH RECURSIVE {FEATURES_SQL} SELECT instance, entity, date, CAST(value AS DOUBLE) AS value, revision FROM o JOIN final USING (instance) WHERE action IN ('new', 'correction')"


def s14_upsert(s: SparkSession, d: str) -> DataFrame:
    """Orders by status, loaded, loaded again in another order, then with one status corrected."""
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", c("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderpriority", "o_orderstatus")
    path = shared_folder(s, "orders")
    first = sinks.upsert(o, path, ["o_orderstatus"])
    again = sinks.upsert(o.repartition(5, "o_custkey"), path, ["o_orderstatus"], first)
    fixed = o.withColumn("o_totalprice", F.when((c("o_orderstatus") == "F") & (c("o_custkey") % 2 == 0), c("o_totalprice") + 1).otherwise(c("o_totalprice")).cast("decimal(18,2)"))
    third = sinks.upsert(fixed, path, ["o_orderstatus"], again)
    held = s.read.schema(o.schema).parquet(path).groupBy("o_orderstatus").agg(F.sum("o_totalprice").cast("double").alias("total"))
    return again.select("o_orderstatus", c("action").alias("second")).join(third.withColumnRenamed("action", "third"), "o_orderstatus").join(held, "o_orderstatus")


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
S14_SQL = f"""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice + CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS o_totalprice, o_orderpriority, o_orderstatus FROM orders),
h AS (SELECT o_orderstatus, count(*) AS n_rows, sum(o_totalprice) AS total, {_SUMS} FROM (SELECT *, sha256({_TEXT(_ORDER_COLS)}) AS h FROM o) GROUP BY 1)
SELECT o_orderstatus, 'unchanged' AS second, n_rows, {_HASH} AS content_hash, CASE WHEN o_orderstatus = 'F' THEN 'changed' ELSE 'unchanged' END AS third, CAST(total AS DOUBLE) AS total FROM h"""

QUERIES = {"m14_affected": m14_affected, "m15_decisions": m15_decisions, "m15_published": m15_published, "s14_upsert": s14_upsert}
ORACLES = {"m14_affected": M14_SQL, "m15_decisions": M15_SQL, "m15_published": M15_ROWS_SQL, "s14_upsert": S14_SQL}
