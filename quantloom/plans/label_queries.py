"""Queries of merged labels, board trends and fan-out, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import labels as lb
from quantloom.operators import names as nm
from quantloom.sources import tables

c = F.col
t = tables.table


def _labelled(s: SparkSession, d: str) -> DataFrame:
    k, n = c("s_suppkey"), c("s_nationkey")
    return t(s, d, "supplier").select(k.alias("code"), F.when(k % 3 == 0, "nan").otherwise(F.concat(F.lit("I"), n)).alias("industry"), F.concat(F.lit("ring, N"), n, F.lit("，none")).alias("concepts"),
        F.when(k % 5 != 0, (k % 40).cast("int")).alias("industry_rank"), F.when(k % 7 != 0, (k % 100).cast("double")).alias("board_heat_score"), (k % 21 - 10).cast("double").alias("board_heat_trend_score"), F.when(k % 2 == 0, F.concat(F.lit("B"), n, F.lit(":9"))).alias("board_heat_summary"))


def _mapping(s: SparkSession, d: str) -> DataFrame:
    line = t(s, d, "lineitem").join(t(s, d, "part"), c("l_partkey") == c("p_partkey"))
    p = c("p_partkey")
    return line.select(c("l_suppkey").alias("code"), c("p_brand").alias("industry"), F.concat(F.regexp_replace("p_name", " ", "、"), F.lit("、 ring ,"), "p_type").alias("concepts"), F.concat(c("p_size").cast("string"), F.lit("%")).alias("industry_rank"),
        F.when(p % 4 == 0, "--").otherwise(F.concat((p % 120).cast("string"), F.lit(".5"))).alias("board_heat_score"), (p % 31 - 15).cast("double").alias("board_heat_trend_score"), F.concat("p_name", F.lit(" : 1|"), "p_type", F.lit("\nB3:9")).alias("board_heat_summary"), "l_orderkey", "l_linenumber", "l_partkey")


def j2_merge(s: SparkSession, d: str) -> DataFrame:
    mapping = lb.last_of_each(_mapping(s, d), "code", ["l_orderkey", "l_linenumber", "l_partkey"])
    return lb.merge_mapping(_labelled(s, d), mapping).withColumn("changed", F.array_join("changed", ","))


_TRIM = lambda x: f"list_transform({x}, lambda x: trim(x))"
_FIRSTS = lambda x: f"list_filter({x}, lambda y, i: lower(y) NOT IN ('', 'nan', 'none', '<na>') AND list_position({x}, y) = i)"
J2_SQL = f"""WITH snap AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'I' || s_nationkey END AS industry, 'ring, N' || s_nationkey || '，none' AS concepts, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 40 END AS rank,
  CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 100 AS DOUBLE) END AS heat, CAST(s_suppkey % 21 - 10 AS DOUBLE) AS trend, CASE WHEN s_suppkey % 2 = 0 THEN 'B' || s_nationkey || ':9' ELSE '' END AS summary FROM supplier),
m AS (SELECT l_suppkey AS code, p_brand AS industry, replace(p_name, ' ', ',') || ', ring ,' || p_type AS concepts, p_size AS rank, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 120 + 0.5 END AS heat, p_partkey % 31 - 15 AS trend, p_name || ' : 1|' || p_type || '|B3:9' AS summary
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey <> 0 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1),
j AS (SELECT s.*, m.code IS NOT NULL AS hit, m.industry AS i2, m.rank AS r2, m.heat AS h2, m.trend AS t2, {_TRIM("split(replace(s.concepts, '，', ',') || coalesce(',' || m.concepts, ''), ',')")} AS cs, {_TRIM("split(s.summary || coalesce('|' || m.summary, ''), '|')")} AS ss FROM snap s LEFT JOIN m USING (code)),
u AS (SELECT *, CASE WHEN hit THEN list_aggregate({_FIRSTS("cs")}, 'string_agg', ',') ELSE concepts END AS c2, CASE WHEN hit THEN list_aggregate({_FIRSTS("ss")}[1:8], 'string_agg', ' | ') ELSE summary END AS s2,
  hit AND industry = '' AS ci, hit AND (rank IS NULL OR r2 < rank) AS cr, coalesce(h2 IS NOT NULL AND (heat IS NULL OR h2 > heat), false) AS ch, coalesce(abs(t2) > abs(trend), false) AS ct FROM j)
SELECT code, CASE WHEN ci THEN i2 ELSE industry END AS industry, c2 AS concepts, CASE WHEN cr THEN r2 ELSE rank END AS industry_rank, CASE WHEN ch THEN h2 ELSE heat END AS board_heat_score, CASE WHEN ct THEN t2 ELSE trend END AS board_heat_trend_score, s2 AS board_heat_summary,
  concat_ws(',', CASE WHEN ci THEN 'industry' END, CASE WHEN c2 <> concepts THEN 'concepts' END, CASE WHEN cr THEN 'industry_rank' END, CASE WHEN ch THEN 'board_heat_score' END, CASE WHEN ct THEN 'board_heat_trend_score' END, CASE WHEN s2 <> summary THEN 'board_heat_summary' END) AS changed FROM u"""


def j13_best_board(s: SparkSession, d: str) -> DataFrame:
    """Parts whose names' words are boards; a board's trend comes from the parts that it names."""
    part = t(s, d, "part")
    word = part.select(F.explode(F.split("p_name", " ")).alias("board"), "p_size", "p_partkey")
    trends = word.where("board <> 'red'").groupBy("board").agg(
        F.max("p_size").cast("double").alias("board_heat_latest_score"), (F.min("p_size") - F.max(c("p_partkey") % 97)).cast("double").alias("board_heat_trend_score"), F.min("p_size").cast("double").alias("board_heat_persistence_score"),
        F.lit(0.0).alias("board_heat_cooling_score"), F.pmod(F.count(F.lit(1)), F.lit(3)).alias("board_heat_observations"), F.max("board").alias("board_heat_state"))
    mapping = part.select("p_partkey", F.concat(F.regexp_replace("p_name", " ", ":1 |"), F.lit(": 2")).alias("board_heat_summary"), F.lit("before").alias("board_heat_state"))
    return lb.best_board_trend(mapping, trends, "p_partkey").select("p_partkey", "board_heat_state", "board_heat_observations", "board_heat_latest_score", "board_heat_trend_score")


J13_SQL = """WITH w AS (SELECT unnest(split(p_name, ' ')) AS board, p_size, p_partkey FROM part),
tr AS (SELECT board, CAST(max(p_size) AS DOUBLE) AS latest, CAST(min(p_size) - max(p_partkey % 97) AS DOUBLE) AS trend, count(*) % 3 AS obs FROM w WHERE board <> 'red' GROUP BY 1),
n AS (SELECT p_partkey, unnest(split(p_name, ' ')) AS board, unnest(range(1, len(split(p_name, ' ')) + 1)) AS place FROM part),
best AS (SELECT * FROM n JOIN tr USING (board) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY obs DESC, latest DESC, abs(trend) DESC, place) = 1)
SELECT p_partkey, coalesce(board, 'before') AS board_heat_state, obs AS board_heat_observations, latest AS board_heat_latest_score, trend AS board_heat_trend_score FROM part LEFT JOIN best USING (p_partkey)"""


def j18_fan_out(s: SparkSession, d: str) -> DataFrame:
    """Order priorities with the customers of all nations they reach, each customer once."""
    orders = t(s, d, "orders").join(t(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    universe = orders.where("o_totalprice > 450000").groupBy("o_orderpriority").agg(F.collect_set("c_nationkey").alias("members"))
    return lb.fan_out(universe, "members", t(s, d, "customer").withColumnRenamed("c_nationkey", "nation"), "nation").select("o_orderpriority", "nation", "c_custkey")


J18_SQL = "SELECT DISTINCT o_orderpriority, b.c_nationkey AS nation, b.c_custkey FROM orders JOIN customer a ON o_custkey = a.c_custkey JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE o_totalprice > 450000"

def f20_resolve_names(s: SparkSession, d: str) -> DataFrame:
    """Names of parts with a letter left out or another in its place, and what they resolve to."""
    part = t(s, d, "part").select("p_name", "p_partkey")
    place = (c("p_partkey") % F.char_length("p_name") + 1).cast("int")
    slip = F.when(c("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.substring(c("p_name"), F.lit(1), place - 1), F.when(c("p_partkey") % 3 == 1, "q").otherwise(""), F.substring(c("p_name"), place + 1, F.char_length("p_name"))))
    out = nm.resolve(part.select(slip.alias("piece")), part.select(c("p_name").alias("name")))
    return out.withColumn("matches", F.array_join("matches", ","))


QUERIES = {"f20_resolve_names": f20_resolve_names, "j2_merge": j2_merge, "j13_best_board": j13_best_board, "j18_fan_out": j18_fan_out}
ORACLES = {"j2_merge": J2_SQL, "j13_best_board": J13_SQL, "j18_fan_out": J18_SQL}
