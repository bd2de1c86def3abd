"""Queries of research signals, upserts and entity resolution, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.operators import indicators as ind
from quantloom.operators import research as rs
from quantloom.operators import sentiment as sm
from quantloom.plans import indicator_queries as iq
from quantloom.sources import tables

c = F.col
t = tables.table
KEY = ["code", "date"]


def _bars(step, *columns: str, source=tables.daily_bars):
    return lambda s, d: rounded(step(source(s, d)).select(*KEY, *columns))


def _scored(s: SparkSession, d: str) -> DataFrame:
    df = tables.weekly_bars(s, d)
    rsi = ind.wilder_rsi(df.select("code", "date", "close"), 12).select("code", "date", "rsi")
    signal = ind.macd_signal(df.select("code", "date", "close")).select("code", "date", "signal")
    out = rs.support_resistance(rs.volume_status(ind.trend_state(df))).join(rsi, KEY).join(signal, KEY)
    return rs.trade_score(out).select(*KEY, "trade_score")


def _heat(s: SparkSession, d: str) -> DataFrame:
    """A heat for each nation and month: 40 and a tenth of a thousandth of its sales, at most 100."""
    o = t(s, d, "orders").join(t(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    rows = o.groupBy(c("c_nationkey").cast("long").alias("board"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("at")).agg(F.count("*").alias("n"))
    return rows.select("board", "at", (40 + c("n") * 7 % 61).cast("double").alias("heat"))


def _levels(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").select(c("l_suppkey").alias("code"), F.round(c("l_extendedprice") / c("l_quantity") / 100).alias("price"), c("l_quantity").cast("double").alias("weight"))


def _light(s: SparkSession, d: str) -> DataFrame:
    days = sm.breadth(tables.daily_bars(s, d))
    return rs.market_light(days.withColumn("index_change", F.round(c("median_change"), 6) * 100)).select("date", "breadth_score", "index_score", "limit_score", "score", "label")


def _positions(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "lineitem").select(c("l_suppkey").alias("account"), (c("l_partkey") % 7).alias("symbol"), (c("l_extendedprice") / c("l_quantity")).alias("price"), c("l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("at"))
    return rows.groupBy("account", "symbol").agg((F.sum(c("price") * c("l_quantity")) / F.sum("l_quantity")).alias("avg_cost"), F.max_by("price", "at").alias("last_price"))


def _requests(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events ask for users' names; suppliers lend the names, with a second holder for some."""
    e = t(s, d, "events").select(c("event_id").alias("id"), (c("user_id") % 40).cast("long").alias("alias"), F.to_date("ts").alias("day"), F.to_date("ts").alias("known_at"))
    k = c("s_suppkey")
    a = t(s, d, "supplier").select((k % 37).cast("long").alias("alias"), (k % 50).cast("long").alias("entity"), F.date_add(F.lit("1990-01-01").cast("date"), (k * 11 % 9000).cast("int")).alias("valid_from"), F.when(k % 3 == 0, F.date_add(F.lit("1995-01-01").cast("date"), (k * 7 % 12000).cast("int"))).alias("valid_to"),
        F.lit("1990-01-01").cast("date").alias("available_at"), F.when(k % 17 == 0, "REJECTED").when(k % 29 == 0, "CONFLICT").otherwise("VERIFIED").alias("state"), (k % 5 != 0).alias("active")).where(c("entity") > 5)
    return e, a


def _url(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "pages")
    return rs.upsert(p.select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), "page_id", F.when(c("page_id") % 3 != 0, c("url")).alias("url"), F.length("html").cast("long").alias("size")), ["host"], "page_id", ["url", "size"])


def _merged(s: SparkSession, d: str) -> DataFrame:
    b = tables.daily_bars(s, d).select("code", "date", "close", "volume")
    last = b.groupBy("code").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"), F.max_by("volume", "date").alias("volume"))
    quotes = last.select("code", F.when(c("code") % 2 == 0, c("date")).otherwise(F.date_add("date", 1)).alias("date"), (c("close") * 1.01).alias("close"), F.when(c("code") % 3 != 0, c("volume")).alias("volume"))
    return rounded(rs.merge_realtime(b, quotes))


def _supplemented(s: SparkSession, d: str) -> DataFrame:
    snap = tables.snapshot(s, d).select("code", "pe_ratio", "pb_ratio", "signal_score")
    other = t(s, d, "supplier").select(c("s_suppkey").alias("code"), F.lit(1.0).alias("pe_ratio"), F.when(c("s_suppkey") % 2 == 0, 2.0).alias("pb_ratio"), F.lit(None).cast("double").alias("signal_score"))
    return rs.supplement(snap, other, "code")


def _first_day(s: SparkSession, d: str) -> DataFrame:
    """The first activity of each customer over orders and user events."""
    o = t(s, d, "orders").select(c("o_custkey").alias("account"), F.to_date("o_orderdate").alias("day"))
    e = t(s, d, "events").select(c("user_id").alias("account"), F.to_date("ts").alias("day"))
    return o.unionByName(e).groupBy("account").agg(F.min("day").alias("first_day"))


def _profile(s: SparkSession, d: str) -> DataFrame:
    snap = tables.snapshot(s, d)
    return rounded(snap.groupBy("concepts").agg(F.count("*").alias("n"), F.avg((c("change_pct") > 0).cast("double")).alias("up_ratio"), F.median("change_pct").alias("median_change"), F.avg("change_pct").alias("mean_change"), F.median("amount").alias("median_amount"), F.avg((c("volume_ratio") >= 2).cast("double")).alias("active_share"), F.max_by("code", F.struct("change_pct", "code")).alias("top_code")))


def _ends(s: SparkSession, d: str) -> DataFrame:
    """The three best and the three worst of each region by change; a null change is left out."""
    snap = tables.snapshot(s, d).where("change_pct is not null")
    best = F.row_number().over(Window.partitionBy("concepts").orderBy(c("change_pct").desc(), "code"))
    worst = F.row_number().over(Window.partitionBy("concepts").orderBy(c("change_pct").asc(), "code"))
    return snap.withColumns({"best": best, "worst": worst}).where("best <= 3 or worst <= 3").select("concepts", "code", "best", "worst")


def _coverage(s: SparkSession, d: str) -> DataFrame:
    days = t(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count("*").alias("expected"), F.count_if(c("l_returnflag") != "R").alias("observed"))
    return rs.coverage_flag(days.withColumn("excluded", c("expected") - c("observed"))).select("date", "expected", "observed", "met")


def _duplicates(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def _date_sets(s: SparkSession, d: str) -> DataFrame:
    """Days on which only one of shipping and receipts of orders has rows, by year."""
    a = t(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    b = t(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    one = a.join(b, "date", "left_anti").withColumn("side", F.lit("bars")).union(b.join(a, "date", "left_anti").withColumn("side", F.lit("calendar")))
    return one.groupBy("side", F.year("date").alias("year")).agg(F.count("*").alias("n"))


QUERIES = {
    "w5_volume_status": _bars(rs.volume_status, "volume_ratio_5d", "volume_status"),
    "w25_support_resistance": _bars(lambda df: rs.support_resistance(ind.moving_averages(df, (5, 10, 20))).withColumn("levels", F.size("support_levels")), "support_ma5", "support_ma10", "resistance", "levels"),
    "w26_trade_score": _scored,
    "w32_day_context": _bars(lambda df: rs.day_context(ind.moving_averages(df, (5, 10, 20))), "volume_change", "price_change", "ma_status"),
    "w43_amount_ratio": _bars(lambda df: rs.amount_ratio(df.withColumn("amount", F.when(F.dayofmonth("date") % 7 != 0, c("amount")))), "amount_ratio_20"),
    "w44_f8_f18_board_heat": lambda s, d: rounded(rs.board_heat_trend(_heat(s, d)).withColumns({"stage": rs.hotspot_stage(), "theme_heat": rs.theme_heat()})),
    "w47_volume_spike": _bars(rs.volume_spike, "triggered"),
    "w50_change_percent": _bars(lambda df: rs.change_percent(df, 0.0), "pct_chg"),
    "a13_distinct_types": lambda s, d: t(s, d, "events").select("event_type").distinct(),
    "a14_first_day": _first_day,
    "a18_stop_loss": lambda s, d: rounded(rs.stop_loss(_positions(s, d), 20.0, 0.5).select("account", "symbol", "loss_pct"), 4),
    "a19_market_light": _light,
    "a2_action_breakdown": lambda s, d: t(s, d, "events").groupBy(F.coalesce(F.nullif(F.trim(F.regexp_replace("event_type", "^view$", " ")), F.lit("")), F.lit("(unknown)")).alias("action")).agg(F.count("*").alias("n")),
    "a20_a21_snapshot_profile": _profile,
    "a28_cost_distribution": lambda s, d: rounded(rs.cost_distribution(_levels(s, d), tables.daily_bars(s, d).groupBy("code").agg((F.max_by("close", "date") / 100).alias("close")))),
    "a30_calibration": lambda s, d: rounded(rs.calibration(t(s, d, "events").select(c("user_id").alias("agent"), (c("value") > 50).alias("right")), "agent", least=10)),
    "f16_r4_stock_roles": lambda s, d: rounded(rs.stock_roles(tables.snapshot(s, d).withColumn("hot_score", F.round(rs.hotspot_score(active_days=c("code") % 5, evidence=c("code") % 7), 4)), "industry").select("code", "industry", "hot_score", "place", "role")),
    "r13_ends": _ends,
    "s12_merge_realtime": _merged,
    "s13_supplement": _supplemented,
    "d7_relaxed_duplicates": lambda s, d: rs.relaxed_duplicates(t(s, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day")), ["user_id", "event_type", "day"], "event_id").select("event_id", "survivor"),
    "d9_duplicate_keys": _duplicates,
    "d10_page_upsert": _url,
    "d11_date_sets": _date_sets,
    "j12_alias_resolution": lambda s, d: rs.resolve_aliases(*_requests(s, d)),
    "m6_coverage_flag": _coverage,
    "m11_worst_state": lambda s, d: rs.worst_state(t(s, d, "orders").select("o_custkey", F.element_at(F.array(*map(F.lit, rs.STATES)), (c("o_orderkey") % 5 + 1).cast("int")).alias("state")), "o_custkey", "state"),
}

B, W = iq.B, iq.W
LAG = iq.LAG
_O = "OVER (PARTITION BY code ORDER BY date)"
_V5 = f"avg(volume) OVER {iq._P5}"
_VOL = f"v AS (SELECT *, CASE WHEN row_number() {_O} >= 5 AND {_V5} > 0 THEN volume / {_V5} ELSE 0 END AS r5, coalesce(close > {LAG}, false) AS up, row_number() {_O} AS nth FROM bars), vs AS (SELECT *, CASE WHEN nth < 5 THEN 'NORMAL' WHEN r5 >= 1.5::DOUBLE AND up THEN 'HEAVY_VOLUME_UP' WHEN r5 >= 1.5::DOUBLE THEN 'HEAVY_VOLUME_DOWN' WHEN r5 <= 0.7::DOUBLE AND up THEN 'SHRINK_VOLUME_UP' WHEN r5 <= 0.7::DOUBLE THEN 'SHRINK_VOLUME_DOWN' ELSE 'NORMAL' END AS vstat FROM v)"
_MAS = f"{iq._MA(5)} AS a, {iq._MA(10)} AS b, {iq._MA(20)} AS c"
_NEAR = lambda x: f"coalesce(close >= {x} AND abs(close - {x}) / {x} <= 0.02::DOUBLE, false)"
_CASE = lambda x, points, other: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in points.items()) + f" ELSE {other} END"
_PROFILE_STATES = "[" + ", ".join(f"'{x}'" for x in rs.STATES) + "]"

ORACLES = {
    "w5_volume_status": f"{B}, {_VOL} SELECT code, date, round(r5, 6) AS volume_ratio_5d, vstat AS volume_status FROM vs",
    "w25_support_resistance": f"{B}, m AS (SELECT *, {_MAS}, row_number() {_O} AS nth, max(high) OVER {iq._LAST20} AS h FROM bars), n AS (SELECT *, {_NEAR('a')} AS s5, {_NEAR('b')} AS s10 FROM m) SELECT code, date, s5 AS support_ma5, s10 AS support_ma10, round(CASE WHEN nth >= 20 AND h > close THEN h END, 6) AS resistance, CAST(s5 AS INTEGER) + CASE WHEN s10 AND NOT coalesce(s5 AND a = b, false) THEN 1 ELSE 0 END + CASE WHEN close >= c THEN 1 ELSE 0 END AS levels FROM n",
    "w26_trade_score": iq.ORACLES["w10_macd_signal"].split("SELECT CASE WHEN nth")[0].rstrip() + f""", sg AS (SELECT code, date, CASE WHEN nth""" + iq.ORACLES["w10_macd_signal"].split("SELECT CASE WHEN nth")[1].split(", count(*) AS n FROM p")[0] + f""" FROM p), {_VOL},
      dd AS (SELECT code, date, coalesce(close - {LAG}, 0) AS d FROM bars), ll AS (SELECT code, list(date ORDER BY date) AS d, list(greatest(d, 0) ORDER BY date) AS g, list(greatest(-d, 0) ORDER BY date) AS l FROM dd GROUP BY code),
      e2 AS (SELECT code, unnest(d) AS date, unnest({iq._ewm('g', '(1 / 12)')}) AS g, unnest({iq._ewm('l', '(1 / 12)')}) AS l FROM ll), ri AS (SELECT code, date, CASE WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM e2),
      ma AS (SELECT code, date, close, {_MAS} FROM bars), s4 AS (SELECT *, lag(a, 4) {_O} AS a4, lag(c, 4) {_O} AS c4 FROM ma),
      tw AS (SELECT *, coalesce(CASE WHEN a < c THEN (c - a) / a * 100 > 5 AND (c - a) / a > (c4 - a4) / a4 ELSE (a - c) / c * 100 > 5 AND (a - c) / c > (a4 - c4) / c4 END, false) AS wide FROM s4),
      tt AS (SELECT *, CASE WHEN c IS NULL THEN NULL WHEN a > b AND b > c AND wide THEN 'STRONG_BULL' WHEN a > b AND b > c THEN 'BULL' WHEN a < b AND b < c AND wide THEN 'STRONG_BEAR' WHEN a < b AND b < c THEN 'BEAR' WHEN a > b AND b <= c THEN 'WEAK_BULL' WHEN a < b AND b >= c THEN 'WEAK_BEAR' ELSE 'CONSOLIDATION' END AS trend, coalesce((close - a) / a * 100, 0) AS bias, {_NEAR('a')} AS s5, {_NEAR('b')} AS s10 FROM tw)
      SELECT tt.code, tt.date, CASE WHEN row_number() OVER (PARTITION BY tt.code ORDER BY tt.date) >= 20 THEN {_CASE('trend', rs.TREND_POINTS, 12)} + CASE WHEN bias < 0 AND bias > -3 THEN 20 WHEN bias < 0 AND bias > -5 THEN 16 WHEN bias < 0 THEN 8 WHEN bias < 2 THEN 18 WHEN bias < 5 THEN 14 WHEN bias > CASE WHEN trend = 'STRONG_BULL' THEN 7.5 ELSE 5 END THEN 4 WHEN bias > 5 AND trend = 'STRONG_BULL' THEN 10 ELSE 4 END
        + {_CASE('vstat', rs.VOLUME_POINTS, 8)} + CAST(s5 AS INTEGER) * 5 + CAST(s10 AS INTEGER) * 5 + {_CASE('signal', rs.MACD_POINTS, 5)} + CASE WHEN rsi > 70 THEN 0 WHEN rsi > 60 THEN 8 WHEN rsi >= 40 THEN 5 WHEN rsi >= 30 THEN 3 WHEN rsi < 30 THEN 10 ELSE 5 END END AS trade_score
      FROM tt JOIN vs ON tt.code = vs.code AND tt.date = vs.date JOIN sg ON tt.code = sg.code AND tt.date = sg.date JOIN ri ON tt.code = ri.code AND tt.date = ri.date""",
    "w32_day_context": f"{B}, m AS (SELECT *, {_MAS}, {LAG} AS p, lag(volume) {_O} AS pv FROM bars) SELECT code, date, round(CASE WHEN pv > 0 THEN volume / pv END, 6) AS volume_change, round(CASE WHEN p > 0 THEN (close / p - 1) * 100 END, 6) AS price_change, CASE WHEN close > a AND a > b AND b > c THEN 'bull' WHEN close < a AND a < b AND b < c THEN 'bear' WHEN close > a AND a > b THEN 'short_up' WHEN close < a AND a < b THEN 'short_down' ELSE 'mixed' END AS ma_status FROM m",
    "w43_amount_ratio": f"{B}, x AS (SELECT code, date, CASE WHEN day(date) % 7 <> 0 THEN amount END AS amount FROM bars), l AS (SELECT *, list(amount) FILTER (amount IS NOT NULL) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM x) SELECT code, date, round(CASE WHEN len(past) >= 20 THEN amount / list_avg(past[-20:]) END, 6) AS amount_ratio_20 FROM l",
    "w44_f8_f18_board_heat": """WITH h AS (SELECT CAST(c_nationkey AS BIGINT) AS board, date_trunc('month', o_orderdate) AS mon, CAST(40 + count(*) * 7 % 61 AS DOUBLE) AS heat FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY mon DESC) AS nth FROM h WHERE heat BETWEEN 0 AND 100 QUALIFY nth <= 5), g AS (SELECT board, arg_min(heat, nth) AS latest, arg_max(heat, nth) AS f, max(CASE WHEN nth = 2 THEN heat END) AS p, avg(CASE WHEN heat >= 60 THEN 1 ELSE 0 END) * 100 AS persistence, count(*) AS observations FROM r GROUP BY board),
      k AS (SELECT board, latest, latest - f AS trend, persistence, greatest(coalesce(p, latest) - latest, 0) AS cooling_score, observations FROM g),
      y AS (SELECT *, CASE WHEN cooling_score >= 5 THEN 'cooling' WHEN trend >= 5 THEN 'warming' WHEN persistence >= 66.6667::DOUBLE THEN 'persistent_hot' WHEN trend <= -5 THEN 'weakening' ELSE 'flat' END AS state FROM k),
      z AS (SELECT *, latest + CASE WHEN observations >= 2 THEN least(greatest(trend, 0) * 0.8::DOUBLE, 10) - least(greatest(-trend, 0) * 0.8::DOUBLE, 12) ELSE 0 END + least(greatest(persistence - 60, 0) * 0.08::DOUBLE, 6) - least(cooling_score * 0.6::DOUBLE, 10) AS s FROM y)
      SELECT board, latest, trend, round(persistence, 6) AS persistence, CAST(cooling_score AS DOUBLE) AS cooling_score, observations, state, CASE WHEN state IN ('weakening', 'cooling') AND (latest < 60 OR trend <= -5) THEN 'retreat' WHEN cooling_score >= 8 AND (latest < 60 OR trend <= -5) THEN 'retreat' WHEN cooling_score >= 5 THEN 'divergence' WHEN latest >= 75 AND trend >= 8 AND persistence >= 50 THEN 'acceleration' WHEN state = 'persistent_hot' OR persistence >= 66.6667::DOUBLE THEN 'diffusion' WHEN trend >= 5 AND observations >= 2 THEN 'diffusion' ELSE 'first_move' END AS stage,
        round(least(100, greatest(0, s - greatest(s - 88, 0) * 0.5::DOUBLE)), 6) AS theme_heat FROM z""",
    "w47_volume_spike": f"{B} SELECT code, date, volume > 2 * ({iq._full('avg', 'volume', 20)}) AS triggered FROM bars",
    "w50_change_percent": f"{B} SELECT code, date, round(CASE WHEN {LAG} IS NULL THEN 0 ELSE (close / {LAG} - 1) * 100 END, 6) AS pct_chg FROM bars",
    "a13_distinct_types": "SELECT DISTINCT event_type FROM events",
    "a14_first_day": "SELECT account, min(day) AS first_day FROM (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS day FROM orders UNION ALL SELECT user_id, CAST(ts AS DATE) FROM events) GROUP BY 1",
    "a18_stop_loss": """WITH p AS (SELECT l_suppkey AS account, l_partkey % 7 AS symbol, sum(l_extendedprice / l_quantity * l_quantity) / sum(l_quantity) AS avg_cost, list(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)[-1] AS last_price FROM lineitem GROUP BY 1, 2),
      q AS (SELECT account, symbol, greatest(0, (avg_cost - last_price) / avg_cost * 100) AS loss_pct FROM p WHERE avg_cost > 0) SELECT account, symbol, round(loss_pct, 4) AS loss_pct FROM q WHERE loss_pct >= 10""",
    "a19_market_light": f"""{B}, b AS (SELECT *, {LAG} AS p FROM bars), s AS (SELECT *, close / p - 1 AS ch, close >= floor(p * (1 + 0.1::DOUBLE) * 100 + 0.5::DOUBLE) / 100 - 0.005::DOUBLE AS lu, close <= floor(p * (1 - 0.1::DOUBLE) * 100 + 0.5::DOUBLE) / 100 + 0.005::DOUBLE AS ld FROM b),
      g AS (SELECT date, count_if(ch > 0) AS u, count_if(ch < 0) AS d, count_if(lu) AS lu, count_if(ld AND NOT lu) AS ld, round(median(ch), 6) * 100 AS i FROM s GROUP BY date),
      k AS (SELECT date, CASE WHEN u + d > 0 THEN CAST(trunc(u / (u + d) * 100) AS INTEGER) ELSE 50 END AS x, CASE WHEN i IS NOT NULL THEN CAST(trunc(least(100, greatest(0, 50 + i * 12))) AS INTEGER) ELSE 50 END AS y, CASE WHEN lu + ld > 0 THEN CAST(trunc(lu / (lu + ld) * 100) AS INTEGER) ELSE 50 END AS z FROM g),
      r AS (SELECT *, x * 45 + y * 35 + z * 20 AS h FROM k), w AS (SELECT *, CAST(h // 100 + CASE WHEN h % 100 > 50 OR (h % 100 = 50 AND (h // 100) % 2 = 1) THEN 1 ELSE 0 END AS INTEGER) AS score FROM r)
      SELECT date, x AS breadth_score, y AS index_score, z AS limit_score, score, CASE WHEN score >= 70 THEN 'risk-on' WHEN score >= 55 THEN 'constructive' WHEN score >= 40 THEN 'mixed' ELSE 'defensive' END AS label FROM w""",
    "a2_action_breakdown": "SELECT CASE WHEN event_type = 'view' THEN '(unknown)' ELSE event_type END AS action, count(*) AS n FROM events GROUP BY 1",
    "a20_a21_snapshot_profile": f"WITH {tables.SNAPSHOT_SQL} SELECT concepts, count(*) AS n, round(avg(CASE WHEN change_pct > 0 THEN 1 ELSE 0 END), 6) AS up_ratio, round(median(change_pct), 6) AS median_change, round(avg(change_pct), 6) AS mean_change, round(median(amount), 6) AS median_amount, round(avg(CASE WHEN volume_ratio >= 2 THEN 1 ELSE 0 END), 6) AS active_share, list(code ORDER BY change_pct DESC, code DESC)[1] AS top_code FROM snap GROUP BY concepts",
    "a28_cost_distribution": f"""{B}, p AS (SELECT l_suppkey AS code, round(l_extendedprice / l_quantity / 100) AS price, sum(CAST(l_quantity AS DOUBLE)) AS weight FROM lineitem GROUP BY 1, 2), k AS (SELECT code, arg_max(close, date) / 100 AS close FROM bars GROUP BY code),
      x AS (SELECT p.*, close, sum(weight) OVER (PARTITION BY p.code ORDER BY price ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY p.code) * 100 AS share FROM p JOIN k ON p.code = k.code),
      y AS (SELECT code, sum(CASE WHEN price <= close THEN weight ELSE 0 END) / sum(weight) AS winner_rate, sum(price * weight) / sum(weight) AS avg_cost, """ + ", ".join(f"coalesce(min(CASE WHEN share >= {q} THEN price END), max(price)) AS c{q}" for q in (5, 15, 85, 95)) + """ FROM x GROUP BY code)
      SELECT code, round(winner_rate, 6) AS winner_rate, round(avg_cost, 6) AS avg_cost, c5, c15, c85, c95, round(CASE WHEN c5 + c95 <> 0 THEN (c95 - c5) / (c95 + c5) ELSE 0 END, 6) AS concentration_90, round(CASE WHEN c15 + c85 <> 0 THEN (c85 - c15) / (c85 + c15) ELSE 0 END, 6) AS concentration_70 FROM y""",
    "a30_calibration": "SELECT user_id AS agent, count(*) AS samples, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS accuracy, round(CASE WHEN count(*) >= 10 THEN least(1.5::DOUBLE, greatest(0.5::DOUBLE, avg(CASE WHEN value > 50 THEN 1 ELSE 0 END) / 0.6::DOUBLE)) ELSE 1 END, 6) AS factor FROM events GROUP BY 1",
    "f16_r4_stock_roles": f"""WITH {tables.SNAPSHOT_SQL}, h AS (SELECT *, round(least(100, greatest(0, 35 + least(32, greatest(-18, change_pct * 2.7::DOUBLE)) + CASE WHEN amount > 0 THEN least(18, greatest(0, (log10(amount) - 6) / 4 * 18)) ELSE 0 END + least(14, greatest(0, turnover_rate * 1.1::DOUBLE)) + least(12, greatest(0, volume_ratio * 3)) + least(8, code % 5 * 2.5::DOUBLE) + least(8, code % 7 * 2))), 4) AS s FROM snap),
      r AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY s DESC, change_pct DESC, amount DESC, code DESC) AS n, max(s) OVER (PARTITION BY industry) AS top FROM h)
      SELECT code, industry, s AS hot_score, CAST(n AS INTEGER) AS place, CASE WHEN n = 1 AND s >= 70 THEN 'leader' WHEN n <= 3 AND s >= greatest(68, top - 8) AND change_pct >= 5 THEN 'leader' WHEN s >= 62 AND change_pct >= 3 THEN 'support' WHEN s >= 48 AND change_pct >= 0 THEN 'catch_up' WHEN s >= 38 THEN 'rear' ELSE 'laggard' END AS role FROM r""",
    "r13_ends": f"WITH {tables.SNAPSHOT_SQL} SELECT concepts, code, CAST(row_number() OVER (PARTITION BY concepts ORDER BY change_pct DESC, code) AS INTEGER) AS best, CAST(row_number() OVER (PARTITION BY concepts ORDER BY change_pct, code) AS INTEGER) AS worst FROM snap WHERE change_pct IS NOT NULL QUALIFY best <= 3 OR worst <= 3",
    "s12_merge_realtime": f"""{B}, l AS (SELECT code, max(date) AS d, arg_max(close, date) AS k, arg_max(volume, date) AS v FROM bars GROUP BY code), q AS (SELECT code, CAST(CASE WHEN code % 2 = 0 THEN d ELSE d + INTERVAL 1 DAY END AS DATE) AS date, k * 1.01::DOUBLE AS close, CASE WHEN code % 3 <> 0 THEN v END AS volume FROM l)
      SELECT q.code, q.date, round(q.close, 6) AS close, coalesce(q.volume, b.volume) AS volume FROM q LEFT JOIN bars b ON b.code = q.code AND b.date = q.date UNION ALL SELECT b.code, b.date, round(b.close, 6), b.volume FROM bars b WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.code = b.code AND q.date = b.date)""",
    "s13_supplement": f"WITH {tables.SNAPSHOT_SQL} SELECT code, coalesce(pe_ratio, 1) AS pe_ratio, coalesce(pb_ratio, CASE WHEN code % 2 = 0 THEN CAST(2 AS DOUBLE) END) AS pb_ratio, signal_score FROM snap",
    "d7_relaxed_duplicates": "SELECT event_id, m AS survivor FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS m FROM events) WHERE event_id <> m",
    "d9_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "d10_page_upsert": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, arg_max(url, page_id) FILTER (page_id % 3 <> 0) AS url, arg_max(CAST(length(html) AS BIGINT), page_id) AS size FROM pages GROUP BY 1",
    "d11_date_sets": """WITH a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), o AS (SELECT 'bars' AS side, d FROM a WHERE d NOT IN (SELECT d FROM b) UNION ALL SELECT 'calendar', d FROM b WHERE d NOT IN (SELECT d FROM a))
      SELECT side, CAST(year(d) AS INTEGER) AS year, count(*) AS n FROM o GROUP BY 1, 2""",
    "j12_alias_resolution": """WITH r AS (SELECT event_id AS id, user_id % 40 AS alias, CAST(ts AS DATE) AS day FROM events),
      a AS (SELECT s_suppkey % 37 AS alias, s_suppkey % 50 AS entity, DATE '1990-01-01' + CAST(s_suppkey * 11 % 9000 AS INTEGER) AS vf, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1995-01-01' + CAST(s_suppkey * 7 % 12000 AS INTEGER) END AS vt, CASE WHEN s_suppkey % 17 = 0 THEN 'REJECTED' WHEN s_suppkey % 29 = 0 THEN 'CONFLICT' ELSE 'VERIFIED' END AS state, s_suppkey % 5 <> 0 AS active FROM supplier WHERE s_suppkey % 50 > 5),
      j AS (SELECT id, a.*, coalesce(vf <= day AND (vt IS NULL OR day < vt) AND state <> 'REJECTED', false) AS fits FROM r LEFT JOIN a ON r.alias = a.alias),
      g AS (SELECT id, bool_or(coalesce(state = 'CONFLICT', false)) AS o, count(DISTINCT CASE WHEN fits THEN entity END) AS n, min(CASE WHEN fits THEN entity END) AS e, bool_or(fits AND active) AS live FROM j GROUP BY id)
      SELECT id, CASE WHEN o THEN 'CONFLICT' WHEN n = 0 THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' WHEN NOT live THEN 'INACTIVE' ELSE 'RESOLVED' END AS status, CASE WHEN n = 1 THEN e END AS entity FROM g""",
    "m6_coverage_flag": "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS expected, CAST(count_if(l_returnflag <> 'R') AS BIGINT) AS observed FROM lineitem GROUP BY 1) SELECT date, expected, observed, observed / expected >= 0.998::DOUBLE AND (expected - observed) / expected <= 0.002::DOUBLE AND expected - observed <= 10 AS met FROM d",
    "m11_worst_state": f"SELECT o_custkey, {_PROFILE_STATES}[max(o_orderkey % 5 + 1)] AS state FROM orders GROUP BY 1",
}
