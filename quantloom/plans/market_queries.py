"""Queries of back-tests, portfolios, market state and text tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.operators import backtest as bt
from quantloom.operators import portfolio as pf
from quantloom.operators import sentiment as sm
from quantloom.sources import tables

c = F.col
t = tables.table


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    return bt.evaluate(tables.advice(s, d), tables.event_bars(s, d))


def _trades(s: SparkSession, d: str) -> DataFrame:
    """Orders as a ledger: returns are sales. (order, line) isn't unique, so ids follow a full order."""
    rows = t(s, d, "lineitem").join(t(s, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.select(c("o_custkey").alias("account"), (c("l_partkey") % 3).alias("symbol"), F.row_number().over(order).cast("long").alias("id"), F.to_date("o_orderdate").alias("date"), F.when(c("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), c("l_quantity").alias("quantity"), (c("l_extendedprice") / c("l_quantity")).alias("price"))


def _rates(s: SparkSession, d: str) -> DataFrame:
    """A yearly rate for two of three nations, none for the rest."""
    o = t(s, d, "orders").join(t(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    return o.where("c_nationkey % 3 <> 0").groupBy(c("c_nationkey").cast("long").alias("code"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg((F.count("*") / 10).alias("rate"))


def _orders_by_nation(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders").join(t(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    return o.select(c("o_orderkey").alias("id"), c("c_nationkey").cast("long").alias("code"), F.to_date("o_orderdate").alias("date"), c("o_totalprice").alias("amount"))


def j7_as_of(s: SparkSession, d: str) -> DataFrame:
    return rounded(bt.as_of(_orders_by_nation(s, d), _rates(s, d), ["date", "rate"]))


def j8_strictly_before(s: SparkSession, d: str) -> DataFrame:
    return rounded(bt.as_of(_orders_by_nation(s, d), _rates(s, d), ["rate"], strict=True))


def j16_convert(s: SparkSession, d: str) -> DataFrame:
    rows = bt.as_of(_orders_by_nation(s, d), _rates(s, d), ["rate"])
    value, stale = pf.convert(c("amount"), c("asof_rate"), F.lit(None).cast("double"))
    return rounded(rows.groupBy("code").agg(F.sum(value).alias("value"), F.count_if(stale).alias("stale")), 2)


def b8_fifo(s: SparkSession, d: str) -> DataFrame:
    # A ten-millionth more: exact halves, where sums of floats differ by engine, then round alike.
    m = pf.fifo_matches(_trades(s, d))
    return rounded(m.groupBy("account", "symbol").agg(F.count("*").alias("matches"), F.sum("quantity").alias("quantity"), (F.sum("profit") + 1e-7).alias("profit")), 2)


def a16_concentration(s: SparkSession, d: str) -> DataFrame:
    p = _trades(s, d).groupBy("symbol", "account").agg(F.sum(c("quantity") * c("price")).alias("exposure"))
    return rounded(pf.concentration(p, "account", alert_pct=0.1), 4)


def a17_drawdown(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events").select((c("user_id") % 5).alias("book"), F.to_date("ts").alias("date"), c("value").alias("equity"))
    return rounded(pf.equity_drawdown(e, ["book"]), 4)


def j11_in_force(s: SparkSession, d: str) -> DataFrame:
    """Customers' orders and the status interval that holds their day: from one order to the next."""
    o = t(s, d, "orders").select(c("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), c("o_orderstatus").alias("status"))
    first = o.groupBy("k", "day").agg(F.max("status").alias("status"))
    spans = first.select("k", c("day").alias("valid_from"), F.lead("day").over(Window.partitionBy("k").orderBy("day")).alias("valid_to"), c("status").alias("in_force"))
    return sm.in_force(o, spans, "k", "day").groupBy("k").agg(F.count("*").alias("n"), F.count_if(c("status") == c("in_force")).alias("same"))


def j14_changes(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders")
    old, new = o.where("o_orderkey % 10 <> 1"), o.where("o_orderkey % 10 <> 2").withColumn("o_orderstatus", F.when(c("o_orderkey") % 10 == 3, "X").otherwise(c("o_orderstatus")))
    return sm.changes(old, new, ["o_orderkey"], ["o_orderstatus", "o_custkey"]).groupBy("change").agg(F.count("*").alias("n"))


def s20_known_at(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders").select(c("o_custkey").alias("k"), c("o_orderkey").alias("revision"), c("o_orderdate").alias("available_at"), "o_totalprice")
    return sm.known_at(o, ["k"], F.lit("1997-01-01").cast("timestamp_ntz")).select("k", "revision", "o_totalprice")


def w40_robust_scores(s: SparkSession, d: str) -> DataFrame:
    return rounded(sm.robust_score(tables.weekly_bars(s, d).where("close is not null"), "close").select("code", "date", "score"), 4)


def _agg(name: str, *aggs, by: list, table: str):
    return lambda s, d: rounded(t(s, d, table).groupBy(*by).agg(*aggs), 4)


def a9_skill_weights(s: SparkSession, d: str) -> DataFrame:
    """Actions as skills, three horizons by instrument; what is neutral was only observed."""
    status = F.when(c("status") != "completed", "unable").when(c("outcome") == "neutral", "observational").otherwise("evaluated")
    return rounded(bt.skill_weights(_evaluated(s, d).select(c("action").alias("skill"), (c("code") % 3).alias("horizon"), status.alias("status"), (c("outcome") == "win").alias("hit"))))


def a15_market_breadth(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as stocks of five boards, some of them special; their daily bars in cents."""
    k = c("code")
    code = F.concat(F.element_at(F.array(*map(F.lit, ("600", "688", "300", "830", "900"))), (k % 5 + 1).cast("int")), F.lpad((k % 1000).cast("string"), 3, "0"))
    b = tables.daily_bars(s, d).withColumns({"stock": code, "name": F.when(k % 4 == 0, "*st one").when(k % 4 == 1, "two"), "cents": F.floor(c("close") / 10) / 100})
    b = b.withColumn("prev_close", F.lag("cents").over(Window.partitionBy("code").orderBy("date")))
    # Every third price is the limit of a stock of its kind, so that limits are met.
    moved = F.floor(c("prev_close") * F.when(k % 2 == 0, 1.1).otherwise(0.8) * 100 + 0.5) / 100
    quotes = b.select("date", c("stock").alias("code"), "name", F.when(F.pmod(k + F.unix_date("date"), F.lit(3)) == 0, moved).otherwise(c("cents")).alias("close"), "prev_close", F.when(F.pmod(k + F.unix_date("date"), F.lit(11)) == 0, 0.0).otherwise(c("amount")).alias("amount"))
    return rounded(sm.market_breadth(quotes, ["date"]))


QUERIES = {
    "b1_b2_evaluations": lambda s, d: rounded(_evaluated(s, d).select("id", "code", "status", "end_close", "max_high", "min_low", "return_pct", "first_hit", "hit_days", "outcome")),
    "a1_a4_backtest_summaries": lambda s, d: rounded(bt.summaries(_evaluated(s, d))),
    "a6_breakdowns": lambda s, d: rounded(bt.breakdowns(_evaluated(s, d), ["action", "status", "first_hit"])),
    "a9_skill_weights": a9_skill_weights,
    "a15_market_breadth": a15_market_breadth,
    "b16_invalidations": lambda s, d: bt.invalidations(tables.advice(s, d)).select("id", "side", "invalidated_at"),
    "j7_as_of": j7_as_of,
    "j8_strictly_before": j8_strictly_before,
    "j16_convert": j16_convert,
    "b8_fifo": b8_fifo,
    "b9_average_cost": lambda s, d: rounded(pf.average_cost(_trades(s, d)).withColumns({x: c(x) + 1e-7 for x in ("cost", "profit")}), 4),
    "b11_positions": lambda s, d: rounded(pf.positions(_trades(s, d)), 4),
    "a16_concentration": a16_concentration,
    "a17_drawdown": a17_drawdown,
    "d6_trade_hash": lambda s, d: t(s, d, "orders").select("o_orderkey", pf.trade_hash("o_custkey", "o_orderstatus", "o_orderpriority").alias("hash")),
    "a15_a24_breadth": lambda s, d: rounded(sm.breadth(tables.daily_bars(s, d))),
    "w39_streaks": lambda s, d: sm.streaks(tables.daily_bars(s, d), c("close") > c("open")).select("code", "date", "streak"),
    "w40_robust_scores": w40_robust_scores,
    "j11_in_force": j11_in_force,
    "j14_changes": j14_changes,
    "s20_known_at": s20_known_at,
    "m8_overlaps": lambda s, d: sm.overlapping(t(s, d, "orders").select(c("o_custkey").alias("k"), F.to_date("o_orderdate").alias("valid_from"), F.date_add(F.to_date("o_orderdate"), 60).alias("valid_to")).distinct(), "k").groupBy("k").agg(F.count("*").alias("n")),
    "p15_month_gaps": lambda s, d: sm.month_gaps(t(s, d, "orders").withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day"),
    "a10_usage_totals": lambda s, d: rounded(t(s, d, "events").rollup("event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("total"), F.max("value").alias("most")), 4),
    "a11_sessions": lambda s, d: t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.min_by(F.when(c("role") == "user", c("text")), F.when(c("role") == "user", c("turn"))).alias("title")),
    "a12_latest_row": lambda s, d: t(s, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(c("ts").desc(), c("event_id").desc()))).where("n = 1").select("user_id", "event_id", "value"),
    "a23_volume_price_correlation": lambda s, d: rounded(tables.weekly_bars(s, d).groupBy("code").agg(F.corr("close", "volume").alias("corr"), F.avg(F.when(c("close") > c("open"), c("volume"))).alias("up_volume")), 6),
    "a29_sector_returns": lambda s, d: rounded(tables.snapshot(s, d).groupBy("industry").agg(F.avg("change_pct").alias("change"), F.count("*").alias("n")).withColumn("rank", F.rank().over(Window.orderBy(c("change").desc())))),
    "s16_upsert": lambda s, d: _upsert(s, d),
    "r10_keyset_page": lambda s, d: t(s, d, "events").where("ts < timestamp_ntz'2024-01-15 00:00:00' or ts = timestamp_ntz'2024-01-15 00:00:00' and event_id < 5000").orderBy(c("ts").desc(), c("event_id").desc()).limit(50).select("event_id", "ts"),
    "j5_anti_join": lambda s, d: t(s, d, "customer").join(t(s, d, "orders").where("o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey"),
    "j6_semi_join": lambda s, d: t(s, d, "customer").join(t(s, d, "orders").where("o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey", "c_name"),
    "d1_last_duplicate": lambda s, d: t(s, d, "pages").groupBy(F.split("url", "/")[2].alias("host")).agg(F.max_by("page_id", "page_id").alias("page_id"), F.count("*").alias("pages")),
}


def _upsert(s: SparkSession, d: str) -> DataFrame:
    """Bars of two sources: the later source wins, null ids are filled from the earlier."""
    o = t(s, d, "orders").select(c("o_custkey").alias("code"), F.to_date("o_orderdate").alias("date"), c("o_orderkey").alias("seq"), c("o_totalprice").alias("close"), F.when(c("o_orderkey") % 2 == 0, c("o_orderkey")).alias("canonical_id"))
    w = Window.partitionBy("code", "date").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = o.withColumns({"n": F.row_number().over(Window.partitionBy("code", "date").orderBy(c("seq").desc())), "canonical_id": F.last("canonical_id", ignorenulls=True).over(w)})
    return out.where("n = 1").select("code", "date", "close", "canonical_id")


_EV = f"""WITH {tables.EVENTS_SQL}, {tables.ADVICE_SQL},
fw AS (SELECT code, date, close AS st, list({{'h': high, 'l': low, 'c': close}}) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM ebars),
j AS (SELECT id, a.code, action, st, coalesce(f.a, []) AS a, action IN ('buy', 'add', 'hold') AS lg, CASE WHEN len(coalesce(f.a, [])) < 5 THEN 'insufficient_data' WHEN st IS NULL OR st <= 0 THEN 'error' ELSE 'completed' END AS status FROM advice a JOIN fw f ON a.code = f.code AND a.date = f.date),
k AS (SELECT *, status = 'completed' AS done, CASE WHEN status = 'completed' THEN a[5].c END AS end_close, CASE WHEN status = 'completed' THEN list_max([x.h FOR x IN a]) END AS max_high, CASE WHEN status = 'completed' THEN list_min([x.l FOR x IN a]) END AS min_low,
  list_position([x.l <= st * 0.95::DOUBLE FOR x IN a], true) AS s, list_position([x.h >= st * 1.05::DOUBLE FOR x IN a], true) AS t FROM j),
e AS (SELECT *, (end_close / st - 1) * 100 AS r, CASE WHEN done AND lg THEN CASE WHEN s = t THEN 'ambiguous' WHEN s IS NOT NULL AND s > 0 AND (t IS NULL OR t = 0 OR s < t) THEN 'stop_loss' WHEN t IS NOT NULL AND t > 0 THEN 'take_profit' ELSE 'neither' END END AS first_hit, CASE WHEN done AND lg THEN least(nullif(s, 0), nullif(t, 0)) END AS hit_days FROM k),
ev AS (SELECT *, CASE WHEN NOT done THEN NULL WHEN action IN ('buy', 'add') THEN CASE WHEN r >= 2 THEN 'win' WHEN r <= -2 THEN 'loss' ELSE 'neutral' END WHEN action IN ('sell', 'reduce') THEN CASE WHEN r <= -2 THEN 'win' WHEN r >= 2 THEN 'loss' ELSE 'neutral' END
  WHEN action = 'hold' THEN CASE WHEN r >= 0 THEN 'win' WHEN r <= -2 THEN 'loss' ELSE 'neutral' END ELSE CASE WHEN abs(r) <= 2 THEN 'win' ELSE 'loss' END END AS outcome FROM e)"""


def _rate(part: str, whole: str) -> str:
    return f"round(CASE WHEN count_if({whole}) > 0 THEN count_if({part}) / count_if({whole}) * 100 END, 6)"


_SUM = f"""CAST(count(*) AS BIGINT) AS total, CAST(coalesce(count_if(done), 0) AS BIGINT) AS completed, CAST(coalesce(count_if(status = 'insufficient_data'), 0) AS BIGINT) AS insufficient, CAST(coalesce(count_if(done AND lg), 0) AS BIGINT) AS longs,
  CAST(coalesce(count_if(outcome = 'win'), 0) AS BIGINT) AS wins, CAST(coalesce(count_if(outcome = 'loss'), 0) AS BIGINT) AS losses, CAST(coalesce(count_if(outcome = 'neutral'), 0) AS BIGINT) AS neutrals, {_rate("outcome = 'win'", "outcome IN ('win', 'loss')")} AS win_rate_pct, {_rate("outcome = 'neutral'", "done")} AS neutral_rate_pct,
  round(avg(CASE WHEN done THEN r END), 6) AS avg_return_pct, {_rate("first_hit IN ('stop_loss', 'ambiguous')", "done AND lg")} AS stop_rate_pct, {_rate("first_hit = 'take_profit'", "done AND lg")} AS target_rate_pct, {_rate("first_hit = 'ambiguous'", "done AND lg")} AS ambiguous_rate_pct,
  round(avg(CASE WHEN first_hit <> 'neither' THEN hit_days END), 6) AS avg_hit_days"""
_TR = "tr AS (SELECT o_custkey AS account, l_partkey % 3 AS symbol, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS id, CAST(o_orderdate AS DATE) AS date, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_FX = "ob AS (SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS code, CAST(o_orderdate AS DATE) AS date, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey), fx AS (SELECT code, CAST(date_trunc('month', date) AS DATE) AS date, count(*) / 10 AS rate FROM ob WHERE code % 3 <> 0 GROUP BY 1, 2)"

ORACLES = {
    "b1_b2_evaluations": _EV + " SELECT id, code, status, round(end_close, 6) AS end_close, round(max_high, 6) AS max_high, round(min_low, 6) AS min_low, round(r, 6) AS return_pct, first_hit, CAST(hit_days AS BIGINT) AS hit_days, outcome FROM ev",
    "a1_a4_backtest_summaries": _EV + f" SELECT code, {_SUM} FROM ev GROUP BY ROLLUP (code)",
    "a6_breakdowns": _EV + " " + " UNION ALL ".join(f"SELECT '{x}' AS dimension, coalesce({x}, 'unknown') AS value, CAST(count(*) AS BIGINT) AS total, CAST(coalesce(count_if(done), 0) AS BIGINT) AS completed, CAST(coalesce(count_if(outcome = 'win'), 0) AS BIGINT) AS wins, CAST(coalesce(count_if(outcome = 'loss'), 0) AS BIGINT) AS losses, {_rate(chr(111) + 'utcome = ' + repr('win'), 'outcome IN (' + repr('win') + ', ' + repr('loss') + ')')} AS win_rate_pct, round(avg(CASE WHEN done THEN r END), 6) AS avg_return_pct FROM ev GROUP BY {x}" for x in ("action", "status", "first_hit")),
    "a9_skill_weights": _EV + """, s AS (SELECT action AS skill, code % 3 AS h, CASE WHEN NOT done THEN 'u' WHEN outcome = 'neutral' THEN 'o' ELSE 'e' END AS st, outcome = 'win' AS hit FROM ev),
      b AS (SELECT skill, h, count(*) FILTER (st = 'e') AS e, count(*) FILTER (st = 'e' AND hit) AS k, count(*) FILTER (st = 'u') AS u, count(*) AS n FROM s GROUP BY 1, 2),
      p AS (SELECT *, CASE WHEN e >= 30 THEN e / (e + 30) END AS w, greatest(-1, least(1, 2 * ((k + 15) / (e + 30)) - 1 - 0.25::DOUBLE * u / n)) AS sc FROM b)
      SELECT skill, CAST(sum(e) AS BIGINT) AS evaluated, round(CASE WHEN sum(w) IS NULL THEN 1 ELSE least(1.2::DOUBLE, greatest(1 / 1.2::DOUBLE, exp(ln(1.2::DOUBLE) * sum(w * sc) / sum(w)))) END, 6) AS weight FROM p GROUP BY 1""",
    "a15_market_breadth": f"""WITH {tables.BARS_SQL}, b AS (SELECT code, date, amount, ['600', '688', '300', '830', '900'][code % 5 + 1] AS board, floor(close / 10) / 100 AS x, lag(floor(close / 10) / 100) OVER (PARTITION BY code ORDER BY date) AS p, code + date_diff('day', DATE '1970-01-01', date) AS k FROM bars),
      q AS (SELECT date, CASE WHEN k % 3 = 0 THEN floor(p * CASE WHEN code % 2 = 0 THEN 1.1::DOUBLE ELSE 0.8::DOUBLE END * 100 + 0.5::DOUBLE) / 100 ELSE x END AS x, p, CASE WHEN k % 11 = 0 THEN 0 ELSE amount END AS amount, CASE board WHEN '830' THEN 0.3::DOUBLE WHEN '688' THEN 0.2::DOUBLE WHEN '300' THEN 0.2::DOUBLE ELSE CASE WHEN code % 4 = 0 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END END AS r FROM b),
      l AS (SELECT *, x IS NOT NULL AND p IS NOT NULL AND amount <> 0 AND x > 0 AS live, floor(p * (1 + r) * 100 + 0.5::DOUBLE) / 100 AS lu, floor(p * (1 - r) * 100 + 0.5::DOUBLE) / 100 AS ld FROM q)
      SELECT date, count(*) FILTER (live AND x > p) AS up, count(*) FILTER (live AND x < p) AS down, count(*) FILTER (live AND x = p) AS flat, count(*) FILTER (live AND abs(x - lu) <= round(abs(p * (1 + r) - lu), 10)) AS limit_up, count(*) FILTER (live AND abs(x - ld) <= round(abs(p * (1 - r) - ld), 10)) AS limit_down, round(sum(amount) / 1e8, 6) AS total_amount FROM l GROUP BY 1""",
    "b16_invalidations": f"WITH {tables.ADVICE_SQL}, s AS (SELECT *, CASE WHEN action IN ('buy', 'add') THEN 1 ELSE -1 END AS side FROM advice WHERE action IN ('buy', 'add', 'sell', 'reduce')) SELECT id, side, (SELECT min(o.ts) FROM s o WHERE o.code = s.code AND o.side = -s.side AND (o.ts > s.ts OR o.ts = s.ts AND o.id > s.id)) AS invalidated_at FROM s",
    "j7_as_of": f"WITH {_FX} SELECT o.id, o.code, o.date, round(amount, 6) AS amount, f.date AS asof_date, round(f.rate, 6) AS asof_rate FROM ob o ASOF LEFT JOIN fx f ON o.code = f.code AND o.date >= f.date",
    "j8_strictly_before": f"WITH {_FX} SELECT o.id, o.code, o.date, round(amount, 6) AS amount, round(f.rate, 6) AS asof_rate FROM ob o ASOF LEFT JOIN fx f ON o.code = f.code AND o.date > f.date",
    "j16_convert": f"WITH {_FX}, v AS (SELECT o.code, amount, rate FROM ob o ASOF LEFT JOIN fx f ON o.code = f.code AND o.date >= f.date) SELECT code, round(sum(amount * coalesce(rate, 1)), 2) AS value, CAST(coalesce(count_if(rate IS NULL), 0) AS BIGINT) AS stale FROM v GROUP BY 1",
    "b8_fifo": f"WITH {_TR}, u AS (SELECT *, sum(quantity) OVER (PARTITION BY account, symbol, side ORDER BY date, id ROWS UNBOUNDED PRECEDING) AS upto FROM tr), m AS (SELECT b.account, b.symbol, least(b.upto, s.upto) - greatest(b.upto - b.quantity, s.upto - s.quantity) AS q, s.price - b.price AS gain FROM u b JOIN u s ON b.account = s.account AND b.symbol = s.symbol AND b.side = 'buy' AND s.side = 'sell' AND b.upto - b.quantity < s.upto AND s.upto - s.quantity < b.upto) SELECT account, symbol, count(*) AS matches, round(sum(q), 2) AS quantity, round(sum(q * gain) + 1e-7, 2) AS profit FROM m GROUP BY 1, 2",
    "b9_average_cost": f"""WITH RECURSIVE {_TR}, ev AS (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY date, id) AS n FROM tr), rec AS (SELECT account, symbol, 0::BIGINT AS n, 0::DOUBLE AS q, 0::DOUBLE AS cost, 0::DOUBLE AS profit, 0::DOUBLE AS over FROM ev GROUP BY 1, 2
      UNION ALL SELECT r.account, r.symbol, e.n, CASE WHEN side = 'buy' THEN q + quantity WHEN q - quantity <= 1e-9 THEN 0 ELSE q - quantity END, CASE WHEN side = 'buy' THEN cost + quantity * price WHEN q - quantity <= 1e-9 THEN 0 ELSE cost - quantity * (cost / q) END,
        profit + CASE WHEN side = 'sell' AND q > 1e-9 THEN least(q, quantity) * (price - cost / q) ELSE 0 END, over + CASE WHEN side = 'sell' THEN quantity - least(q, quantity) ELSE 0 END FROM rec r JOIN ev e ON r.account = e.account AND r.symbol = e.symbol AND e.n = r.n + 1)
      SELECT account, symbol, round(q, 4) AS quantity, round(cost + 1e-7, 4) AS cost, round(profit + 1e-7, 4) AS profit, round(over, 4) AS oversold FROM rec WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY account, symbol ORDER BY n DESC) = 1""",
    "b11_positions": f"WITH {_TR} SELECT account, symbol, round(sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END), 4) AS quantity, round(sum(CASE WHEN side = 'buy' THEN -1 ELSE 1 END * quantity * price), 4) AS cash FROM tr GROUP BY 1, 2",
    "a16_concentration": f"WITH {_TR}, p AS (SELECT account, sum(quantity * price) AS exposure FROM tr GROUP BY 1), q AS (SELECT account, exposure, exposure / sum(exposure) OVER () * 100 AS w FROM p) SELECT account, round(exposure, 4) AS exposure, round(w, 4) AS weight_pct, w >= 0.1 AS alert FROM q ORDER BY w DESC, account LIMIT 10",
    "a17_drawdown": "WITH e AS (SELECT user_id % 5 AS book, CAST(ts AS DATE) AS date, sum(value) AS equity FROM events GROUP BY 1, 2), p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS peak FROM e) SELECT book, date, round(equity, 4) AS equity, round(peak, 4) AS peak, round(CASE WHEN peak > 0 THEN (peak - equity) / peak * 100 ELSE 0 END, 4) AS drawdown_pct FROM p",
    "d6_trade_hash": "SELECT o_orderkey, sha256(concat_ws('|', coalesce(CAST(o_custkey AS VARCHAR), ''), coalesce(o_orderstatus, ''), coalesce(o_orderpriority, ''))) AS hash FROM orders",
    "a15_a24_breadth": f"""WITH {tables.BARS_SQL}, b AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS p FROM bars), s AS (SELECT *, close / p - 1 AS ch, close >= floor(p * (1 + 0.1::DOUBLE) * 100 + 0.5::DOUBLE) / 100 - 0.005::DOUBLE AS lu, close <= floor(p * (1 - 0.1::DOUBLE) * 100 + 0.5::DOUBLE) / 100 + 0.005::DOUBLE AS ld, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS n FROM b)
      SELECT date, CAST(coalesce(count_if(ch > 0), 0) AS BIGINT) AS up, CAST(coalesce(count_if(ch < 0), 0) AS BIGINT) AS down, CAST(coalesce(count_if(ch = 0), 0) AS BIGINT) AS flat, CAST(coalesce(count_if(lu), 0) AS BIGINT) AS limit_up, CAST(coalesce(count_if(ld AND NOT lu), 0) AS BIGINT) AS limit_down, round(median(ch), 6) AS median_change, round(sum(CASE WHEN n <= 20 THEN amount END) / sum(amount), 6) AS top20_share FROM s GROUP BY 1""",
    "w39_streaks": f"WITH {tables.BARS_SQL}, i AS (SELECT *, sum(CASE WHEN close > open THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM bars) SELECT code, date, CAST(sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER (PARTITION BY code, g ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i",
    "w40_robust_scores": f"WITH {tables.WEEKLY_SQL}, p AS (SELECT code, date, close, list(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS x FROM bars), m AS (SELECT *, CASE WHEN len(x) >= 60 THEN list_median(x) END AS md FROM p), n AS (SELECT *, CASE WHEN md IS NOT NULL THEN list_median([abs(v - md) FOR v IN x]) END AS mad FROM m) SELECT code, date, round(CASE WHEN md IS NOT NULL THEN 50 + least(3, greatest(-3, (close - md) / (1.4826 * mad + 1e-12))) * 100 / 6 END, 4) AS score FROM n",
    "j11_in_force": "WITH o AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status FROM orders), f AS (SELECT k, day, max(status) AS st FROM o GROUP BY 1, 2) SELECT o.k, count(*) AS n, CAST(coalesce(count_if(status = st), 0) AS BIGINT) AS same FROM o JOIN f ON o.k = f.k AND o.day = f.day GROUP BY 1",
    "j14_changes": "WITH x AS (SELECT o_orderkey % 10 AS m FROM orders) SELECT CASE m WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'revised' END AS change, count(*) AS n FROM x WHERE m IN (1, 2, 3) GROUP BY 1",
    "s20_known_at": "SELECT o_custkey AS k, o_orderkey AS revision, o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, o_orderdate DESC) = 1",
    "m8_overlaps": "WITH s AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 60 AS t FROM orders), n AS (SELECT *, lead(f) OVER (PARTITION BY k ORDER BY f) AS nf FROM s) SELECT k, count(*) AS n FROM n WHERE nf < t GROUP BY 1",
    "p15_month_gaps": "WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), s AS (SELECT o_custkey, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m GROUP BY 1) SELECT o_custkey, CAST(month AS DATE) AS month FROM s EXCEPT SELECT o_custkey, month FROM m",
    "a10_usage_totals": "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(max(value), 4) AS most FROM events GROUP BY ROLLUP (event_type)",
    "a11_sessions": "SELECT conv_id, count(*) AS turns, min(turn) AS first, max(turn) AS last, arg_min(text, turn) FILTER (role = 'user') AS title FROM conversations GROUP BY 1",
    "a12_latest_row": "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "a23_volume_price_correlation": f"WITH {tables.WEEKLY_SQL} SELECT code, round(corr(close, volume), 6) AS corr, round(avg(CASE WHEN close > open THEN volume END), 6) AS up_volume FROM bars GROUP BY 1",
    "a29_sector_returns": f"WITH {tables.SNAPSHOT_SQL}, a AS (SELECT industry, avg(change_pct) AS ch, count(*) AS n FROM snap GROUP BY 1) SELECT industry, round(ch, 6) AS change, n, CAST(rank() OVER (ORDER BY ch DESC) AS INTEGER) AS rank FROM a",
    "s16_upsert": "WITH o AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq, o_totalprice AS close, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS cid FROM orders) SELECT code, date, arg_max(close, seq) AS close, arg_max(cid, seq) FILTER (cid IS NOT NULL) AS canonical_id FROM o GROUP BY 1, 2",
    "r10_keyset_page": "SELECT event_id, ts FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-15', 5000) ORDER BY ts DESC, event_id DESC LIMIT 50",
    "j5_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "j6_semi_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "d1_last_duplicate": "SELECT string_split(url, '/')[3] AS host, max(page_id) AS page_id, count(*) AS pages FROM pages GROUP BY 1",
}
