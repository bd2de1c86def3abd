"""Queries of ledgers and price adjustment, each with its SQL twin: plain folds by recursion, event by event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.operators import adjustment as adj
from quantloom.operators import ledger as lg
from quantloom.sources import tables

c = F.col
t = tables.table
AS_OF = "1997-06-30"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").join(t(s, d, "orders"), c("l_orderkey") == c("o_orderkey"))


def _symbol(number: str) -> list:
    """One of three symbols, each with a currency of its own."""
    return [F.format_string("S%d", c(number) % 3).alias("symbol"), F.lit("us").alias("market"), F.element_at(F.array(F.lit("USD"), F.lit("CNY"), F.lit("HKD")), (c(number) % 3 + 1).cast("int")).alias("currency")]


def trades(s: SparkSession, d: str) -> DataFrame:
    """Lines as trades of their customer: returned ones are sales, of a fifth of the quantity. The line's full
    contents order equal days."""
    rows = _lines(s, d).withColumn("line", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    sold = c("l_returnflag") == "R"
    id_ = F.row_number().over(lg.Window.partitionBy("o_custkey").orderBy("o_orderdate", "line"))
    return rows.select(c("o_custkey").alias("account"), id_.cast("long").alias("id"), F.to_date("o_orderdate").alias("date"), *_symbol("l_partkey"), F.when(sold, "sell").otherwise("buy").alias("side"), F.when(sold, c("l_quantity") / 5).otherwise(c("l_quantity")).alias("quantity"), (c("l_extendedprice") / c("l_quantity")).alias("price"), (c("l_discount") * 10).alias("fee"), (c("l_tax") * 10).alias("tax"))


def actions(s: SparkSession, d: str) -> DataFrame:
    """Every fifth order splits a symbol of its customer or pays a dividend on it."""
    k = c("o_orderkey")
    rows = t(s, d, "orders").where(k % 5 == 0)
    return rows.select(c("o_custkey").alias("account"), k.alias("id"), F.to_date("o_orderdate").alias("date"), *_symbol("o_orderkey"), F.when(k % 2 == 0, "split_adjustment").otherwise("cash_dividend").alias("action"), F.element_at(F.array(F.lit(2.0), F.lit(0.5), F.lit(1.0)), (k % 7 % 3 + 1).cast("int")).alias("ratio"), (k % 11 / 100).alias("per_share"))


def cash(s: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    return t(s, d, "orders").where(k % 3 == 0).select(c("o_custkey").alias("account"), k.alias("id"), F.to_date("o_orderdate").alias("date"), F.lit("USD").alias("currency"), F.when(c("o_orderstatus") == "F", "out").otherwise("in").alias("direction"), c("o_totalprice").alias("amount"))


def prices(s: SparkSession, d: str) -> DataFrame:
    """A symbol's close on a day: the highest price of its lines shipped then."""
    rows = t(s, d, "lineitem").select(*_symbol("l_partkey"), F.to_date("l_shipdate").alias("date"), (c("l_extendedprice") / c("l_quantity")).alias("price"))
    return rows.groupBy("symbol", "date").agg(F.max("price").alias("close"))


def rates(s: SparkSession, d: str) -> DataFrame:
    """Monthly rates of USD to CNY and of CNY to HKD, so that one is direct and one is inverse."""
    months = t(s, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.count("*").alias("n"))
    pair = lambda a, b, x, stale: months.select(F.lit(a).alias("source"), F.lit(b).alias("target"), "date", x.alias("rate"), stale.alias("stale"))
    return pair("USD", "CNY", 6 + c("n") % 10 / 10, c("n") % 2 == 0).unionByName(pair("CNY", "HKD", 1 + c("n") % 5 / 10, F.lit(False)))


def accounts(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "customer").select(c("c_custkey").alias("account"), F.lit("CNY").alias("base"))


def _day() -> F.Column:
    return F.lit(AS_OF).cast("date")


def _sound(df: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of accounts without a problem."""
    return df.join(status.where("status = 'ok'").select("account"), "account", "left_semi")


def _cents(df: DataFrame, *columns: str) -> DataFrame:
    """Columns with amounts in cents, of a ten-millionth more: exact halves then round alike in both engines."""
    kinds = dict(df.dtypes)
    return rounded(df.select(*[(c(x) + 1e-7).alias(x) if kinds[x] == "double" else c(x) for x in columns]), 2)


def _replayed(s: SparkSession, d: str, method: str, as_of=None):
    return lg.replay(trades(s, d), actions(s, d), cash(s, d), method, as_of)


def positions(method: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        found, _, _, status = _replayed(s, d, method)
        return rounded(_sound(found, status).select("account", "symbol", "quantity", "total_cost"), 4)

    return query


def realized(method: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        _, sales, _, status = _replayed(s, d, method)
        out = _sound(sales, status).groupBy("account", "symbol").agg(F.count("*").alias("sales"), (F.sum("realized") + 1e-7).alias("realized"))
        return rounded(out, 2)  # a ten-millionth more, so that halves round alike

    return query


def b7_status_and_cash(s: SparkSession, d: str) -> DataFrame:
    _, _, money, status = _replayed(s, d, "fifo")
    sums = _sound(money, status).groupBy("account").agg(F.sum(F.when(c("currency") == "USD", c("balance"))).alias("usd"), F.sum(F.when(c("currency") == "CNY", c("balance"))).alias("cny"), F.sum(F.when(c("currency") == "HKD", c("balance"))).alias("hkd"))
    return rounded(status.join(sums, "account", "left"), 3)


def b10_b11_account_totals(s: SparkSession, d: str) -> DataFrame:
    upto = lambda df: df.where(c("date") <= _day())
    found, sales, money, status = _replayed(s, d, "average", _day())
    fx = upto(rates(s, d))
    valued = lg.valued(_sound(found, status), accounts(s, d), upto(prices(s, d)), fx)
    out = lg.account_totals(_sound(accounts(s, d), status), valued, _sound(sales, status), _sound(money, status), _sound(upto(trades(s, d)), status), fx)
    return _cents(out, "account", "cash", "market_value", "equity", "realized", "unrealized", "fees", "taxes", "fx_stale")


def b12_available_quantity(s: SparkSession, d: str) -> DataFrame:
    out = lg.available_quantity(trades(s, d), actions(s, d), _day())
    return rounded(out.select("account", "symbol", F.when(c("problem").isNull(), c("quantity")).alias("quantity"), "problem"), 4)


def b13_backfilled_equity(s: SparkSession, d: str) -> DataFrame:
    """Equity in USD on each of the last 20 days up to the day that has no snapshot: every third has one."""
    activity = trades(s, d).select("account", "date").unionByName(actions(s, d).select("account", "date")).unionByName(cash(s, d).select("account", "date"))
    every = lg.missing_days(activity, activity.limit(0), _day(), 20)
    days = lg.missing_days(activity, every.where(F.pmod(F.unix_date("date") + c("account"), F.lit(3)) == 0), _day(), 20)
    out = lg.daily_equity(days, trades(s, d), actions(s, d), cash(s, d), prices(s, d))
    # An account that oversells has no equity to speak of, and neither has a day before a currency's first entry.
    status = lg.available_quantity(trades(s, d), actions(s, d), F.lit("9999-01-01").cast("date")).groupBy("account").agg(F.coalesce(F.max("problem"), F.lit("ok")).alias("status"))
    return _cents(_sound(out.where("currency = 'USD'"), status), "account", "date", "cash", "market_value", "equity")


def _adjustment_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts with yearly closes at hand: an order line's day is a session, and some sessions are ex-days."""
    p = t(s, d, "lineitem").select((c("l_suppkey") % 50).alias("entity"), F.to_date("l_shipdate").alias("date"), F.round(c("l_extendedprice") / c("l_quantity"), 2).cast("decimal(20,6)").alias("close"))
    closes = p.groupBy("entity", "date").agg(F.max("close").alias("close"))
    k = c("entity") + F.unix_date("date")
    ex = closes.where(k % 97 == 0).withColumn("k", k)
    split = c("k") % 3 == 0
    base = [c("entity"), c("date").alias("ex_date"), F.concat_ws("-", "entity", "date").alias("event_key")]
    cash_leg = ex.where(~split).select(*base, F.lit("plan").alias("group_id"), F.lit("cash").alias("role"), F.lit(1).alias("revision"), F.lit("ACTIVE").alias("state"), F.lit("DIVIDEND").alias("action"), ((c("k") % 13 + 1) / 4).cast("decimal(20,6)").alias("quantity"), F.lit(1).cast("decimal(20,6)").alias("denominator"))
    bonus = ex.where(~split & (c("k") % 2 == 0)).select(c("entity"), c("date").alias("ex_date"), F.concat_ws("-", "entity", "date", F.lit("b")).alias("event_key"), F.lit("plan").alias("group_id"), F.lit("bonus").alias("role"), F.lit(1).alias("revision"), F.lit("ACTIVE").alias("state"), F.lit("BONUS").alias("action"), (c("k") % 5 + 1).cast("decimal(20,6)").alias("quantity"), F.lit(10).cast("decimal(20,6)").alias("denominator"))
    splits = ex.where(split).select(*base, F.lit("plan").alias("group_id"), F.lit("split").alias("role"), F.lit(1).alias("revision"), F.lit("ACTIVE").alias("state"), F.lit("SPLIT").alias("action"), (c("k") % 4 + 2).cast("decimal(20,6)").alias("quantity"), F.lit(1).cast("decimal(20,6)").alias("denominator"))
    first = cash_leg.unionByName(bonus).unionByName(splits)
    # Of every seventh event a later revision cancels it, of every other seventh one doubles it.
    turn = F.unix_date("ex_date") % 7
    later = first.where(turn < 2).withColumns({"revision": F.lit(2), "state": F.when(turn == 0, "CANCELLED").otherwise("ACTIVE"), "quantity": F.when(turn == 1, c("quantity") * 2).cast("decimal(20,6)")})
    return closes, first.unionByName(later)


def b14_adjustment_factors(s: SparkSession, d: str) -> DataFrame:
    closes, events = _adjustment_inputs(s, d)
    out = adj.adjustment_factors(closes, events)
    return out.select("entity", "date", F.round("forward", 9).cast("double").alias("forward"), F.round("backward", 6).cast("double").alias("backward"), "problem")


QUERIES = {
    "b7_fifo_positions": positions("fifo"),
    "b7_average_positions": positions("average"),
    "b7_fifo_realized": realized("fifo"),
    "b7_average_realized": realized("average"),
    "b7_status_and_cash": b7_status_and_cash,
    "b10_b11_account_totals": b10_b11_account_totals,
    "b12_available_quantity": b12_available_quantity,
    "b13_backfilled_equity": b13_backfilled_equity,
    "b14_adjustment_factors": b14_adjustment_factors,
}

_CURRENCY = "['USD', 'CNY', 'HKD'][{0} % 3 + 1]"


def _events(until: str = "") -> str:
    """Trades and actions of each position numbered in the order of replay."""
    return f"""tr AS (SELECT o_custkey AS account, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, CAST(o_orderdate AS DATE) AS date, 'S' || l_partkey % 3 AS symbol, {_CURRENCY.format('l_partkey')} AS currency,
  CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS kind, CASE WHEN l_returnflag = 'R' THEN l_quantity / 5 ELSE l_quantity END AS q, l_extendedprice / l_quantity AS price, l_discount * 10 AS fee, l_tax * 10 AS tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ac AS (SELECT o_custkey AS account, o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, 'S' || o_orderkey % 3 AS symbol, {_CURRENCY.format('o_orderkey')} AS currency, CASE WHEN o_orderkey % 2 = 0 THEN 'split' ELSE 'dividend' END AS kind, CAST([2, 0.5, 1][o_orderkey % 7 % 3 + 1] AS DOUBLE) AS ratio, o_orderkey % 11 / 100 AS ps FROM orders WHERE o_orderkey % 5 = 0),
ca AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders WHERE o_orderkey % 3 = 0),
un AS (SELECT account, symbol, currency, date, 2 AS pr, id, kind, q, q * price AS gross, fee + tax AS cost, 1::DOUBLE AS ratio, 0::DOUBLE AS ps FROM tr UNION ALL SELECT account, symbol, currency, date, 1, id, kind, 0, 0, 0, ratio, ps FROM ac),
ev AS (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY date, pr, id) AS n FROM un {until})"""


_TAKEN = "greatest(0::DOUBLE, least(lots[i].q, e.q - coalesce(list_sum([x.q FOR x IN lots[1:i - 1]]), 0)))"
#: First in first out, lot by lot; a sale of more than there is ends in `bad`.
_FIFO = f""", rec AS (SELECT account, symbol, 0::BIGINT AS n, CAST([] AS STRUCT(q DOUBLE, u DOUBLE)[]) AS lots, 0::DOUBLE AS realized, 0::BIGINT AS sales, 0::DOUBLE AS before, false AS bad FROM ev GROUP BY 1, 2
 UNION ALL SELECT r.account, r.symbol, e.n, CASE e.kind WHEN 'buy' THEN list_append(lots, {{'q': e.q, 'u': (e.gross + e.cost) / e.q}}) WHEN 'split' THEN [{{'q': x.q * e.ratio, 'u': x.u / e.ratio}} FOR x IN lots]
   WHEN 'sell' THEN [x FOR x IN [{{'q': lots[i].q - {_TAKEN}, 'u': lots[i].u}} FOR i IN range(1, len(lots) + 1)] IF x.q > 1e-8] ELSE lots END,
   realized + CASE WHEN e.kind = 'sell' THEN e.gross - e.cost - coalesce(list_sum([{_TAKEN} * lots[i].u FOR i IN range(1, len(lots) + 1)]), 0) ELSE 0 END, r.sales + CASE WHEN e.kind = 'sell' THEN 1 ELSE 0 END,
   coalesce(list_sum([x.q FOR x IN lots]), 0), bad OR (e.kind = 'sell' AND coalesce(list_sum([x.q FOR x IN lots]), 0) + 1e-8 < e.q)
 FROM rec r JOIN ev e ON r.account = e.account AND r.symbol = e.symbol AND e.n = r.n + 1)"""
#: Average cost: quantity and cost of the position.
_AVERAGE = """, rec AS (SELECT account, symbol, 0::BIGINT AS n, 0::DOUBLE AS held, 0::DOUBLE AS cost, 0::DOUBLE AS realized, 0::BIGINT AS sales, 0::DOUBLE AS before, false AS bad, 0::DOUBLE AS gain FROM ev GROUP BY 1, 2
 UNION ALL SELECT r.account, r.symbol, e.n, CASE e.kind WHEN 'buy' THEN held + e.q WHEN 'split' THEN held * e.ratio WHEN 'sell' THEN CASE WHEN held - e.q <= 1e-8 THEN 0 ELSE held - e.q END ELSE held END,
   CASE e.kind WHEN 'buy' THEN r.cost + e.gross + e.cost WHEN 'sell' THEN CASE WHEN held - e.q <= 1e-8 THEN 0 ELSE r.cost - r.cost / held * e.q END ELSE r.cost END,
   realized + CASE WHEN e.kind = 'sell' AND held > 0 THEN e.gross - e.cost - r.cost / held * e.q ELSE 0 END, r.sales + CASE WHEN e.kind = 'sell' THEN 1 ELSE 0 END, held, bad OR (e.kind = 'sell' AND held + 1e-8 < e.q),
   CASE WHEN e.kind = 'sell' AND held > 0 THEN e.gross - e.cost - r.cost / held * e.q ELSE 0 END
 FROM rec r JOIN ev e ON r.account = e.account AND r.symbol = e.symbol AND e.n = r.n + 1)"""
_END = ", fin AS (SELECT * FROM rec WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY account, symbol ORDER BY n DESC) = 1), wrong AS (SELECT DISTINCT account FROM rec WHERE bad)"
_OK = "account NOT IN (SELECT account FROM wrong)"
_FLOW = "CASE e.kind WHEN 'buy' THEN -(e.gross + e.cost) WHEN 'sell' THEN e.gross - e.cost WHEN 'dividend' THEN r.before * e.ps ELSE 0 END"
_UNTIL = f"WHERE date <= DATE '{AS_OF}'"
_FX = f"""mon AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1), px AS (SELECT 'S' || l_partkey % 3 AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2),
fx AS (SELECT 'USD' AS currency, date, 6 + n % 10 / 10 AS rate, n % 2 = 0 AS stale FROM mon WHERE date <= DATE '{AS_OF}' UNION ALL SELECT 'HKD', date, 1 / (1 + n % 5 / 10), false FROM mon WHERE date <= DATE '{AS_OF}' UNION ALL SELECT 'CNY', DATE '1900-01-01', 1, false),
lastfx AS (SELECT currency, arg_max(rate, date) AS rate, arg_max(stale, date) AS stale FROM fx GROUP BY 1)"""
_TOTALS = f"""WITH RECURSIVE {_events(_UNTIL)}{_AVERAGE}{_END}, {_FX}, who AS (SELECT DISTINCT account FROM (SELECT account FROM ev UNION ALL SELECT account FROM ca {_UNTIL}) WHERE {_OK}),
mv AS (SELECT f.account, sum(held * p.close * x.rate) AS mv, sum(f.cost * x.rate) AS cost, bool_or(x.stale) AS stale FROM fin f JOIN (SELECT DISTINCT symbol, currency FROM ev) k USING (symbol) JOIN (SELECT symbol, arg_max(close, date) AS close FROM px {_UNTIL} GROUP BY 1) p USING (symbol) JOIN lastfx x USING (currency) WHERE held > 1e-8 GROUP BY 1),
bal AS (SELECT account, currency, sum(amount) AS amount FROM (SELECT account, 'USD' AS currency, amount FROM ca {_UNTIL} UNION ALL SELECT e.account, e.currency, {_FLOW} FROM rec r JOIN ev e ON r.account = e.account AND r.symbol = e.symbol AND r.n = e.n) GROUP BY 1, 2),
ch AS (SELECT account, sum(CASE WHEN abs(amount) > 1e-8 THEN amount * rate ELSE 0 END) AS cash, bool_or(stale AND abs(amount) > 1e-8) AS stale FROM bal JOIN lastfx USING (currency) GROUP BY 1),
day AS (SELECT e.account, e.currency, e.date, r.gain, tr.fee, tr.tax, e.kind FROM rec r JOIN ev e ON r.account = e.account AND r.symbol = e.symbol AND r.n = e.n JOIN tr ON tr.account = e.account AND tr.id = e.id AND e.pr = 2),
dx AS (SELECT d.*, coalesce(f.rate, 1) AS rate, coalesce(f.stale, d.currency <> 'CNY') AS stale FROM day d ASOF LEFT JOIN fx f ON d.currency = f.currency AND d.date >= f.date),
gn AS (SELECT account, sum(CASE WHEN kind = 'sell' THEN gain * rate ELSE 0 END) AS realized, sum(fee * rate) AS fees, sum(tax * rate) AS taxes, bool_or(stale AND (kind = 'sell' AND abs(gain) > 1e-8 OR greatest(fee, tax) > 1e-8)) AS stale FROM dx GROUP BY 1)
SELECT account, round(coalesce(cash, 0) + 1e-7, 2) AS cash, round(coalesce(mv, 0) + 1e-7, 2) AS market_value, round(coalesce(cash, 0) + coalesce(mv, 0) + 1e-7, 2) AS equity, round(coalesce(realized, 0) + 1e-7, 2) AS realized, round(coalesce(mv, 0) - coalesce(cost, 0) + 1e-7, 2) AS unrealized, round(coalesce(fees, 0) + 1e-7, 2) AS fees, round(coalesce(taxes, 0) + 1e-7, 2) AS taxes, coalesce(ch.stale, false) OR coalesce(mv.stale, false) OR coalesce(gn.stale, false) AS fx_stale
FROM who LEFT JOIN ch USING (account) LEFT JOIN mv USING (account) LEFT JOIN gn USING (account)"""
_EQUITY = f"""WITH RECURSIVE {_events()}{_FIFO}{_END}, {_FX}, act AS (SELECT account, min(date) AS first FROM (SELECT account, date FROM tr UNION ALL SELECT account, date FROM ac UNION ALL SELECT account, date FROM ca) WHERE date <= DATE '{AS_OF}' AND {_OK} GROUP BY 1),
days AS (SELECT * FROM (SELECT account, CAST(unnest(generate_series(greatest(first, DATE '{AS_OF}' - 20), DATE '{AS_OF}', INTERVAL 1 DAY)) AS DATE) AS date FROM act) WHERE (date_diff('day', DATE '1970-01-01', date) + account) % 3 <> 0),
steps AS (SELECT e.account, e.symbol, e.currency, e.date, e.n, coalesce(list_sum([x.q FOR x IN r.lots]), 0) AS held, {_FLOW} AS amount FROM rec r JOIN ev e ON r.account = e.account AND r.symbol = e.symbol AND r.n = e.n),
fl AS (SELECT account, date, amount FROM ca UNION ALL SELECT account, date, amount FROM steps WHERE currency = 'USD'),
ch AS (SELECT d.account, d.date, sum(amount) AS cash FROM days d JOIN fl f ON f.account = d.account AND f.date <= d.date GROUP BY 1, 2),
eod AS (SELECT account, symbol, date, arg_max(held, n) AS held FROM steps WHERE currency = 'USD' GROUP BY 1, 2, 3), s0 AS (SELECT DISTINCT account, symbol FROM eod),
hd AS (SELECT d.account, d.date, d.symbol, h.held FROM (SELECT * FROM days JOIN s0 USING (account)) d ASOF LEFT JOIN eod h ON d.account = h.account AND d.symbol = h.symbol AND d.date >= h.date),
mv AS (SELECT h.account, h.date, sum(held * close) AS mv FROM hd h ASOF LEFT JOIN px ON h.symbol = px.symbol AND h.date >= px.date WHERE held > 1e-8 GROUP BY 1, 2), known AS (SELECT DISTINCT account FROM fl)
SELECT account, date, round(coalesce(cash, 0) + 1e-7, 2) AS cash, round(coalesce(mv, 0) + 1e-7, 2) AS market_value, round(coalesce(cash, 0) + coalesce(mv, 0) + 1e-7, 2) AS equity FROM days JOIN known USING (account) LEFT JOIN ch USING (account, date) LEFT JOIN mv USING (account, date)"""
_FACTORS = """WITH cl AS (SELECT l_suppkey % 50 AS entity, CAST(l_shipdate AS DATE) AS date, max(round(l_extendedprice / l_quantity, 2)) AS close FROM lineitem GROUP BY 1, 2), pv AS (SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY date) AS prev, entity + date_diff('day', DATE '1970-01-01', date) AS k, date_diff('day', DATE '1970-01-01', date) % 7 AS turn FROM cl),
ex AS (SELECT *, CASE WHEN turn = 1 THEN 2 ELSE 1 END AS times FROM pv WHERE k % 97 = 0 AND turn <> 0 AND prev IS NOT NULL),
q AS (SELECT entity, date, CASE WHEN k % 3 = 0 THEN 1 / ((k % 4 + 2) * times) ELSE (prev - (k % 13 + 1) / 4 * times) / (1 + CASE WHEN k % 2 = 0 THEN (k % 5 + 1) / 10 * times ELSE 0 END) / prev END AS q FROM ex),
bad AS (SELECT entity, min(problem) AS problem FROM (SELECT entity, 'reference_not_positive' AS problem FROM q WHERE q <= 0 UNION ALL SELECT entity, 'no_session_before' FROM pv WHERE k % 97 = 0 AND turn <> 0 AND prev IS NULL) GROUP BY 1),
f AS (SELECT c.entity, c.date, coalesce(product(q.q) FILTER (q.date > c.date), 1) AS forward, coalesce(product(1 / q.q) FILTER (q.date <= c.date), 1) AS backward FROM cl c LEFT JOIN q ON q.entity = c.entity AND q.q > 0 GROUP BY 1, 2)
SELECT entity, date, CASE WHEN problem IS NULL THEN round(forward, 9) END AS forward, CASE WHEN problem IS NULL THEN round(backward, 6) END AS backward, problem FROM f LEFT JOIN bad USING (entity)"""

_POSITIONS = "SELECT account, symbol, round({q}, 4) AS quantity, round({cost}, 4) AS total_cost FROM fin WHERE {ok} AND {q} > 1e-8"
_REALIZED = f"SELECT account, symbol, sales, round(realized + 1e-7, 2) AS realized FROM fin WHERE sales > 0 AND {_OK}"
_HELD = "coalesce(list_sum([x.q FOR x IN lots]), 0)"
ORACLES = {
    "b7_fifo_positions": f"WITH RECURSIVE {_events()}{_FIFO}{_END} " + _POSITIONS.format(q=_HELD, cost="list_sum([x.q * x.u FOR x IN lots])", ok=_OK),
    "b7_average_positions": f"WITH RECURSIVE {_events()}{_AVERAGE}{_END} " + _POSITIONS.format(q="held", cost="cost", ok=_OK),
    "b7_fifo_realized": f"WITH RECURSIVE {_events()}{_FIFO}{_END} {_REALIZED}",
    "b7_average_realized": f"WITH RECURSIVE {_events()}{_AVERAGE}{_END} {_REALIZED}",
    "b7_status_and_cash": f"""WITH RECURSIVE {_events()}{_FIFO}{_END}, f AS (SELECT account, 'USD' AS currency, amount FROM ca UNION ALL SELECT e.account, e.currency, {_FLOW} FROM rec r JOIN ev e ON r.account = e.account AND r.symbol = e.symbol AND r.n = e.n)
      SELECT account, CASE WHEN {_OK} THEN 'ok' ELSE 'oversell' END AS status, {", ".join(f"round(CASE WHEN {_OK} THEN sum(CASE WHEN currency = '{x.upper()}' THEN amount END) END, 3) AS {x}" for x in ("usd", "cny", "hkd"))} FROM f GROUP BY 1""",
    "b10_b11_account_totals": _TOTALS,
    "b12_available_quantity": f"WITH RECURSIVE {_events(_UNTIL)}{_FIFO}{_END} SELECT account, symbol, CASE WHEN NOT bad THEN round({_HELD}, 4) END AS quantity, CASE WHEN bad THEN 'oversell' END AS problem FROM fin",
    "b13_backfilled_equity": _EQUITY,
    "b14_adjustment_factors": _FACTORS,
}
