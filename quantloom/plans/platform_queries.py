"""Queries of mapped provider rows and of the market's state, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.operators import canonical as cn
from quantloom.operators import market_state as ms
from quantloom.operators import sentiment as sm
from quantloom.sources import tables

c = F.col
t = tables.table
LISTED_FROM = "1996-01-01"


def _bars(s: SparkSession, d: str) -> DataFrame:
    """Weekly bars of twenty instruments; limits lie five percent off the close before."""
    rows = t(s, d, "lineitem").select((c("l_suppkey") % 20).alias("entity"), F.date_sub(F.next_day(F.to_date("l_shipdate"), "Mon"), 7).alias("date"), (c("l_extendedprice") / c("l_quantity")).alias("price"), "l_quantity", "l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("at"))
    b = rows.groupBy("entity", "date").agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"))
    before = F.lag("close").over(Window.partitionBy("entity").orderBy("date"))
    halted = F.pmod(_week() + c("entity") * 17, F.lit(331)) == 0
    return b.withColumns({"prev_close": before, "price_limit_up": before * 1.05, "price_limit_down": before * 0.95, "trading_status": F.when(halted, "SUSPENDED").otherwise("TRADED"), "shares": 1000 + c("entity") * 37, "float_shares": 500 + c("entity") * 13 % 17})


def _week():
    return F.floor((F.unix_date("date") - 4) / 7)


def _market(s: SparkSession, d: str) -> dict[str, DataFrame]:
    bars = _bars(s, d)
    since = F.lit(LISTED_FROM).cast("date")
    late = c("entity") == 3
    status = F.when(late & (c("date") < since), "NOT_LISTED").when(c("trading_status") == "SUSPENDED", "SUSPENDED").when((c("entity") % 7 == 0) & (_week() % 5 == 0), "ST").otherwise("ACTIVE")
    names = t(s, d, "supplier").select((c("s_suppkey") % 20).alias("entity")).distinct()
    old = F.lit("1990-01-01").cast("date")
    span = lambda a, b, x: F.struct(a.alias("effective_from"), b.alias("effective_to"), F.lit(x).alias("listing_status"))
    open_end = F.lit(None).cast("date")
    return {
        "calendar": bars.select(c("date").alias("trade_date"), (_week() % 50 != 0).alias("is_open")).distinct(),
        "master": names.select("entity", F.lit("stock").alias("asset_type"), F.lit("SH").alias("exchange"), F.lit("MAIN").alias("board"), F.when(late, since).otherwise(old).alias("list_date"), F.lit(None).cast("date").alias("delist_date")),
        "listing": names.select("entity", F.inline(F.when(late, F.array(span(old, since, "NOT_LISTED"), span(since, open_end, "LISTED"))).otherwise(F.array(span(old, open_end, "LISTED"))))),
        "status": bars.select("entity", "date", status.alias("instrument_status"), (c("trading_status") == "TRADED").alias("is_tradable")),
        "bars": bars,
    }


def _index(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "orders").groupBy(F.date_sub(F.next_day(F.to_date("o_orderdate"), "Mon"), 7).alias("date")).agg(F.avg("o_totalprice").alias("close"))


def m1_universe(s: SparkSession, d: str) -> DataFrame:
    u = ms.freeze_universe(**_market(s, d))
    return u.select("entity", "date", "listed", "valid", "observable", "ruled", F.array_join("reasons", ",").alias("reasons"), "problem")


def m2_raw_metrics(s: SparkSession, d: str) -> DataFrame:
    days = ms.raw_metrics(ms.freeze_universe(**_market(s, d)), _index(s, d))
    return rounded(days.withColumn("flags", F.array_join("flags", ",")).select("date", "flags", *[c(x).cast("double").alias(x) for x in ms.METRICS]))


def m5_market_evaluator(s: SparkSession, d: str) -> DataFrame:
    days = ms.evaluate_market(**_market(s, d), index=_index(s, d))
    return rounded(days.select("date", *[c(x).alias(f"score_{x}") for x in ms.DIMENSIONS], "emotion_raw", "emotion", "regime", "regime_before", "trigger"), 5)


def w42_regimes(s: SparkSession, d: str) -> DataFrame:
    scores = sm.robust_score(tables.weekly_bars(s, d), "close").select("code", "date", "score")
    return rounded(ms.regimes(scores, "score", ["code"]).select("code", "date", "emotion", "regime", "regime_before", "trigger"))


PROVIDER = cn.Mapping(
    "bar_1d_raw",
    (
        cn.Field("entity_key", "symbol", "string", required=True, identity="entity_key"), cn.Field("trade_date", "day", "date", required=True), cn.Field("trading_status", "state", "string", enum={"O": "TRADED", "F": "SUSPENDED"}),
        *[cn.Field(x, x, "number") for x in cn.PRICES], cn.Field("volume_shares", "lots", "integer", unit="100"),
    ),
)


def _mapped(s: SparkSession, d: str) -> DataFrame:
    """Orders as a provider's rows, all of them text, with faults by their key; customers as identities."""
    k, text = c("o_orderkey"), lambda x: x.cast("string")
    rows = t(s, d, "orders").select(
        k.alias("n"), F.concat(F.lit("C"), c("o_custkey") % 50).alias("symbol"), F.when(k % 97 == 0, None).when(k % 89 == 0, "n/a").otherwise(text(F.to_date("o_orderdate"))).alias("day"), c("o_orderstatus").alias("state"),
        text(k % 1000).alias("open"), text(k % 1000 + k % 7 - 1).alias("high"), text(F.greatest(k % 1000 - 3, F.lit(0))).alias("low"), F.when(k % 53 == 0, "abc").when(k % 59 == 0, "-5").otherwise(text(k % 1000)).alias("close"),
        F.when(k % 61 == 0, "1.5").when(k % 67 == 0, "0.001").otherwise(text(k % 90)).alias("lots"))
    number = (c("c_custkey") % 50).alias("i")
    names = t(s, d, "customer").select(number).distinct().where("i % 13 <> 3")
    identities = names.select(F.concat(F.lit("C"), "i").alias("value"), F.when(c("i") % 17 == 5, "AMBIGUOUS").otherwise("RESOLVED").alias("status"), F.concat(F.lit("stock:"), "i").alias("entity_key"), text(c("i")).alias("canonical_id"))
    days = t(s, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct().where(F.dayofmonth("trade_date") != 31)
    calendar = days.select(F.lit("CN").alias("market"), "trade_date", (F.weekday("trade_date") < 5).alias("is_open"))
    return cn.map_rows(rows, PROVIDER, "n", identities, calendar)


def m7_mapped_rows(s: SparkSession, d: str) -> DataFrame:
    out = lambda x: F.when(c("code").isNull(), c(f"out.{x}"))
    return _mapped(s, d).select("ordinal", "code", "field", out("entity_key").alias("entity_key"), out("trade_date").alias("trade_date"), out("trading_status").alias("trading_status"), out("close").cast("double").alias("close"), out("volume_shares").alias("volume_shares"))


def a22_quality_report(s: SparkSession, d: str) -> DataFrame:
    return cn.quality_report(_mapped(s, d), PROVIDER).withColumn("failure_reasons", F.array_join("failure_reasons", ","))


QUERIES = {"m7_mapped_rows": m7_mapped_rows, "a22_quality_report": a22_quality_report, "m1_universe": m1_universe, "m2_raw_metrics": m2_raw_metrics, "m5_market_evaluator": m5_market_evaluator, "w42_regimes": w42_regimes}

_UNIVERSE = f"""l AS (SELECT l_suppkey % 20 AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, * FROM lineitem),
b0 AS (SELECT entity, date, list(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS x, max(price) AS high, min(price) AS low, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, date_diff('day', DATE '1970-01-05', date) // 7 AS k FROM l GROUP BY entity, date),
b AS (SELECT *, x[1] AS open, x[-1] AS close, lag(x[-1]) OVER (PARTITION BY entity ORDER BY date) AS pc, (k + entity * 17) % 331 = 0 AS halted FROM b0), cal AS (SELECT DISTINCT date FROM b WHERE k % 50 <> 0),
g AS (SELECT entity, date, entity <> 3 OR date >= DATE '{LISTED_FROM}' AS listed, entity = 3 AND date = DATE '{LISTED_FROM}' AS fresh FROM (SELECT DISTINCT s_suppkey % 20 AS entity FROM supplier), cal),
u0 AS (SELECT g.*, b.* EXCLUDE (entity, date), b.close IS NOT NULL AS here, coalesce(halted, false) AS susp, entity % 7 = 0 AND k % 5 = 0 AS st, 1.05::DOUBLE * pc AS lu, 0.95::DOUBLE * pc AS ld FROM g LEFT JOIN b USING (entity, date)),
u1 AS (SELECT *, here AND NOT susp AS priced FROM u0), u2 AS (SELECT *, listed AND (priced OR susp) AS valid, listed AND priced AND pc > 0 AS obs FROM u1),
u AS (SELECT *, coalesce(obs, false) AS observable, coalesce(obs AND lu > ld AND ld > 0, false) AS ruled, list_sort(list_filter([CASE WHEN NOT here THEN 'STATUS_UNKNOWN' END, CASE WHEN susp THEN 'SUSPENDED' END, CASE WHEN here AND st AND listed AND NOT susp THEN 'ST' END, CASE WHEN fresh THEN 'NEW_LISTING' END, CASE WHEN listed AND NOT (priced OR susp) THEN 'BAR_UNAVAILABLE' END], lambda v: v IS NOT NULL)) AS reasons FROM u2)"""
_ORD = "OVER (PARTITION BY entity ORDER BY date"
_FULL = lambda n, x: f"CASE WHEN count(level) {_ORD} ROWS {n - 1} PRECEDING) = {n} THEN CAST({x} AS INTEGER) END"
_METRICS = f"""{_UNIVERSE},
m0 AS (SELECT *, ruled AND close >= lu AS up, ruled AND close <= ld AS down, ruled AND high >= lu AND close < lu AS brk, row_number() {_ORD}) AS n, CASE WHEN listed AND priced THEN close END AS level FROM u),
m1 AS (SELECT *, max(CASE WHEN NOT up OR fresh THEN n END) {_ORD} ROWS UNBOUNDED PRECEDING) AS nb, lag(level) {_ORD}) AS back,
  {_FULL(20, f"level > avg(level) {_ORD} ROWS 19 PRECEDING)")} AS o20, {_FULL(60, f"level > avg(level) {_ORD} ROWS 59 PRECEDING)")} AS o60, {_FULL(20, f"level >= max(level) {_ORD} ROWS 19 PRECEDING)")} AS hi, {_FULL(20, f"level <= min(level) {_ORD} ROWS 19 PRECEDING)")} AS lo FROM m0),
m2 AS (SELECT m1.*, CASE WHEN m1.up AND (z.up OR z.listed AND z.ruled) THEN m1.n - m1.nb + CASE WHEN z.up THEN 1 ELSE 0 END END AS streak, CASE WHEN m1.observable AND m1.back > 0 THEN m1.level / m1.back - 1 END AS ret FROM m1 LEFT JOIN m1 z ON z.entity = m1.entity AND z.n = m1.nb),
m3 AS (SELECT *, lag(up) {_ORD}) AS was_up, lag(streak) {_ORD}) AS was_streak, CASE WHEN ret IS NOT NULL THEN volume / (1000 + entity * 37) END AS turn, CASE WHEN ret IS NOT NULL THEN close * (500 + entity * 13 % 17) END AS cap, CASE WHEN valid THEN amount END AS paid FROM m2),
m AS (SELECT *, paid IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY paid DESC NULLS LAST, entity) <= 20 AS top, turn IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY turn DESC NULLS LAST, entity) <= floor(count(turn) OVER (PARTITION BY date) * 0.2::DOUBLE) AS hot,
  cap IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY cap DESC NULLS LAST, entity) <= floor(count(cap) OVER (PARTITION BY date) * 0.3::DOUBLE) AS large, cap IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY cap ASC NULLS LAST, entity) <= floor(count(cap) OVER (PARTITION BY date) * 0.3::DOUBLE) AS small, median(ret) OVER (PARTITION BY date) AS mid FROM m3),
d0 AS (SELECT date, count(*) FILTER (listed) AS listed_count, count(*) FILTER (valid) AS bar_valid_count, count(*) FILTER (ruled) AS limit_rule_count, count(ret) AS valid_return_count, count(*) FILTER (ret > 0) AS advance_count, count(*) FILTER (ret < 0) AS decline_count, count(*) FILTER (ret = 0) AS flat_count,
  count(*) FILTER (up) AS ups, count(*) FILTER (down) AS downs, count(*) FILTER (brk) AS brks, count(*) FILTER (up AND streak IS NULL) AS unk, coalesce(max(streak), 0) AS highest, count(*) FILTER (streak >= 2) AS longs, count(*) FILTER (was_up AND was_streak IS NULL) AS punk, count(*) FILTER (was_streak >= 2 AND ruled) AS cand, count(*) FILTER (was_streak >= 2 AND up) AS prom, bool_or(was_up IS NOT NULL) AS prior,
  median(ret) AS median_return, avg(o20) AS above_ma20_ratio, avg(o60) AS above_ma60_ratio, avg(hi - lo) AS new_high_low_spread_20, avg(CASE WHEN was_up THEN ret END) AS prior_limit_up_premium, median(CASE WHEN hot THEN ret END) - median(ret) AS high_turnover_return_spread,
  avg(CASE WHEN small THEN ret END) - avg(CASE WHEN large THEN ret END) AS small_large_return_spread, median(CASE WHEN top THEN ret END) AS top_amount20_median_return, sum(paid) AS market_amount_cny, sum(CASE WHEN top THEN paid END) AS top_paid, sum(CASE WHEN ret > 0 THEN paid END) AS rising, sum(CASE WHEN ret IS NOT NULL THEN paid END) AS traded,
  count(*) FILTER (listed AND (susp OR coalesce(volume = 0, false))) AS still, count(*) FILTER (listed AND valid AND here) AS told, median(CASE WHEN observable THEN (high - low) / pc END) AS median_amplitude, median(abs(ret - mid)) AS return_dispersion_mad, count(*) FILTER (ret <= -0.05::DOUBLE) AS tails FROM m GROUP BY date),
amt AS (SELECT date, CASE WHEN count(*) OVER w = 20 THEN sum(market_amount_cny) OVER w / 20 END AS mean20 FROM d0 WHERE market_amount_cny IS NOT NULL WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
ix AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS i FROM orders GROUP BY 1), ir AS (SELECT *, i / lag(i) OVER (ORDER BY date) - 1 AS r FROM ix),
iv AS (SELECT date, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w * sqrt(252) END AS benchmark_realized_vol_20, CASE WHEN count(i) OVER w = 20 THEN i / max(i) OVER w - 1 END AS market_drawdown_20 FROM ir WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)),
raw AS (SELECT d0.*, CASE WHEN limit_rule_count > 0 THEN ups END AS limit_up_count, CASE WHEN limit_rule_count > 0 THEN downs END AS limit_down_count, CASE WHEN limit_rule_count > 0 THEN brks END AS limit_break_count, CASE WHEN limit_rule_count > 0 AND (ups = 0 OR unk < ups) THEN longs END AS streak_stock_count, CASE WHEN limit_rule_count > 0 AND unk = 0 THEN highest END AS max_streak_height,
  CASE WHEN valid_return_count > 0 THEN (advance_count - decline_count) / valid_return_count END AS net_advance_ratio, CASE WHEN valid_return_count > 0 THEN ln((advance_count + 1) / (decline_count + 1)) END AS advance_decline_log, CASE WHEN limit_rule_count > 0 THEN (ups - downs) / limit_rule_count END AS limit_up_down_spread, CASE WHEN ups + brks > 0 THEN brks / (ups + brks) END AS limit_break_rate,
  CASE WHEN prior AND punk = 0 AND cand > 0 THEN prom / cand END AS promotion_rate, CASE WHEN mean20 > 0 THEN market_amount_cny / mean20 END AS amount_ratio_20, CASE WHEN traded > 0 THEN coalesce(rising, 0) / traded END AS rising_amount_share, CASE WHEN market_amount_cny > 0 THEN top_paid / market_amount_cny END AS top20_amount_concentration, CASE WHEN told = listed_count AND listed_count > 0 THEN still / listed_count END AS zero_or_suspended_ratio,
  CASE WHEN valid_return_count > 0 THEN tails / valid_return_count END AS tail_loss_ratio, benchmark_realized_vol_20, market_drawdown_20,
  array_to_string(list_filter([CASE WHEN unk > 0 OR punk > 0 THEN 'HISTORY_GAP' END, CASE WHEN listed_count > 0 AND (bar_valid_count < 0.998::DOUBLE * listed_count OR listed_count - bar_valid_count > 0.002::DOUBLE * listed_count OR listed_count - bar_valid_count > 10) THEN 'SCOPE_SLA_FAILED' END], lambda v: v IS NOT NULL), ',') AS flags
  FROM d0 LEFT JOIN amt USING (date) LEFT JOIN iv USING (date))"""


def _score(x: str) -> str:
    sign = "-" if x in ms.NEGATIVE else ""
    return f"""n_{x} AS (SELECT date, CASE WHEN len(p) >= 60 THEN 50 + least(3, greatest(-3, {sign}(v - list_median(p)) / (1.4826::DOUBLE * list_median([abs(y - list_median(p)) FOR y IN p]) + 1e-12::DOUBLE))) * 100 / 6 END AS {x}
      FROM (SELECT date, CAST({x} AS DOUBLE) AS v, list(CAST({x} AS DOUBLE)) OVER (ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS p FROM raw WHERE {x} IS NOT NULL))"""


_ALL = [x for weights in ms.DIMENSIONS.values() for x in weights]
_DIMENSIONS = ", ".join(" + ".join(f"{x} * {k} / 100" for x, k in weights.items()) + f" AS score_{name}" for name, weights in ms.DIMENSIONS.items())
#: A regime's day from the day before: emotion, then its band, then what it does.
_FOLD = """rec AS (SELECT {key}0::BIGINT AS n, NULL::DATE AS date, NULL::DOUBLE AS emotion, NULL::BIGINT AS g, NULL::BIGINT AS rival, NULL::BIGINT AS old, NULL::VARCHAR AS trigger FROM {start}
  UNION ALL SELECT {key}n, date, e, CASE WHEN e IS NULL THEN NULL WHEN g IS NULL OR tr IN ('BOUNDARY_JUMP_GE_5', 'TWO_DAY_CONFIRM') THEN band ELSE g END, CASE WHEN e IS NOT NULL AND band <> g AND tr = 'NONE' THEN band END, CASE WHEN tr IN ('BOUNDARY_JUMP_GE_5', 'TWO_DAY_CONFIRM') THEN g END, tr
  FROM (SELECT *, CASE WHEN e IS NULL THEN NULL WHEN g IS NULL THEN 'INITIALIZED' WHEN band = g THEN 'NONE' WHEN (band > g AND e - 20 * (g + 1) >= 5) OR (band < g AND 20 * g - e >= 5) THEN 'BOUNDARY_JUMP_GE_5' WHEN band = rival THEN 'TWO_DAY_CONFIRM' ELSE 'NONE' END AS tr
    FROM (SELECT *, CAST(least(floor(e / 20), 4) AS BIGINT) AS band FROM (SELECT {skey}s.n, s.date, r.g, r.rival, CASE WHEN r.emotion IS NULL THEN s.score ELSE (s.score + r.emotion) / 2 END AS e FROM rec r JOIN ser s ON {on}s.n = r.n + 1))))"""
_BAND = lambda x: "CASE " + " ".join(f"WHEN {x} = {i} THEN '{b}'" for i, b in enumerate(ms.BANDS)) + " END"

_MAPPED = """r AS (SELECT o_orderkey AS k, o_custkey % 50 AS i, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS st, o_orderkey % 1000 AS p FROM orders), who AS (SELECT DISTINCT c_custkey % 50 AS i FROM customer),
e AS (SELECT *, i % 13 <> 3 AND i IN (SELECT i FROM who) AS known, k % 53 <> 0 AND k % 59 = 0 AS minus FROM r),
x AS (SELECT *, CASE WHEN known AND i % 17 = 5 THEN 'CANONICAL_IDENTITY_AMBIGUOUS:entity_key' WHEN NOT known THEN 'CANONICAL_IDENTITY_UNRESOLVED:entity_key' WHEN k % 97 = 0 THEN 'CANONICAL_NULL_FORBIDDEN:trade_date' WHEN k % 89 = 0 THEN 'CANONICAL_TYPE_INVALID:trade_date'
  WHEN st NOT IN ('O', 'F') THEN 'CANONICAL_ENUM_UNKNOWN:trading_status' WHEN k % 53 = 0 THEN 'CANONICAL_TYPE_INVALID:close' WHEN k % 67 = 0 AND k % 61 <> 0 THEN 'CANONICAL_TYPE_INVALID:volume_shares' WHEN p + k % 7 - 1 < 0 OR minus THEN 'CANONICAL_NEGATIVE_VALUE:' WHEN k % 7 = 0 THEN 'CANONICAL_OHLC_INVALID:'
  WHEN day(d) = 31 THEN 'CANONICAL_TRADING_CALENDAR_UNAVAILABLE:' WHEN isodow(d) > 5 THEN 'CANONICAL_NON_TRADING_DAY:' END AS why FROM e),
f AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY why IS NULL, i, d ORDER BY k) > 1 THEN 'CANONICAL_DUPLICATE_KEY:' ELSE why END AS final FROM x),
m AS (SELECT *, nullif(string_split(final, ':')[1], '') AS code, nullif(string_split(final, ':')[2], '') AS field FROM f)"""
ORACLES = {
    "m7_mapped_rows": f"WITH {_MAPPED} SELECT k AS ordinal, code, field, CASE WHEN code IS NULL THEN 'stock:' || i END AS entity_key, CASE WHEN code IS NULL THEN d END AS trade_date, CASE WHEN code IS NULL THEN CASE st WHEN 'O' THEN 'TRADED' ELSE 'SUSPENDED' END END AS trading_status, CASE WHEN code IS NULL THEN CAST(p AS DOUBLE) END AS close, CASE WHEN code IS NULL THEN CASE WHEN k % 61 = 0 THEN 150 ELSE k % 90 * 100 END END AS volume_shares FROM m",
    "a22_quality_report": f"WITH {_MAPPED} SELECT count(*) AS row_count, count(code) AS rejected_row_count, count(*) FILTER (code = 'CANONICAL_DUPLICATE_KEY') AS duplicate_key_count, count(*) FILTER (code = 'CANONICAL_IDENTITY_UNRESOLVED') AS identity_unresolved_count, count(*) FILTER (code = 'CANONICAL_IDENTITY_AMBIGUOUS') AS identity_ambiguous_count, array_to_string(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), ',') AS failure_reasons, CASE WHEN count(code) = 0 THEN 'COMPLETE' ELSE 'FAILED' END AS quality_status FROM m",
    "m1_universe": f"WITH {_UNIVERSE} SELECT entity, date, listed, valid, observable, ruled, array_to_string(reasons, ',') AS reasons, CAST(NULL AS VARCHAR) AS problem FROM u",
    "m2_raw_metrics": f"WITH {_METRICS} SELECT date, flags, " + ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {x}" for x in ms.METRICS) + " FROM raw",
    "m5_market_evaluator": f"WITH RECURSIVE {_METRICS}, {', '.join(map(_score, _ALL))}, sc AS (SELECT date, {_DIMENSIONS} FROM (SELECT date FROM raw) "
    + " ".join(f"LEFT JOIN n_{x} USING (date)" for x in _ALL)
    + f"), ser AS (SELECT *, {' + '.join(f'score_{x} * {k} / 100' for x, k in ms.TOTAL.items())} AS score, row_number() OVER (ORDER BY date) AS n FROM sc), "
    + _FOLD.format(key="", skey="", start="(SELECT 1)", on="")
    + f" SELECT date, {', '.join(f'round(score_{x}, 5) AS score_{x}' for x in ms.DIMENSIONS)}, round(score, 5) AS emotion_raw, round(emotion, 5) AS emotion, {_BAND('g')} AS regime, {_BAND('old')} AS regime_before, trigger FROM rec JOIN ser USING (date)",
    "w42_regimes": f"""WITH RECURSIVE {tables.WEEKLY_SQL}, p AS (SELECT code, date, close, list(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS x FROM bars), q AS (SELECT *, CASE WHEN len(x) >= 60 THEN list_median(x) END AS md FROM p),
      ser AS (SELECT code, date, CASE WHEN md IS NOT NULL THEN 50 + least(3, greatest(-3, (close - md) / (1.4826::DOUBLE * list_median([abs(v - md) FOR v IN x]) + 1e-12::DOUBLE))) * 100 / 6 END AS score, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM q), """
    + _FOLD.format(key="code, ", skey="s.code, ", start="(SELECT DISTINCT code FROM ser)", on="s.code = r.code AND ")
    + f" SELECT code, date, round(emotion, 6) AS emotion, {_BAND('g')} AS regime, {_BAND('old')} AS regime_before, trigger FROM rec WHERE n > 0",
}
