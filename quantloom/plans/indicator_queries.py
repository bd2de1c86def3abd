"""Queries of the time-series indicators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.operators import indicators as ind
from quantloom.sources import tables

B = "WITH " + tables.BARS_SQL + " "
W = "WITH " + tables.WEEKLY_SQL + " "
KEY = ["code", "date"]


def _query(step, *columns: str, source=tables.daily_bars):
    def run(spark, sf_dir):
        return rounded(step(source(spark, sf_dir)).select(*KEY, *columns))

    return run


def _full(f: str, x: str, n: int, before: int = 0) -> str:
    w = f"(PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1 + before} PRECEDING AND {before} {'PRECEDING' if before else 'FOLLOWING'})".replace("0 FOLLOWING", "CURRENT ROW")
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {f}({x}) OVER {w} END"


LAG = "lag(close) OVER (PARTITION BY code ORDER BY date)"
FOLD = "lambda a, x: x * {0} + a * (1 - {0})"
LISTS = "l AS (SELECT code, list(date ORDER BY date) AS d, list(close ORDER BY date) AS c FROM bars GROUP BY code)"


def _ewm(values: str, alpha: str) -> str:
    return f"[list_reduce({values}[1:i], {FOLD.format(alpha)}) FOR i IN range(1, len({values}) + 1)]"


def _adjust(spark, sf_dir):
    df = tables.daily_bars(spark, sf_dir)
    factors = df.where(F.dayofmonth("date") == 1).select("code", "date", (1 + F.dayofyear("date") / 1000).alias("factor"))
    return rounded(ind.adjusted(df, factors).select(*KEY, "close", "factor"), 8)


QUERIES = {
    "w1_partial_averages": _query(ind.partial_averages, "ma5", "ma10", "ma20"),
    "w2_moving_averages": _query(ind.moving_averages, "ma5", "ma10", "ma20", "ma60"),
    "w3_bias": _query(ind.bias, "bias5", "bias10", "bias20", "above20"),
    "w4_w6_volume_ratios": _query(ind.volume_ratios, "volume_ratio", "volume_ratio_20d"),
    "w8_macd": _query(ind.macd, "dif", "dea", "macd", source=tables.weekly_bars),
    "w10_macd_signal": lambda s, d: _query(ind.macd_signal, "signal", source=tables.weekly_bars)(s, d).groupBy("signal").agg(F.count("*").alias("n")),
    "w11_simple_rsi": _query(ind.simple_rsi, "rsi", "rsi_status"),
    "w12_wilder_rsi": _query(ind.wilder_rsi, "rsi", source=tables.weekly_bars),
    "w14_kdj": _query(ind.kdj, "k", "d", "j", source=tables.weekly_bars),
    "w15_cci": _query(ind.cci, "cci", source=tables.weekly_bars),
    "w16_true_range": _query(ind.true_range, "atr_20_pct", source=tables.weekly_bars),
    "w17_volatility": _query(ind.volatility, "volatility_20d_pct"),
    "w18_drawdown": _query(ind.drawdown, "max_drawdown_20d_pct"),
    "w19_shape": _query(ind.shape, "range_20d_pct", "prev_high_20d", "breakout_20d_pct", "body_pct", "pullback_ma20_pct"),
    "w20_consolidation": _query(lambda df: ind.consolidation(df, percent=60.0), "consolidation_days", source=tables.weekly_bars),
    "w21_change_60d": _query(ind.change_60d, "change_60d"),
    "w23_trend_state": _query(ind.trend_state, "trend"),
    "w28_edge_cross": _query(lambda df: ind.edge_cross(ind.moving_averages(df, (20,)), "close", "ma20"), "cross"),
    "w29_daily_features": _query(ind.daily_features, "ma5", "ma20", "ma60", "volume_ratio", "atr_20_pct", "rsi_status", "change_60d", "consolidation_days", "macd_status", "ma_bullish", "price_above_ma20", "rsi", "daily_data_points", "daily_quality_score", "daily_quality_flags", "volume_ratio_20d", "body_pct", "prev_high_20d", "range_20d_pct", "breakout_20d_pct", "pullback_ma20_pct", "volatility_20d_pct", "max_drawdown_20d_pct", "signal_score"),
    "w9_macd_status": lambda s, d: ind.macd_status(tables.daily_bars(s, d)),
    "w30_bar_quality": lambda s, d: rounded(ind.bar_quality(tables.daily_bars(s, d))),
    "w31_candles": lambda s, d: ind.candles(tables.weekly_bars(s, d)).groupBy("code").agg(*[F.count_if(F.col(x)).alias(x) for x in ("doji", "hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing")]),
    "w33_w36_point_in_time": _query(ind.point_in_time, "return_1d", "adv20", "variation_20", "atr14", source=tables.weekly_bars),
    "w49_adjusted_prices": _adjust,
}

_TR = f"greatest(high - low, abs(high - {LAG}), abs(low - {LAG}))"
_MACD = f"{W}, {LISTS}, e AS (SELECT code, d, {_ewm('c', '(2 / 13)')} AS f, {_ewm('c', '(2 / 27)')} AS s FROM l), g AS (SELECT code, d, [f[i] - s[i] FOR i IN range(1, len(f) + 1)] AS dif FROM e), h AS (SELECT code, d, dif, {_ewm('dif', '(2 / 10)')} AS dea FROM g), m AS (SELECT code, unnest(d) AS date, unnest(dif) AS dif, unnest(dea) AS dea FROM h)"
_MA = lambda n: _full("avg", "close", n)
_PREV20 = "(PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_LAST20 = "(PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_P5 = "(PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_VR = f"coalesce(CASE WHEN count(volume) OVER {_P5} = 5 AND avg(volume) OVER {_P5} > 0 THEN volume / avg(volume) OVER {_P5} END, 1)"
_CHANGE60 = "(close / coalesce(lag(close, 60) OVER (PARTITION BY code ORDER BY date), first_value(close) OVER (PARTITION BY code ORDER BY date)) - 1) * 100"


def _days(percent: float) -> str:
    parts = []
    for d in range(2, 21):
        w = f"(PARTITION BY code ORDER BY date ROWS BETWEEN {d} PRECEDING AND 1 PRECEDING)"
        parts.append(f"CASE WHEN count(close) OVER {w} = {d} AND (max(high) OVER {w} / min(low) OVER {w} - 1) * 100 <= {percent} THEN {d} END")
    return f"CASE WHEN {LAG} IS NOT NULL THEN coalesce(greatest({', '.join(parts)}), 0) END"


_DELTA = f"d AS (SELECT *, close - {LAG} AS d FROM bars), gl AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS l FROM d)"
_RSI = f"rs AS (SELECT *, 100 - 100 / (1 + {_full('avg', 'g', 14)} / nullif({_full('avg', 'l', 14)}, 0)) AS rsi FROM gl)"
_STATUS = "CASE WHEN rsi <= 35 THEN 'oversold' WHEN rsi >= 70 THEN 'overbought' ELSE 'neutral' END"
_MSTATUS = """ml AS (SELECT code, count(*) AS n, list_reduce(list({'f': close, 's': close, 'd': 0::DOUBLE} ORDER BY date), lambda a, x: {'f': x.f * (2 / 13) + a.f * (1 - 2 / 13), 's': x.s * (2 / 27) + a.s * (1 - 2 / 27), 'd': ((x.f * (2 / 13) + a.f * (1 - 2 / 13)) - (x.s * (2 / 27) + a.s * (1 - 2 / 27))) * 0.2::DOUBLE + a.d * 0.8::DOUBLE}) AS m FROM bars GROUP BY code),
  ms AS (SELECT code, CASE WHEN n < 35 THEN 'neutral' WHEN m.f - m.s > m.d AND m.f - m.s > 0 THEN 'bullish' WHEN m.f - m.s < m.d AND m.f - m.s < 0 THEN 'bearish' ELSE 'neutral' END AS macd_status FROM ml)"""
_QUALITY = """qr AS (SELECT code, count(*) AS n, bool_or(volume < 0) AS neg, bool_or(high < low OR high < open OR high < close OR low > open OR low > close) AS inv, bool_or(least(open, high, low, close) <= 0) AS nonpos FROM bars WHERE close IS NOT NULL GROUP BY code),
  qs AS (SELECT code, CAST(greatest(0, 100 - CASE WHEN n < 30 THEN 35 WHEN n < 60 THEN 15 ELSE 0 END - CASE WHEN neg THEN 20 ELSE 0 END - CASE WHEN inv THEN 30 ELSE 0 END - CASE WHEN nonpos THEN 35 ELSE 0 END) AS DOUBLE) AS score,
    concat_ws(';', CASE WHEN n < 30 THEN 'short_history_lt30' WHEN n < 60 THEN 'short_history_lt60' END, CASE WHEN neg THEN 'negative_volume' END, CASE WHEN inv THEN 'invalid_ohlc' END, CASE WHEN nonpos THEN 'non_positive_price' END) AS flags FROM qr)"""

ORACLES = {
    "w1_partial_averages": B + "SELECT code, date, " + ", ".join(f"round(avg(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS ma{n}" for n in (5, 10, 20)) + " FROM bars",
    "w2_moving_averages": B + f"SELECT code, date, round({_MA(5)}, 6) AS ma5, round({_MA(10)}, 6) AS ma10, round({_MA(20)}, 6) AS ma20, round(CASE WHEN count(*) OVER (PARTITION BY code) >= 60 THEN {_MA(60)} ELSE {_MA(20)} END, 6) AS ma60 FROM bars",
    "w3_bias": B + f", m AS (SELECT *, {_MA(5)} AS ma5, {_MA(10)} AS ma10, {_MA(20)} AS ma20 FROM bars) SELECT code, date, " + ", ".join(f"round((close - ma{n}) / ma{n} * 100, 6) AS bias{n}" for n in (5, 10, 20)) + ", close > ma20 AS above20 FROM m",
    "w4_w6_volume_ratios": B + f"SELECT code, date, round({_VR}, 6) AS volume_ratio, round(CASE WHEN avg(volume) OVER {_PREV20} > 0 THEN volume / avg(volume) OVER {_PREV20} END, 6) AS volume_ratio_20d FROM bars",
    "w8_macd": _MACD + " SELECT code, date, round(dif, 6) AS dif, round(dea, 6) AS dea, round(2 * (dif - dea), 6) AS macd FROM m",
    "w10_macd_signal": _MACD + """, p AS (SELECT *, row_number() OVER w AS nth, lag(dif - dea) OVER w AS d0, dif - dea AS d1, lag(dif) OVER w AS z0 FROM m WINDOW w AS (PARTITION BY code ORDER BY date))
      SELECT CASE WHEN nth < 26 THEN 'BULLISH' WHEN d0 <= 0 AND d1 > 0 AND dif > 0 THEN 'GOLDEN_CROSS_ZERO' WHEN z0 <= 0 AND dif > 0 THEN 'CROSSING_UP' WHEN d0 <= 0 AND d1 > 0 THEN 'GOLDEN_CROSS' WHEN d0 >= 0 AND d1 < 0 THEN 'DEATH_CROSS'
        WHEN z0 >= 0 AND dif < 0 THEN 'CROSSING_DOWN' WHEN dif > 0 AND dea > 0 THEN 'BULLISH' WHEN dif < 0 AND dea < 0 THEN 'BEARISH' ELSE 'BULLISH' END AS signal, count(*) AS n FROM p GROUP BY 1""",
    "w11_simple_rsi": B + f", {_DELTA}, {_RSI} SELECT code, date, round(rsi, 6) AS rsi, {_STATUS} AS rsi_status FROM rs",
    "w12_wilder_rsi": W + f""", dd AS (SELECT code, date, coalesce(close - {LAG}, 0) AS d FROM bars), ll AS (SELECT code, list(date ORDER BY date) AS d, list(greatest(d, 0) ORDER BY date) AS g, list(greatest(-d, 0) ORDER BY date) AS l FROM dd GROUP BY code),
      e AS (SELECT code, unnest(d) AS date, unnest({_ewm('g', '(1 / 14)')}) AS g, unnest({_ewm('l', '(1 / 14)')}) AS l FROM ll)
      SELECT code, date, round(CASE WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM e""",
    "w14_kdj": W + f""", r AS (SELECT code, date, close, {_full('min', 'low', 9)} AS lo, {_full('max', 'high', 9)} AS hi FROM bars), v AS (SELECT code, date, CASE WHEN hi = lo THEN 50 ELSE (close - lo) / (hi - lo) * 100 END AS rsv FROM r WHERE lo IS NOT NULL),
      ll AS (SELECT code, list(date ORDER BY date) AS d, list(CAST(rsv AS DOUBLE) ORDER BY date) AS r FROM v GROUP BY code), e AS (SELECT code, d, {_ewm('r', '(1 / 3)')} AS k FROM ll), f AS (SELECT code, d, k, {_ewm('k', '(1 / 3)')} AS dd FROM e),
      u AS (SELECT code, unnest(d) AS date, unnest(k) AS k, unnest(dd) AS d FROM f) SELECT code, date, round(k, 6) AS k, round(d, 6) AS d, round(3 * k - 2 * d, 6) AS j FROM u""",
    "w15_cci": W + f""", t AS (SELECT code, date, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT *, {_full('avg', 'tp', 14)} AS mean, list(tp) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS tps FROM t)
      SELECT code, date, round((tp - mean) / nullif(0.015 * (list_sum([abs(x - mean) FOR x IN tps]) / 14), 0), 6) AS cci FROM m""",
    "w16_true_range": W + f", t AS (SELECT *, {_TR} AS tr FROM bars) SELECT code, date, round(CASE WHEN close > 0 THEN ({_full('avg', 'tr', 20)}) / close * 100 END, 6) AS atr_20_pct FROM t",
    "w17_volatility": B + f", t AS (SELECT *, close / {LAG} - 1 AS ret FROM bars) SELECT code, date, round(({_full('stddev_samp', 'ret', 19)}) * sqrt(252) * 100, 6) AS volatility_20d_pct FROM t",
    "w18_drawdown": B + f", t AS (SELECT code, date, list(close) OVER {_LAST20} AS x FROM bars) SELECT code, date, CASE WHEN len(x) = 20 THEN round(least(0, list_min([x[i] / list_max(x[1:i]) - 1 FOR i IN range(1, 21)])) * 100, 6) END AS max_drawdown_20d_pct FROM t",
    "w19_shape": B + f"SELECT code, date, round((max(high) OVER {_LAST20} / min(low) OVER {_LAST20} - 1) * 100, 6) AS range_20d_pct, round(max(high) OVER {_PREV20}, 6) AS prev_high_20d, round((close / max(high) OVER {_PREV20} - 1) * 100, 6) AS breakout_20d_pct, round((close / open - 1) * 100, 6) AS body_pct, round((close / ({_MA(20)}) - 1) * 100, 6) AS pullback_ma20_pct FROM bars",
    "w20_consolidation": W + f"SELECT code, date, {_days(60.0)} AS consolidation_days FROM bars",
    "w21_change_60d": B + f"SELECT code, date, round({_CHANGE60}, 6) AS change_60d FROM bars",
    "w23_trend_state": B + f""", m AS (SELECT code, date, {_MA(5)} AS a, {_MA(10)} AS b, {_MA(20)} AS c FROM bars), s AS (SELECT *, lag(a, 4) OVER (PARTITION BY code ORDER BY date) AS a4, lag(c, 4) OVER (PARTITION BY code ORDER BY date) AS c4 FROM m),
      t AS (SELECT *, coalesce(CASE WHEN a < c THEN (c - a) / a * 100 > 5 AND (c - a) / a > (c4 - a4) / a4 ELSE (a - c) / c * 100 > 5 AND (a - c) / c > (a4 - c4) / c4 END, false) AS wide FROM s)
      SELECT code, date, CASE WHEN c IS NULL THEN NULL WHEN a > b AND b > c AND wide THEN 'STRONG_BULL' WHEN a > b AND b > c THEN 'BULL' WHEN a < b AND b < c AND wide THEN 'STRONG_BEAR' WHEN a < b AND b < c THEN 'BEAR' WHEN a > b AND b <= c THEN 'WEAK_BULL' WHEN a < b AND b >= c THEN 'WEAK_BEAR' ELSE 'CONSOLIDATION' END AS trend FROM t""",
    "w28_edge_cross": B + f", m AS (SELECT code, date, close - ({_MA(20)}) AS g FROM bars), p AS (SELECT *, lag(g) OVER (PARTITION BY code ORDER BY date) AS g0 FROM m) SELECT code, date, CASE WHEN g0 <= 0 AND g > 0 THEN 'up' WHEN g0 >= 0 AND g < 0 THEN 'down' END AS cross FROM p",
    "w9_macd_status": B + f", {_MSTATUS} SELECT code, macd_status FROM ms",
    "w29_daily_features": B + f""", {_DELTA}, {_RSI}, {_MSTATUS}, {_QUALITY}, t AS (SELECT *, {_TR} AS tr, close / {LAG} - 1 AS ret, list(close) OVER {_LAST20} AS x20 FROM rs), f AS (SELECT code, date, close, open, {_MA(5)} AS ma5, {_MA(20)} AS ma20, {_MA(60)} AS ma60, {_VR} AS volume_ratio, rsi,
        CASE WHEN close > 0 THEN ({_full('avg', 'tr', 20)}) / close * 100 END AS atr_20_pct, {_STATUS} AS rsi_status, {_CHANGE60} AS change_60d, {_days(12.0)} AS consolidation_days, count(close) OVER (PARTITION BY code) AS daily_data_points,
        CASE WHEN avg(volume) OVER {_PREV20} > 0 THEN volume / avg(volume) OVER {_PREV20} END AS volume_ratio_20d, (close / open - 1) * 100 AS body_pct, max(high) OVER {_PREV20} AS prev_high_20d, (max(high) OVER {_LAST20} / min(low) OVER {_LAST20} - 1) * 100 AS range_20d_pct,
        ({_full('stddev_samp', 'ret', 19)}) * sqrt(252) * 100 AS volatility_20d_pct, CASE WHEN len(x20) = 20 THEN least(0, list_min([x20[i] / list_max(x20[1:i]) - 1 FOR i IN range(1, 21)])) * 100 END AS max_drawdown_20d_pct FROM t),
      g AS (SELECT f.*, macd_status, score, flags, coalesce(ma5 >= ma20 AND ma20 >= ma60, false) AS ma_bullish, coalesce(close >= ma20, false) AS price_above_ma20 FROM f JOIN ms ON f.code = ms.code JOIN qs ON f.code = qs.code QUALIFY row_number() OVER (PARTITION BY f.code ORDER BY date DESC) = 1),
      h AS (SELECT *, 50 + CASE WHEN ma_bullish THEN 14 ELSE 0 END + CASE WHEN price_above_ma20 THEN 10 ELSE 0 END + CASE macd_status WHEN 'bullish' THEN 12 WHEN 'bearish' THEN -12 ELSE 0 END + CASE rsi_status WHEN 'oversold' THEN 4 WHEN 'overbought' THEN -6 ELSE 0 END
        + CASE WHEN change_60d BETWEEN 0 AND 35 THEN least(change_60d * 0.35::DOUBLE, 12) WHEN change_60d > 60 THEN -least((change_60d - 60) * 0.2::DOUBLE, 12) WHEN change_60d < -25 THEN -least(abs(change_60d + 25) * 0.25::DOUBLE, 10) ELSE 0 END AS s FROM g)
      SELECT code, date, """ + ", ".join(f"round({x}, 6) AS {x}" for x in ("ma5", "ma20", "ma60", "volume_ratio", "atr_20_pct", "change_60d", "rsi", "volume_ratio_20d", "body_pct", "prev_high_20d", "range_20d_pct", "volatility_20d_pct", "max_drawdown_20d_pct")) + """, rsi_status, consolidation_days, macd_status, ma_bullish, price_above_ma20, daily_data_points, round(score, 6) AS daily_quality_score, flags AS daily_quality_flags,
        round((close / prev_high_20d - 1) * 100, 6) AS breakout_20d_pct, round((close / ma20 - 1) * 100, 6) AS pullback_ma20_pct, round(least(100, greatest(0, s)), 6) AS signal_score FROM h""",
    "w30_bar_quality": B + f", {_QUALITY} SELECT code, round(score, 6) AS daily_quality_score, flags AS daily_quality_flags FROM qs",
    "w31_candles": W + """, p AS (SELECT *, abs(close - open) AS b, high - low AS s, high - greatest(open, close) AS u, least(open, close) - low AS l, lag(open) OVER w AS o1, lag(close) OVER w AS c1 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))
      SELECT code, CAST(count_if(s > 0 AND b <= 0.1::DOUBLE * s) AS BIGINT) AS doji, CAST(count_if(s > 0 AND l >= 2 * b AND u <= b AND b > 0) AS BIGINT) AS hammer, CAST(count_if(s > 0 AND u >= 2 * b AND l <= b AND b > 0) AS BIGINT) AS shooting_star,
        CAST(count_if(c1 < o1 AND close > open AND close >= o1 AND open <= c1) AS BIGINT) AS bullish_engulfing, CAST(count_if(c1 > o1 AND close < open AND close <= o1 AND open >= c1) AS BIGINT) AS bearish_engulfing FROM p GROUP BY code""",
    "w33_w36_point_in_time": W + f", t AS (SELECT *, {LAG} AS p, CASE WHEN {LAG} IS NULL THEN high - low ELSE {_TR} END AS tr FROM bars) SELECT code, date, round(close / p - 1, 6) AS return_1d, round({_full('avg', 'amount', 20)}, 6) AS adv20, round(({_full('stddev_pop', 'close', 20)}) / ({_MA(20)}), 6) AS variation_20, round({_full('avg', 'tr', 14)}, 6) AS atr14 FROM t",
    "w49_adjusted_prices": B + """, f AS (SELECT code, date, 1 + dayofyear(date) / 1000 AS factor FROM bars WHERE day(date) = 1), m AS (SELECT code, arg_max(factor, date) AS latest FROM f GROUP BY code),
      j AS (SELECT b.code, b.date, b.close, coalesce(first_value(f.factor IGNORE NULLS) OVER (PARTITION BY b.code ORDER BY b.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS factor FROM bars b LEFT JOIN f ON b.code = f.code AND b.date = f.date)
      SELECT j.code, date, round(close * (factor / coalesce(latest, 1)), 8) AS close, round(factor / coalesce(latest, 1), 8) AS factor FROM j LEFT JOIN m ON j.code = m.code""",
}
