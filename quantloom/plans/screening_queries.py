"""Queries of screening, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.operators import hard_filters as hf
from quantloom.operators import indicators as ind
from quantloom.operators import screening as scr
from quantloom.plans import indicator_queries as iq
from quantloom.sources import tables

c = F.col
WEIGHTS = {"value": 0.25, "momentum": 0.25, "liquidity": 0.15, "activity": 0.15, "stability": 0.1, "size": 0.1}
SNAPSHOT_FACTORS = ("value", "liquidity", "momentum", "reversal", "activity", "stability", "size")
RULE_NAMES = ["name", "price_min", "pe_range", "turnover_max", "regions"]


def _rules() -> list[scr.Rule]:
    """Made when a query runs: columns need a session."""
    conditions = [scr.excludes_names("ST|退"), c("price") >= 1000, (c("pe_ratio") > 0) & (c("pe_ratio") <= 500), c("turnover_rate") <= 15, c("concepts").isin("ASIA", "EUROPE", "AMERICA")]
    return [scr.Rule(name, x) for name, x in zip(RULE_NAMES, conditions, strict=True)]


def _scored(spark, sf_dir):
    return scr.score(tables.snapshot(spark, sf_dir), WEIGHTS)


DAILY = ("volatility_20d_pct", "max_drawdown_20d_pct", "atr_20_pct", "daily_quality_score", "daily_quality_flags")


def f6_f12_daily_penalties(spark, sf_dir):
    """Stability, with some of its profile overridden, and risk on features of real bars."""
    daily = rounded(ind.daily_features(tables.daily_bars(spark, sf_dir)).select("code", *DAILY))
    df = tables.snapshot(spark, sf_dir).join(daily, "code")
    scored = scr.score(df, {"stability": 1.0}, {"stability_high_volatility_pct": 300.0, "stability_high_atr_pct": 20.0, "no_such_key": 1.0})
    return rounded(scr.risk(scored).select("code", "stability_score", "risk_points", "risk_flags"))


def f8_f9_theme_topics(spark, sf_dir):
    """Heat of the industry's board and topics that hot boards name."""
    k = c("code")
    df = tables.snapshot(spark, sf_dir).withColumns({
        "board_heat_score": F.when(k % 6 != 0, (k * 13 % 100).cast("double")), "board_heat_trend_score": (k * 7 % 41 - 20).cast("double"), "board_heat_observations": k % 4, "board_heat_persistence_score": (k * 3 % 101).cast("double"), "board_heat_cooling_score": (k % 23).cast("double"),
        "board_heat_summary": F.when(k % 5 == 0, "none").when(k % 5 == 1, "ASIA:80|Rank:1").when(k % 5 == 2, F.concat(c("industry"), F.lit(":70/EUROPE:60"))).otherwise("AFRICA；NATION_3，other"),
    })
    return rounded(scr.score(df, {"theme_heat": 1.0, "topic_alignment": 1.0}).select("code", "theme_heat_score", "topic_alignment_score", "screen_score"))


HARD = {"exclude_st": True, "amount_min": 20_000.0, "price_min": 1000.0, "pe_ttm_min": 0.0, "pe_ttm_max": 500.0, "turnover_rate_min": 1.0, "change_pct_max": 9.0, "macd_status_whitelist": ["bullish", "neutral"], "signal_score_min": 20.0, "require_ma_bullish": True}


def _with_flag(spark, sf_dir):
    return tables.snapshot(spark, sf_dir).withColumn("ma_bullish", F.when(c("code") % 7 != 0, c("code") % 3 != 0))


def p6_p7_waterfall_samples(spark, sf_dir):
    out = hf.filter_waterfall(_with_flag(spark, sf_dir), HARD, samples=2)
    return out.select("step", "rule", "before", "after", "removed", F.array_join(F.transform("samples", lambda x: x["code"]), ",").alias("codes"))


QUERIES = {
    "p1_p3_p4_filters_by_name": lambda s, d: hf.apply_hard_filters(_with_flag(s, d), HARD).select("code", "name", "price"),
    "p6_p7_waterfall_samples": p6_p7_waterfall_samples,
    "f6_f12_daily_penalties": f6_f12_daily_penalties,
    "f8_f9_theme_topics": f8_f9_theme_topics,
    "p1_hard_filters": lambda s, d: scr.hard_filters(tables.snapshot(s, d), _rules()).select("code", "name", "price", "pe_ratio"),
    "p6_filter_waterfall": lambda s, d: rounded(scr.waterfall(tables.snapshot(s, d), _rules())),
    "f1_f7_factor_scores": lambda s, d: rounded(scr.score(tables.snapshot(s, d), dict.fromkeys(SNAPSHOT_FACTORS, 1.0)).select("code", *[f"{f}_score" for f in SNAPSHOT_FACTORS])),
    "f10_r2_r3_candidates": lambda s, d: rounded(scr.candidates(_scored(s, d), WEIGHTS, 20).select("code", "screen_score", "value_score")),
    "f12_risk": lambda s, d: scr.risk(tables.snapshot(s, d)).select("code", "risk_points", "risk_flags", "risk_level"),
    "f13_concentration": lambda s, d: rounded(scr.concentration_penalty(_scored(s, d), "concepts").select("code", "concepts", "penalty", "final_score")),
    "f17_f19_board_heat": lambda s, d: rounded(tables.snapshot(s, d).groupBy("industry").agg(F.avg("change_pct").alias("change"), F.avg("code").alias("rank")).select("industry", scr.board_heat(c("change"), c("rank")).alias("heat"), scr.theme_phase(c("change")).alias("phase"))),
    "f20_name_match": lambda s, d: rounded(tables.table(s, d, "nation").select("n_nationkey", scr.char_jaccard(c("n_name"), F.lit("NATION_7")).alias("jaccard"))),
    "r1_percentile_rank": lambda s, d: rounded(tables.daily_bars(s, d, by="date").select("code", "date", scr.percentile_score(c("close"), lower_is_better=False, missing=50, by=[c("date")]).alias("score"))),
    "r5_seeded_rotation": lambda s, d: scr.seeded_rotation(_scored(s, d), "s1", "2024-01", "concepts", 6).select("code", "concepts", "place"),
}


def _pct(x: str, desc: bool, missing: int, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    other = f"{by}, {x}" if by else x
    return f"CASE WHEN {x} IS NULL THEN {missing} ELSE (rank() OVER ({part} ORDER BY {x} {'DESC' if desc else 'ASC'} NULLS LAST) + (count({x}) OVER (PARTITION BY {other}) - 1) / 2) / count({x}) OVER ({part}) * 100 END"


_S = f"WITH {tables.SNAPSHOT_SQL}, b AS (SELECT *, CASE WHEN pe_ratio > 0 AND pe_ratio < 500 THEN pe_ratio END AS pe, CASE WHEN pb_ratio > 0 AND pb_ratio < 50 THEN pb_ratio END AS pb, CASE WHEN amount > 0 THEN log10(greatest(amount, 1)) END AS la, CASE WHEN total_mv > 0 THEN log10(greatest(total_mv, 1)) END AS lm, coalesce(change_pct, 0) AS x, coalesce(change_60d, 0) AS y, coalesce(signal_score, 50) AS s, coalesce(volume_ratio, 1) AS r, coalesce(turnover_rate, 0) AS t FROM snap), "
_F = _S + f"""f AS (SELECT *,
  least(100, greatest(0, (17.5 + ({_pct('pe', True, 25)}) * 0.65::DOUBLE) * 0.55::DOUBLE + ({_pct('pb', True, 25)}) * 0.45::DOUBLE)) AS value_score, {_pct('la', False, 20)} AS liquidity_score, {_pct('lm', False, 35)} AS size_score,
  least(100, greatest(5, ((17.5 + least(100, greatest(5, 60 + x * 5 - greatest(x - 5, 0) * 10 - greatest(-x - 2, 0) * 3)) * 0.65::DOUBLE) * 0.6::DOUBLE + least(100, greatest(5, 55 + y * 0.9::DOUBLE - greatest(y - 45, 0) * 0.8::DOUBLE - greatest(-y - 20, 0) * 0.7::DOUBLE)) * 0.4::DOUBLE) * 0.7::DOUBLE + least(100, greatest(0, s)) * 0.3::DOUBLE + CASE macd_status WHEN 'bullish' THEN 6 WHEN 'bearish' THEN -8 ELSE 0 END)) AS momentum_score,
  least(100, greatest(5, 100 - abs(x + 3) * 13 - greatest(-x - 8, 0) * 10 - greatest(x - 1, 0) * 8 + CASE rsi_status WHEN 'oversold' THEN 10 WHEN 'overbought' THEN -14 ELSE 0 END - greatest(y - 35, 0) * 0.5::DOUBLE - greatest(-y - 35, 0) * 0.8::DOUBLE)) AS reversal_score,
  least(100, greatest(0, (22.5 + least(100, greatest(5, 100 - abs(r - 2) * 15 - greatest(r - 5, 0) * 8)) * 0.55::DOUBLE) * 0.55::DOUBLE + least(100, greatest(5, CASE WHEN t > 0 THEN 100 - abs(t - 4) * 8 - greatest(t - 12, 0) * 5 ELSE 40 END)) * 0.45::DOUBLE)) AS activity_score,
  least(100, greatest(0, 78 - least(abs(x), 10) * 3 - greatest(x - 7, 0) * 5 - greatest(t - 10, 0) * 2 - greatest(r - 5, 0) * 4 - CASE WHEN pe_ratio <= 0 THEN 18 ELSE 0 END + (s - 50) * 0.12::DOUBLE)) AS stability_score FROM b)"""
_SC = _F + ", g AS (SELECT *, value_score * 0.25::DOUBLE + momentum_score * 0.25::DOUBLE + liquidity_score * 0.15::DOUBLE + activity_score * 0.15::DOUBLE + stability_score * 0.1::DOUBLE + size_score * 0.1::DOUBLE AS screen_score FROM f)"
_RULES_SQL = ["(NOT coalesce(regexp_matches(name, 'ST|退'), false))", "coalesce(price >= 1000, false)", "coalesce(pe_ratio > 0 AND pe_ratio <= 500, false)", "coalesce(turnover_rate <= 15, false)", "coalesce(concepts IN ('ASIA', 'EUROPE', 'AMERICA'), false)"]
_N = ["count(*) AS n0", *(f"count_if({' AND '.join(_RULES_SQL[: i + 1])}) AS n{i + 1}" for i in range(5))]
_RULES = [
    ("single_day_chase_risk", "change_pct >= 8", 4), ("single_day_breakdown_risk", "change_pct <= -7", 3.5), ("abnormal_volume_ratio", "volume_ratio >= 6", 3), ("high_turnover", "turnover_rate >= 15", 3), ("negative_or_invalid_pe", "pe_ratio <= 0", 3), ("high_pb", "pb_ratio >= 8", 2),
    ("weak_daily_signal", "signal_score < 45", 2.5), ("macd_bearish", "macd_status = 'bearish'", 2), ("rsi_overbought", "rsi_status = 'overbought'", 1.5),
]
_RISK = "CAST(" + " + ".join(f"CASE WHEN {cond} THEN {n} ELSE 0 END" for _, cond, n in _RULES) + " AS DOUBLE)"

_DAILY_RISK = f"{_RISK} + CASE WHEN daily_quality_score < {scr.RISK_PROFILE['low_daily_quality_score']}::DOUBLE THEN {scr.RISK_PROFILE['low_daily_quality_points']}::DOUBLE ELSE 0 END"
_TOPICS = lambda x: f"list_distinct(list_filter([trim(string_split(v, ':')[1]) FOR v IN regexp_split_to_array(coalesce({x}, ''), '[|,，;；/\\s]+')], lambda v: v <> '' AND lower(v) NOT IN ('rank', 'nan', 'none', '<na>')))"
_HARD = ["NOT coalesce(regexp_matches(name, 'ST|退'), false)", "coalesce(amount >= 20000, false)", "coalesce(price >= 1000, false)", "coalesce(pe_ratio >= 0, false)", "coalesce(pe_ratio <= 500, false)", "coalesce(turnover_rate >= 1, false)", "coalesce(change_pct <= 9, false)", "coalesce(code % 7 <> 0 AND code % 3 <> 0, false)", "coalesce(signal_score >= 20, false)", "macd_status IN ('bullish', 'neutral')"]
_HARD_NAMES = ["exclude_st", "amount_min", "price_min", "pe_ttm_min", "pe_ttm_max", "turnover_rate_min", "change_pct_max", "require_ma_bullish", "signal_score_min", "macd_status_whitelist"]
_STEP = "CASE " + " ".join(f"WHEN NOT ({x}) THEN {i}" for i, x in enumerate(_HARD, 1)) + " END"
ORACLES = {
    "p1_p3_p4_filters_by_name": f"WITH {tables.SNAPSHOT_SQL} SELECT code, name, price FROM snap WHERE {' AND '.join(_HARD)}",
    "p6_p7_waterfall_samples": f"""WITH {tables.SNAPSHOT_SQL}, g AS (SELECT CAST(code AS VARCHAR) AS code, {_STEP} AS step FROM snap), k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(_HARD_NAMES, 1))}) v(step, rule)),
      w AS (SELECT k.step, rule, count(*) FILTER (g.step IS NULL OR g.step >= k.step) AS before, count(*) FILTER (g.step IS NULL OR g.step > k.step) AS after FROM k, g GROUP BY 1, 2), f AS (SELECT step, code FROM g WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY step ORDER BY code) <= 2)
      SELECT w.step, rule, before, after, before - after AS removed, coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM f WHERE f.step = w.step), '') AS codes FROM w""",
    "f6_f12_daily_penalties": _S + f"""w AS ({iq.ORACLES['w29_daily_features']}), d AS (SELECT b.*, w.* EXCLUDE (code, signal_score, macd_status, rsi_status, date, volume_ratio, change_60d) FROM b JOIN w ON b.code = w.code)
      SELECT code, round(least(100, greatest(0, 78 - least(abs(x), 10) * 3 - greatest(x - 7, 0) * 5 - greatest(t - 10, 0) * 2 - greatest(r - 5, 0) * 4 - CASE WHEN pe_ratio <= 0 THEN 18 ELSE 0 END + (s - 50) * 0.12::DOUBLE - coalesce(greatest(volatility_20d_pct - 300, 0), 0) * 0.45::DOUBLE - coalesce(greatest(-12 - max_drawdown_20d_pct, 0), 0) * 1.2::DOUBLE - coalesce(greatest(atr_20_pct - 20, 0), 0) * 2
        - greatest(80 - daily_quality_score, 0) * 0.35::DOUBLE - CASE WHEN regexp_matches(daily_quality_flags, 'invalid_ohlc|non_positive_price|negative_volume|stale_cache') THEN 8 ELSE 0 END)), 6) AS stability_score, round({_DAILY_RISK}, 6) AS risk_points,
        concat_ws(',', """ + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond, _ in _RULES) + f", CASE WHEN daily_quality_score < {scr.RISK_PROFILE['low_daily_quality_score']}::DOUBLE THEN 'low_daily_quality' END) AS risk_flags FROM d",
    "f8_f9_theme_topics": f"""WITH {tables.SNAPSHOT_SQL}, h AS (SELECT code, industry, concepts, CASE WHEN code % 6 <> 0 THEN CAST(code * 13 % 100 AS DOUBLE) END AS heat, code * 7 % 41 - 20 AS trend, code % 4 AS obs, code * 3 % 101 AS pers, code % 23 AS cool, CASE code % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'ASIA:80|Rank:1' WHEN 2 THEN industry || ':70/EUROPE:60' ELSE 'AFRICA；NATION_3，other' END AS hot FROM snap),
      a AS (SELECT *, coalesce(heat, 50) + CASE WHEN obs >= 2 THEN least(greatest(trend, 0) * 0.8::DOUBLE, 10) - least(greatest(-trend, 0) * 0.8::DOUBLE, 12) ELSE 0 END + least(greatest(pers - 60, 0) * 0.08::DOUBLE, 6) - least(cool * 0.6::DOUBLE, 10) AS z, list_concat({_TOPICS('industry')}, {_TOPICS('concepts')}) AS mine, {_TOPICS('hot')} AS theirs FROM h),
      b AS (SELECT *, least(100, greatest(0, z - greatest(z - 88, 0) * 0.5::DOUBLE)) AS th, least(100, greatest(0, CASE WHEN len(mine) = 0 OR len(theirs) = 0 THEN 50 WHEN list_has_any(mine, theirs) THEN 75 + coalesce(greatest(heat - 50, 0), 0) * 0.25::DOUBLE ELSE 38 END)) AS ta FROM a)
      SELECT code, round(th, 6) AS theme_heat_score, round(ta, 6) AS topic_alignment_score, round(th / 2 + ta / 2, 6) AS screen_score FROM b""",
    "p1_hard_filters": f"WITH {tables.SNAPSHOT_SQL} SELECT code, name, price, pe_ratio FROM snap WHERE {' AND '.join(_RULES_SQL)}",
    "p6_filter_waterfall": f"WITH {tables.SNAPSHOT_SQL}, n AS (SELECT {', '.join(_N)} FROM snap), u AS (" + " UNION ALL ".join(f"SELECT {i} AS step, '{r}' AS rule, CAST(n{i - 1} AS BIGINT) AS before, CAST(n{i} AS BIGINT) AS after FROM n" for i, r in enumerate(RULE_NAMES, 1)) + ") SELECT step, rule, before, after, before - after AS removed, round(CASE WHEN before > 0 THEN (before - after) / before * 100 ELSE 0 END, 6) AS removed_pct FROM u",
    "f1_f7_factor_scores": _F + " SELECT code, " + ", ".join(f"round({f}_score, 6) AS {f}_score" for f in SNAPSHOT_FACTORS) + " FROM f",
    "f10_r2_r3_candidates": _SC + " SELECT code, round(screen_score, 6) AS screen_score, round(value_score, 6) AS value_score FROM g ORDER BY g.screen_score DESC, momentum_score DESC, g.value_score DESC, activity_score DESC, liquidity_score DESC, size_score DESC, stability_score DESC, code LIMIT 20",
    "f12_risk": f"WITH {tables.SNAPSHOT_SQL} SELECT code, {_RISK} AS risk_points, concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond, _ in _RULES) + f") AS risk_flags, CASE WHEN {_RISK} >= 7.92 THEN 'high' WHEN {_RISK} >= 3.96 THEN 'medium' ELSE 'low' END AS risk_level FROM snap",
    "f13_concentration": _SC + ", h AS (SELECT *, CAST(least(greatest(row_number() OVER (PARTITION BY concepts ORDER BY screen_score DESC, code) - 1, 0) * 4, 12) AS DOUBLE) AS penalty FROM g) SELECT code, concepts, penalty, round(screen_score - penalty, 6) AS final_score FROM h",
    "f17_f19_board_heat": f"WITH {tables.SNAPSHOT_SQL}, h AS (SELECT industry, avg(change_pct) AS ch, avg(code) AS rk FROM snap GROUP BY 1) SELECT industry, round(least(100, greatest(0, 50 + ch * 6 + greatest(0, 12 - least(rk, 12)))), 6) AS heat, CASE WHEN ch >= 3 THEN 'accelerating' WHEN ch > 0 THEN 'warming' ELSE 'cooling' END AS phase FROM h",
    "f20_name_match": "WITH x AS (SELECT n_nationkey, list_distinct(string_split(n_name, '')) AS a, list_distinct(string_split('NATION_7', '')) AS b FROM nation) SELECT n_nationkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM x",
    "r1_percentile_rank": f"WITH {tables.BARS_SQL} SELECT code, date, round({_pct('close', False, 50, 'date')}, 6) AS score FROM bars",
    "r5_seeded_rotation": _SC + """, o AS (SELECT code, concepts, screen_score AS s, row_number() OVER (PARTITION BY concepts ORDER BY screen_score DESC, code) AS nth, count(*) OVER (PARTITION BY concepts) AS n FROM g), t AS (SELECT *, least(n, 6) AS k FROM o),
      x AS (SELECT t.*, z.s AS cut FROM t JOIN t z ON z.concepts = t.concepts AND z.nth = z.k), bt AS (SELECT concepts, count(*) FILTER (nth <= k AND s > cut + 1.5::DOUBLE) AS q FROM x GROUP BY 1),
      y AS (SELECT *, least(k - q, greatest(1, k // 2)) AS op FROM x JOIN bt USING (concepts)), p AS (SELECT *, nth > k - op AND s >= cut - 1.5::DOUBLE AS pooled FROM y),
      d AS (SELECT *, count(*) FILTER (pooled) OVER (PARTITION BY concepts) AS size, row_number() OVER (PARTITION BY concepts, pooled ORDER BY sha256('s1' || chr(0) || '2024-01' || chr(0) || CAST(code AS VARCHAR))) AS turn FROM p)
      SELECT code, concepts, CAST(row_number() OVER (PARTITION BY concepts ORDER BY nth) AS INTEGER) AS place FROM d WHERE CASE WHEN k >= 2 AND n > k AND size > op THEN nth <= k - op OR (pooled AND turn <= op) ELSE nth <= k END""",
}
