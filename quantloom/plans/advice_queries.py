"""Queries of advice in words and of structured signals, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded
from quantloom.operators import advice as ad
from quantloom.sources import tables

c = F.col
#: What is said, and what it expects: read by hand, so that the SQL needs no words.
SAID = (
    ("建议买入", "up"), ("Strong Buy", "up"), ("address the risk", "flat"), ("卖出", "down"), ("reduce, then buy", "down"), ("继续持有", "not_down"), ("震荡观望", "not_down"), ("Hold and watch", "not_down"), ("wait for a dip then buy", "flat"),
    ("先观望再买入", "flat"), ("do not sell", "flat"), ("不要卖出", "flat"), ("不建议买入", "flat"), ("never, buy", "up"), ("不跌破支撑继续持有", "not_down"), ("do not buy; hold", "not_down"), ("no reason at all to sell", "down"), ("  ADD  ", "up"),
)


def _history(s: SparkSession, d: str) -> DataFrame:
    """Events as advice, given the day after; two of three name a stop, three of four a target."""
    k = c("event_id")
    said = F.element_at(F.array(*[F.lit(x) for x, _ in SAID]), (k % len(SAID) + 1).cast("int"))
    prices = [F.when(k % 3 != 0, c("value") * 0.8).alias("stop_loss"), F.when(k % 4 != 0, c("value") * 1.2).alias("take_profit")]
    return tables.table(s, d, "events").select(k.alias("id"), c("user_id").alias("code"), F.date_add(F.to_date("ts"), 1).alias("date"), said.alias("advice"), *prices)


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    return ad.evaluate_advice(_history(s, d), tables.event_bars(s, d), 4)


def b3_advice_direction(s: SparkSession, d: str) -> DataFrame:
    return ad.with_direction(_history(s, d)).select("id", "expects", "position")


def b1_b2_advice_evaluations(s: SparkSession, d: str) -> DataFrame:
    out = rounded(_evaluated(s, d).select("id", "status", "expects", "return_pct", "outcome", "first_hit", "hit_days", "hit_stop", "hit_target", "exit_price", "exit_reason", "simulated_pct"))
    return out.withColumns({x: c(x) + 0.0 for x in ("return_pct", "simulated_pct")})  # no negative zero


def a1_a3_a4_advice_summaries(s: SparkSession, d: str) -> DataFrame:
    told = lambda x: F.array_join(F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return ad.advice_summaries(_evaluated(s, d)).withColumns({x: told(x) for x in ("by_status", "by_first_hit")})


def b4_signal_outcomes(s: SparkSession, d: str) -> DataFrame:
    expects = F.element_at(F.array(F.lit("up"), F.lit("not_down"), F.lit("not_up")), (c("id") % 3 + 1).cast("int"))
    out = ad.evaluate_signals(_history(s, d).select("id", "code", "date", expects.alias("expects")), tables.event_bars(s, d), 4)
    return rounded(out.select("id", "status", "unable_reason", "return_pct", "outcome", "max_high", "min_low"))


QUERIES = {
    "b3_advice_direction": b3_advice_direction,
    "b1_b2_advice_evaluations": b1_b2_advice_evaluations,
    "a1_a3_a4_advice_summaries": a1_a3_a4_advice_summaries,
    "b4_signal_outcomes": b4_signal_outcomes,
}

_CASE = " ".join(f"WHEN {i} THEN '{e}'" for i, (_, e) in enumerate(SAID))
_H = f"""WITH {tables.EVENTS_SQL}, h AS (SELECT event_id AS id, user_id AS code, CAST(ts AS DATE) + 1 AS date, CASE event_id % {len(SAID)} {_CASE} END AS expects, CASE WHEN event_id % 3 <> 0 THEN value * 0.8::DOUBLE END AS sl, CASE WHEN event_id % 4 <> 0 THEN value * 1.2::DOUBLE END AS tp FROM events),
fw AS (SELECT code, date, close AS st, list({{'h': high, 'l': low, 'c': close}}) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS a FROM ebars),
j AS (SELECT h.*, expects IN ('up', 'not_down') AS lg, st, coalesce(a, []) AS a FROM h ASOF LEFT JOIN fw f ON h.code = f.code AND h.date >= f.date),
k AS (SELECT *, CASE WHEN NOT coalesce(st > 0, false) THEN 'error' WHEN len(a) < 4 THEN 'insufficient_data' ELSE 'completed' END AS status FROM j),
e AS (SELECT *, status = 'completed' AS done, a[4].c AS ec, list_position([x.l <= sl FOR x IN a], true) AS s0, list_position([x.h >= tp FOR x IN a], true) AS t0 FROM k),
f AS (SELECT *, CASE WHEN done AND lg AND s0 > 0 THEN s0 END AS s, CASE WHEN done AND lg AND t0 > 0 THEN t0 END AS t, CASE WHEN done THEN (ec - st) / st * 100 END AS r FROM e),
g AS (SELECT *, CASE WHEN NOT done THEN NULL WHEN NOT lg THEN 'not_applicable' WHEN s = t THEN 'ambiguous' WHEN s IS NOT NULL AND (t IS NULL OR s < t) THEN 'stop_loss' WHEN t IS NOT NULL THEN 'take_profit' ELSE 'neither' END AS fh,
  CASE WHEN NOT done THEN NULL WHEN expects = 'up' THEN CASE WHEN r >= 2 THEN 'win' WHEN r <= -2 THEN 'loss' ELSE 'neutral' END WHEN expects = 'down' THEN CASE WHEN r <= -2 THEN 'win' WHEN r >= 2 THEN 'loss' ELSE 'neutral' END
    WHEN expects = 'not_down' THEN CASE WHEN r >= 0 THEN 'win' WHEN r <= -2 THEN 'loss' ELSE 'neutral' END ELSE CASE WHEN abs(r) <= 2 THEN 'win' ELSE 'loss' END END AS outcome FROM f),
v AS (SELECT *, CASE WHEN done AND lg AND sl IS NOT NULL THEN fh IN ('stop_loss', 'ambiguous') END AS hs, CASE WHEN done AND lg AND tp IS NOT NULL THEN fh IN ('take_profit', 'ambiguous') END AS ht, CASE WHEN done AND lg THEN CASE WHEN fh IN ('stop_loss', 'ambiguous') THEN sl WHEN fh = 'take_profit' THEN tp ELSE ec END END AS ep FROM g),
w AS (SELECT *, CASE WHEN done AND NOT lg THEN 0 WHEN done THEN (ep - st) / st * 100 END AS sim, CASE WHEN fh IN ('stop_loss', 'take_profit', 'ambiguous') THEN least(s, t) END AS days FROM v)"""


def _n(x: str) -> str:
    return f"count(*) FILTER ({x})"


def _pct(part: str, whole: str) -> str:
    return f"round(CASE WHEN {_n(whole)} > 0 THEN count(*) FILTER (({whole}) AND {part}) / {_n(whole)} * 100 END, 2)"


def _tally(x: str, names: tuple[str, ...]) -> str:
    each = ", ".join(f"CASE WHEN {_n(f'{x} = $q{v}$q')} > 0 THEN '{v}:' || {_n(f'{x} = $q{v}$q')} END" for v in names).replace("$q", "'")
    return f"array_to_string(list_filter([{each}], lambda y: y IS NOT NULL), ',')"


_SETTLED = "outcome IN ('win', 'loss')"
_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{x}') AS {x}_count" for x in ("win", "loss", "neutral"))
ORACLES = {
    "b3_advice_direction": _H + " SELECT id, expects, CASE WHEN lg THEN 'long' ELSE 'cash' END AS position FROM w",
    "b1_b2_advice_evaluations": _H + " SELECT id, status, expects, round(r, 6) + 0 AS return_pct, outcome, fh AS first_hit, days AS hit_days, hs AS hit_stop, ht AS hit_target, round(ep, 6) AS exit_price, CASE fh WHEN 'not_applicable' THEN 'cash' WHEN 'ambiguous' THEN 'ambiguous_stop_loss' WHEN 'neither' THEN 'window_end' ELSE fh END AS exit_reason, round(sim, 6) + 0 AS simulated_pct FROM w",
    "a1_a3_a4_advice_summaries": _H
    + f""" SELECT code, count(*) AS total, {_n("done")} AS completed, {_n("status = 'insufficient_data'")} AS insufficient, {_n("done AND lg")} AS long_count, {_n("done AND NOT lg")} AS cash_count, {_COUNTS},
      {_pct("outcome = 'win'", _SETTLED)} AS direction_accuracy_pct, {_pct("outcome = 'win'", _SETTLED)} AS win_rate_pct, {_pct("outcome = 'neutral'", "done")} AS neutral_rate_pct, round(avg(r), 4) AS avg_return_pct, round(avg(sim), 4) AS avg_simulated_pct,
      {_pct("hs", "hs IS NOT NULL")} AS stop_rate_pct, {_pct("ht", "ht IS NOT NULL")} AS target_rate_pct, {_pct("fh = 'ambiguous'", "hs IS NOT NULL OR ht IS NOT NULL")} AS ambiguous_rate_pct, round(avg(days), 4) AS avg_hit_days,
      {_tally("status", ("completed", "error", "insufficient_data"))} AS by_status, {_tally("fh", ("ambiguous", "neither", "not_applicable", "stop_loss", "take_profit"))} AS by_first_hit FROM w GROUP BY ROLLUP (code)""",
    "b4_signal_outcomes": _H
    + """, y AS (SELECT *, id % 3 AS m, CASE WHEN NOT coalesce(st > 0, false) THEN 'invalid_anchor_price' WHEN len(a) < 4 THEN 'insufficient_forward_bars' WHEN ec IS NULL THEN 'missing_end_close' END AS why FROM w), z AS (SELECT *, CASE WHEN why IS NULL THEN (ec - st) / st * 100 END AS q FROM y)
      SELECT id, CASE WHEN why IS NULL THEN 'completed' ELSE 'unable' END AS status, why AS unable_reason, round(q, 6) AS return_pct, CASE WHEN q IS NULL THEN NULL WHEN m = 0 THEN CASE WHEN q >= 2 THEN 'hit' WHEN q <= -2 THEN 'miss' ELSE 'neutral' END WHEN m = 1 THEN CASE WHEN q >= 0 THEN 'hit' WHEN q <= -2 THEN 'miss' ELSE 'neutral' END ELSE CASE WHEN q <= 2 THEN 'hit' ELSE 'miss' END END AS outcome,
      CASE WHEN len(a) >= 4 THEN round(list_max([x.h FOR x IN a]), 6) END AS max_high, CASE WHEN len(a) >= 4 THEN round(list_min([x.l FOR x IN a]), 6) END AS min_low FROM z""",
}
