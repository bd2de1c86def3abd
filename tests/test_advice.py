"""Advice in two languages, outcomes and summaries worked by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import advice

#: Text, what it expects, the position.
PHRASES = [
    ("买入", "up", "long"), ("建议买入", "up", "long"), ("Strong Buy", "up", "long"), ("add on dips", "up", "long"), ("address the risk", "flat", "cash"), ("卖出", "down", "cash"), ("reduce, then buy", "down", "cash"),
    ("继续持有", "not_down", "long"), ("建议洗盘观察", "not_down", "long"), ("震荡观望", "not_down", "long"), ("Range-bound watch", "not_down", "long"), ("Hold and watch", "not_down", "long"), ("观望", "flat", "cash"), ("wait for a dip then buy", "flat", "cash"),
    ("先观望再买入", "flat", "cash"), ("观望后买入", "flat", "cash"), ("买入后观望", "up", "long"), ("do not sell", "flat", "cash"), ("不要卖出", "flat", "cash"), ("not to sell", "flat", "cash"), ("不建议买入", "flat", "cash"), ("never, buy", "up", "long"),
    ("不跌破支撑继续持有", "not_down", "long"), ("do not buy, do not buy", "flat", "cash"), ("do not buy; hold", "not_down", "long"), ("no reason at all to sell", "down", "cash"), ("waiting", "flat", "cash"), ("  BUY  ", "up", "long"), ("", "flat", "cash"), (None, "flat", "cash"),
]


def _day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_directions(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PHRASES)] * 3, "i int, advice string")
    got = {(r["i"], r["expects"], r["position"]) for r in advice.with_direction(rows).collect()}
    assert got == {(i, e, p) for i, (_, e, p) in enumerate(PHRASES)}


def _bars(spark, closes, spread=1.0):
    closes = [None if p is None else float(p) for p in closes]
    rows = [("X", _day(i), p if p is None else p + spread, p if p is None else p - spread, p) for i, p in enumerate(closes)]
    return spark.createDataFrame(rows, "code string, date date, high double, low double, close double")


HISTORY = "id int, code string, date date, advice string, stop_loss double, take_profit double"


def _evaluated(spark, rows, closes, n=3):
    out = advice.evaluate_advice(spark.createDataFrame([(i, "X", *r) for i, r in enumerate(rows)], HISTORY), _bars(spark, closes), n)
    return {r["id"]: r for r in out.collect()}


def test_first_hit_ends_a_long_position(spark):
    got = _evaluated(spark, [(_day(0), "buy", 97.0, 105.0), (_day(0), "buy", 98.5, 101.5), (_day(0), "buy", 90.0, 103.0), (_day(0), "buy", None, None), (_day(0), "sell", 97.0, 105.0), (_day(0), "hold", 90.0, 120.0)], [100, 100, 102, 97, 96])
    told = {i: (r["first_hit"], r["hit_days"], r["exit_price"], r["exit_reason"], r["hit_stop"], r["hit_target"], r["simulated_pct"]) for i, r in got.items()}
    assert told == {
        0: ("stop_loss", 3, 97, "stop_loss", True, False, -3), 1: ("take_profit", 2, 101.5, "take_profit", False, True, 1.5), 2: ("take_profit", 2, 103, "take_profit", False, True, 3), 3: ("neither", None, 97, "window_end", None, None, -3),
        4: ("not_applicable", None, None, "cash", None, None, 0), 5: ("neither", None, 97, "window_end", False, False, -3)}
    assert [(got[i]["outcome"], got[i]["direction_right"]) for i in (0, 4, 5)] == [("loss", False), ("win", True), ("loss", False)]
    both = _evaluated(spark, [(_day(0), "buy", 99.5, 100.5)], [100, 100, 100, 100])[0]
    assert (both["first_hit"], both["exit_price"], both["exit_reason"], both["hit_stop"], both["hit_target"]) == ("ambiguous", 99.5, "ambiguous_stop_loss", True, True)


def test_statuses_and_days_without_a_bar(spark):
    got = _evaluated(spark, [(_day(-1), "buy", None, None), (_day(0), "buy", None, None), (_day(2), "buy", None, None), (dt.date(2025, 1, 1), "buy", None, None)], [100, 101, 102, None])
    assert [(got[i]["status"], got[i]["start"]) for i in range(4)] == [("error", None), ("completed", 100), ("insufficient_data", 102), ("error", None)]
    assert (got[1]["end_close"], got[1]["return_pct"], got[1]["outcome"], got[1]["max_high"]) == (None, None, None, 103)


def test_bands_of_outcomes(spark):
    rows = spark.createDataFrame([(e, x) for e in ("up", "down", "not_down", "flat") for x in (-2.0, -1.9, 0.0, 1.9, 2.0, 2.1)], "e string, x double")
    got = [r[0] for r in rows.select(advice.outcome(F.col("x"), F.col("e"), -2.0)).collect()]
    assert got == ["loss", *["neutral"] * 3, "win", "win", "win", *["neutral"] * 3, "loss", "loss", "loss", "neutral", "win", "win", "win", "win", *["win"] * 5, "loss"]


def test_summaries_use_the_rows_that_apply(spark):
    frame = spark.createDataFrame(
        [
            ("X", "completed", "long", "win", True, 5.0, 4.0, False, True, "take_profit", 2), ("X", "completed", "long", "loss", False, -5.0, -3.0, True, None, "stop_loss", 1), ("X", "completed", "long", "neutral", None, 1.0, 1.0, None, None, "neither", None),
            ("Y", "completed", "cash", "win", True, -4.0, 0.0, None, None, "not_applicable", None), ("Y", "insufficient_data", "long", None, None, None, None, None, None, None, None), ("Y", "error", "cash", None, None, None, None, None, None, None, None),
        ],
        "code string, status string, position string, outcome string, direction_right boolean, return_pct double, simulated_pct double, hit_stop boolean, hit_target boolean, first_hit string, hit_days int",
    )
    got = {r["code"]: r.asDict() for r in advice.advice_summaries(frame).collect()}
    a = got[None]
    assert [a[x] for x in ("total", "completed", "insufficient", "long_count", "cash_count", "win_count", "loss_count", "neutral_count")] == [6, 4, 1, 3, 1, 2, 1, 1]
    assert [a[x] for x in ("direction_accuracy_pct", "win_rate_pct", "neutral_rate_pct", "avg_return_pct", "avg_simulated_pct", "stop_rate_pct", "target_rate_pct", "ambiguous_rate_pct", "avg_hit_days")] == [66.67, 66.67, 25, -0.75, 0.5, 50, 100, 0, 1.5]
    assert a["by_status"] == {"completed": 4, "insufficient_data": 1, "error": 1} and a["by_first_hit"] == {"neither": 1, "stop_loss": 1, "take_profit": 1, "not_applicable": 1}
    assert (got["Y"]["stop_rate_pct"], got["Y"]["avg_hit_days"], got["Y"]["win_rate_pct"]) == (None, None, 100)
    assert advice.advice_summaries(frame.limit(0)).count() == 0


def test_structured_signals(spark):
    bars = _bars(spark, [100, 101, 103, 98, float("nan")])
    rows = [(0, _day(0), "up", 2), (1, _day(0), "up", 1), (2, _day(0), "not_up", 2), (3, _day(2), "not_down", 1), (4, _day(2), "up", 2), (5, _day(3), "up", 5), (6, _day(-5), "up", 1), (7, _day(1), "sideways", 1)]
    got = {}
    for i, d, e, n in rows:
        out = advice.evaluate_signals(spark.createDataFrame([(i, "X", d, e)], "id int, code string, date date, expects string"), bars, n).first()
        got[i] = (out["status"], out["unable_reason"], out["outcome"])
    assert got == {
        0: ("completed", None, "hit"), 1: ("completed", None, "neutral"), 2: ("completed", None, "miss"), 3: ("completed", None, "miss"), 4: ("unable", "invalid_end_close", None), 5: ("unable", "insufficient_forward_bars", None),
        6: ("unable", "invalid_anchor_price", None), 7: ("completed", None, None)}


def test_expiry(spark):
    rows = spark.createDataFrame([(1, "active", _day(1)), (2, "active", _day(3)), (3, "closed", _day(1)), (4, "active", None), (5, "active", _day(2))], "id int, status string, expires_at date")
    assert {r["id"]: r["status"] for r in advice.expire(rows, F.lit(_day(2))).collect()} == {1: "expired", 2: "active", 3: "closed", 4: "active", 5: "expired"}


@pytest.mark.parametrize("n", [0, -1])
def test_windows_have_days(spark, n):
    with pytest.raises(ValueError, match="days"):
        advice.evaluate_advice(spark.createDataFrame([], HISTORY), _bars(spark, [1.0]), n)
