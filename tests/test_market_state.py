"""Market days worked by hand: who counts and why, limits, streaks, scores and regimes."""

import datetime as dt

import pytest

from quantloom.operators import market_state as ms

START = dt.date(2026, 1, 1)
KEYS = ["sh600001", "sz000001", "sz300001"]
BAR = "entity string, date date, trading_status string, open double, high double, low double, close double, prev_close double, price_limit_up double, price_limit_down double, volume double, amount double"


def _day(i):
    return START + dt.timedelta(days=i)


def _market(spark, closes, *, bars=None, status=None, listing=None, master=None, open_days=None):
    """closes: for each day the three closes; everything else as on a plain day, changed by the arguments."""
    n = len(closes)
    rows = {(k, i): [k, _day(i), "TRADED", 10.0, 11.0, 9.0, float(closes[i][j]), 10.0, 11.0, 9.0, 100.0, (j + 1) * 100.0] for i in range(n) for j, k in enumerate(KEYS)}
    for at, change in (bars or {}).items():
        if change is None:
            del rows[at]
        else:
            for column, v in change.items():
                rows[at][[x.split()[0] for x in BAR.split(", ")].index(column)] = v
    told = {(k, i): (k, _day(i), "ACTIVE", True) for i in range(n) for k in KEYS}
    told |= {at: (at[0], _day(at[1]), *v) for at, v in (status or {}).items() if v}
    told = [v for at, v in told.items() if (status or {}).get(at, True) is not None]
    listing = listing if listing is not None else [(k, dt.date(2020, 1, 1), None, "LISTED") for k in KEYS]
    master = master if master is not None else [(k, "stock", k[:2].upper(), "MAIN", dt.date(2020, 1, 1), None) for k in KEYS]
    frame = spark.createDataFrame
    return dict(
        calendar=frame([(_day(i), (open_days or [True] * n)[i]) for i in range(n)], "trade_date date, is_open boolean"),
        master=frame(master, "entity string, asset_type string, exchange string, board string, list_date date, delist_date date"),
        listing=frame(listing, "entity string, effective_from date, effective_to date, listing_status string"),
        status=frame(told, "entity string, date date, instrument_status string, is_tradable boolean"),
        bars=frame([tuple(r) for r in rows.values()], BAR),
    )


def _metrics(spark, market, index=()):
    days = ms.raw_metrics(ms.freeze_universe(**market), spark.createDataFrame(list(index), "date date, close double"))
    return [r.asDict() for r in days.orderBy("date").collect()]


def test_one_day(spark):
    (m,) = _metrics(spark, _market(spark, [("10", "11", "9")]))
    assert (m["listed_count"], m["limit_up_count"], m["limit_down_count"], m["limit_break_count"]) == (3, 1, 1, 2)
    assert (m["limit_break_rate"], m["market_amount_cny"], m["median_amplitude"]) == (pytest.approx(2 / 3), 600, pytest.approx(0.2))
    assert (m["max_streak_height"], m["promotion_rate"], m["net_advance_ratio"], m["flags"]) == (None, None, None, ["HISTORY_GAP"])
    assert m["top20_amount_concentration"] == 1 and m["zero_or_suspended_ratio"] == 0


def test_each_metric_has_its_own_denominator(spark):
    (m,) = _metrics(spark, _market(spark, [("10", "11", "9")], bars={("sh600001", 0): {"price_limit_up": None}}))
    assert (m["listed_count"], m["bar_valid_count"], m["limit_rule_count"], m["limit_break_count"], m["limit_break_rate"]) == (3, 3, 2, 1, 0.5)


def test_nothing_is_guessed(spark):
    none = {(k, 0): {"price_limit_up": None, "price_limit_down": None} for k in KEYS}
    (m,) = _metrics(spark, _market(spark, [("10", "11", "9")], bars=none, status={(k, 0): None for k in KEYS}))
    assert all(m[x] is None for x in ("limit_up_down_spread", "limit_break_rate", "max_streak_height", "streak_stock_count", "zero_or_suspended_ratio", "median_amplitude", "limit_up_count"))


def test_streaks_promotion_and_amounts_over_open_days(spark):
    closes = [("10", "10", "10")] + [("11", "10", "10")] * 20
    m = _metrics(spark, _market(spark, closes))
    assert [x["max_streak_height"] for x in m[:4]] == [0, 1, 2, 3] and [x["promotion_rate"] for x in m[:5]] == [None, None, None, 1, 1]
    assert (m[19]["amount_ratio_20"], m[20]["amount_ratio_20"], m[20]["streak_stock_count"]) == (None, 1, 1)
    assert (m[1]["net_advance_ratio"], m[2]["net_advance_ratio"], m[1]["prior_limit_up_premium"], m[2]["prior_limit_up_premium"]) == (pytest.approx(1 / 3), 0, None, 0)


def test_streak_with_a_gap_is_unknown_and_one_from_listing_is_not(spark):
    closes = [("11", "10", "10")] * 4
    m = _metrics(spark, _market(spark, closes, bars={("sh600001", 1): None}))
    assert [x["max_streak_height"] for x in m] == [None, 0, None, None] and "HISTORY_GAP" in m[3]["flags"] and "SCOPE_SLA_FAILED" in m[1]["flags"]
    first = [("sh600001", "stock", "SH", "MAIN", _day(1), None), *[(k, "stock", "SZ", "MAIN", dt.date(2020, 1, 1), None) for k in KEYS[1:]]]
    listing = [("sh600001", dt.date(2020, 1, 1), _day(1), "NOT_LISTED"), ("sh600001", _day(1), None, "LISTED"), *[(k, dt.date(2020, 1, 1), None, "LISTED") for k in KEYS[1:]]]
    m = _metrics(spark, _market(spark, closes, master=first, listing=listing, status={("sh600001", 0): ("NOT_LISTED", False)}))
    assert [(x["listed_count"], x["max_streak_height"]) for x in m] == [(2, 0), (3, 1), (3, 2), (3, 3)]


def test_closed_days_are_no_observations(spark):
    m = _metrics(spark, _market(spark, [("10", "10", "10"), ("11", "10", "10"), ("10", "10", "10"), ("11", "10", "10")], open_days=[True, True, False, True]))
    assert [x["date"] for x in m] == [_day(0), _day(1), _day(3)] and m[2]["max_streak_height"] == 2


def test_reasons_and_pools(spark):
    market = _market(
        spark, [("10", "11", "9")],
        status={("sh600001", 0): ("SUSPENDED", False), ("sz000001", 0): None, ("sz300001", 0): ("ST", True)}, bars={("sh600001", 0): {"trading_status": "SUSPENDED", "close": None}, ("sz000001", 0): {"high": 10.5}},
        master=[*[(k, "stock", k[:2].upper(), "MAIN", START if k == "sz300001" else dt.date(2020, 1, 1), None) for k in KEYS], ("bj1", "stock", "BJ", "MAIN", dt.date(2020, 1, 1), None), ("fund", "fund", "SH", "MAIN", dt.date(2020, 1, 1), None)],
    )
    got = {r["entity"]: r for r in ms.freeze_universe(**market).collect()}
    assert set(got) == set(KEYS)
    assert [(got[k]["listed"], got[k]["valid"], got[k]["observable"], got[k]["ruled"], got[k]["reasons"]) for k in KEYS] == [
        (True, True, False, False, ["SUSPENDED"]), (True, False, False, False, ["BAR_UNAVAILABLE", "STATUS_UNKNOWN"]), (True, True, True, True, ["NEW_LISTING", "ST"])]


@pytest.mark.parametrize(
    ("problem", "change"),
    [
        ("listing_interval", {"listing": [(k, dt.date(2020, 1, 1), None, "LISTED") for k in KEYS] + [("sh600001", _day(0), None, "LISTED")]}),
        ("listing_interval", {"listing": [(k, dt.date(2020, 1, 1), None, "LISTED") for k in KEYS[1:]]}),
        ("status_contract", {"status": {("sh600001", 0): ("UNHEARD_OF", True)}}),
        ("status_conflict", {"status": {("sh600001", 0): ("DELISTED", True)}}),
        ("bar_contract", {"bars": {("sh600001", 0): {"trading_status": "HALF"}}}),
    ],
)
def test_a_day_with_a_problem_has_no_metrics(spark, problem, change):
    market = _market(spark, [("10", "11", "9")], **change)
    assert {r["problem"] for r in ms.freeze_universe(**market).collect()} == {problem, None}
    (m,) = _metrics(spark, market)
    assert "SCOPE_INVALID" in m["flags"] and all(m[x] is None for x in ms.METRICS)


def test_index_volatility_and_drawdown(spark):
    index = [(_day(i), 100.0 + (i % 2)) for i in range(22)]
    m = _metrics(spark, _market(spark, [("10", "10", "10")] * 22), index)
    assert m[19]["benchmark_realized_vol_20"] is None and m[20]["benchmark_realized_vol_20"] == pytest.approx(0.16203, rel=1e-3) and m[18]["market_drawdown_20"] is None and m[20]["market_drawdown_20"] == pytest.approx(100 / 101 - 1)


def test_scores_need_sixty_known_days_before(spark):
    days = spark.createDataFrame([(_day(i), float(i) if i != 5 else None, float(i)) for i in range(63)], "date date, median_return double, tail_loss_ratio double")
    got = {r["date"]: r for r in ms.normalized_metrics(days, ["median_return", "tail_loss_ratio"]).collect()}
    assert got[_day(60)]["median_return"] is None and got[_day(61)]["median_return"] > 50 > got[_day(60)]["tail_loss_ratio"] and got[_day(59)]["tail_loss_ratio"] is None and got[_day(5)]["median_return"] is None
    # Sixty values 0 to 59: middle 29.5, deviation 15.
    assert got[_day(60)]["tail_loss_ratio"] == pytest.approx(50 - 30.5 / (1.4826 * 15) * 100 / 6)


def test_missing_scores_are_not_weighted_anew(spark):
    row = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, 50.0), (10.0, 20.0, 30.0, 40.0, None)], "breadth double, limit double, risk_appetite double, liquidity double, safety double")
    assert [r[0] for r in row.select(ms.weighted(ms.TOTAL)).collect()] == [25.5, None]
    with pytest.raises(ValueError, match="100"):
        ms.weighted({"breadth": 99})


def _regimes(spark, scores):
    frame = spark.createDataFrame([(_day(i), x) for i, x in enumerate(scores)], "date date, score double")
    return [tuple(r)[2:] for r in ms.regimes(frame).orderBy("date").collect()]


@pytest.mark.parametrize(("score", "band"), [(0, "PANIC"), (20, "WEAK"), (40, "RANGE"), (60, "ACTIVE"), (80, "OVERHEATED"), (100, "OVERHEATED")])
def test_bands(spark, score, band):
    assert _regimes(spark, [float(score)]) == [(score, band, None, "INITIALIZED")]


def test_smoothing_confirmation_jump_and_gap(spark):
    # Emotion: 58, 60, 61, none, 60, 55, 30.
    got = _regimes(spark, [58.0, 62.0, 62.0, None, 60.0, 50.0, 5.0])
    assert got == [
        (58, "RANGE", None, "INITIALIZED"), (60, "RANGE", None, "NONE"), (61, "ACTIVE", "RANGE", "TWO_DAY_CONFIRM"), (None, None, None, None),
        (60, "ACTIVE", None, "INITIALIZED"), (55, "RANGE", "ACTIVE", "BOUNDARY_JUMP_GE_5"), (30, "WEAK", "RANGE", "BOUNDARY_JUMP_GE_5")]
    assert [x[0] for x in _regimes(spark, [20.0, 60.0, None, 80.0])] == [20, 40, None, 80]


def test_scores_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="outside"):
        _regimes(spark, [101.0])


def test_one_plan_from_bars_to_regime(spark):
    market = _market(spark, [("10", "11", "9")] * 3)
    got = ms.evaluate_market(**market, index=spark.createDataFrame([], "date date, close double")).orderBy("date").collect()
    assert [r["date"] for r in got] == [_day(0), _day(1), _day(2)] and {r["regime"] for r in got} == {None}
    assert ms.evaluate_market(**{**market, "calendar": market["calendar"].limit(0)}, index=spark.createDataFrame([], "date date, close double")).count() == 0
