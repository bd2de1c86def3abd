"""Ledger replay against a plain fold, and cases worked by hand."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.functions.scans import affine
from quantloom.operators import ledger

D = dt.date
TRADES = "account long, id long, date date, symbol string, market string, currency string, side string, quantity double, price double, fee double, tax double"
ACTIONS = "account long, id long, date date, symbol string, market string, currency string, action string, ratio double, per_share double"
CASH = "account long, id long, date date, currency string, direction string, amount double"
RATES = "source string, target string, date date, rate double, stale boolean"


def _tables(spark, trades=(), actions=(), cash=()):
    return spark.createDataFrame(list(trades), TRADES), spark.createDataFrame(list(actions), ACTIONS), spark.createDataFrame(list(cash), CASH)


def _day(n):
    return D(2024, 1, 1) + dt.timedelta(days=n)


def _random_ledger(seed: int, accounts: int, n: int):
    r = random.Random(seed)
    trades, actions, cash, held = [], [], [], defaultdict(float)
    for i in range(n):
        a = 0 if r.random() < 0.4 else r.randrange(accounts)  # one account has many of the rows
        s, day = r.choice(["AA", "BB"]), _day(i // 4)
        what = r.random()
        if what < 0.06:
            ratio = r.choice([2.0, 0.5, 3.0, 1.0])
            actions.append((a, i, day, s, "us", "USD", "split_adjustment", ratio, None))
        elif what < 0.12:
            actions.append((a, i, day, s, "us", "USD", "cash_dividend", None, r.choice([0.25, 0.0])))
        elif what < 0.2:
            cash.append((a, i, day, "USD", r.choice(["in", "out"]), float(r.randint(1, 500))))
        else:
            trades.append([a, i, day, s, "us", "USD", None, float(r.randint(1, 40)), r.randint(100, 900) / 10, 1.0, 0.5])
    # Sides follow from what is held in the order of replay, so that nothing is oversold.
    for _, _, _, row in _ordered(trades, actions, []):
        k = (row[0], row[3])
        if len(row) == 9:
            held[k] *= row[7] if row[6] == "split_adjustment" else 1
        elif held[k] >= row[7] and r.random() < 0.6:
            row[6], row[7] = "sell", held[k] if r.random() < 0.15 else row[7]
            held[k] -= row[7]
        else:
            row[6] = "buy"
            held[k] += row[7]
    return [tuple(t) for t in trades], actions, cash


def _ordered(trades, actions, cash):
    rows = [(c[2], 0, c[1], c) for c in cash] + [(a[2], 1, a[1], a) for a in actions] + [(t[2], 2, t[1], t) for t in trades]
    return sorted(rows, key=lambda x: x[:3])


def _fold(trades, actions, cash, method):
    lots, money, gains = defaultdict(list), defaultdict(float), {}
    for _, kind, _, row in _ordered(trades, actions, cash):
        if kind == 0:
            money[row[0]] += row[5] if row[4] == "in" else -row[5]
            continue
        mine = lots[row[0], row[3]]
        if kind == 1:
            if row[6] == "cash_dividend":
                money[row[0]] += sum(q for q, _ in mine) * row[8]
            else:
                mine[:] = [(q * row[7], u / row[7]) for q, u in mine]
            continue
        account, number, _, symbol, _, _, side, q, price, fee, tax = row
        if side == "buy":
            mine.append((q, (q * price + fee + tax) / q))
            money[account] -= q * price + fee + tax
        else:
            money[account] += q * price - fee - tax
            basis, left = 0.0, q
            if method == "average" and mine:
                total = sum(a for a, _ in mine)
                mine[:] = [(total, sum(a * u for a, u in mine) / total)]
            while left > 1e-8:
                a, u = mine[0]
                take = min(a, left)
                basis, left = basis + take * u, left - take
                mine[:1] = [(a - take, u)] if a - take > 1e-8 else []
            gains[account, number] = q * price - fee - tax - basis
    held = {k: (sum(q for q, _ in v), sum(q * u for q, u in v)) for k, v in lots.items() if sum(q for q, _ in v) > 1e-8}
    return held, money, gains


@pytest.mark.parametrize("method", ["fifo", "average"])
@pytest.mark.parametrize("rows", [200_000, 37])
def test_replay_same_as_fold(spark, method, rows):
    data = _random_ledger(5, 6, 700)
    positions, sales, cash, accounts = ledger.replay(*_tables(spark, *data), method=method, rows=rows)
    held, money, gains = _fold(*data, method)
    assert {(r["account"], r["symbol"]): (pytest.approx(r["quantity"]), pytest.approx(r["total_cost"])) for r in positions.collect()} == held
    assert {r["account"]: pytest.approx(r["balance"]) for r in cash.collect()} == dict(money)
    assert {(r["account"], r["id"]): pytest.approx(r["realized"], abs=1e-6) for r in sales.collect()} == gains
    assert {r["status"] for r in accounts.collect()} == {"ok"}


def test_split_dividend_and_sale_by_hand(spark):
    """100 at 10 (cost 1000), split 2 for 1, dividend of 0.5 on 200, sale of 50 at 8: basis 50 * 5."""
    t, a, m = _tables(
        spark,
        [(1, 1, _day(0), " aapl", "US", "usd", "BUY", 100.0, 10.0, 0.0, 0.0), (1, 2, _day(3), "AAPL", "us", "USD", "sell", 50.0, 8.0, 1.0, 1.0)],
        [(1, 1, _day(1), "AAPL", "us", "USD", "split_adjustment", 2.0, None), (1, 2, _day(2), "AAPL", "us", "USD", "cash_dividend", None, 0.5)],
        [(1, 1, _day(0), "usd", "in", 5000.0)],
    )
    for method in ("fifo", "average"):
        positions, sales, cash, accounts = ledger.replay(t, a, m, method=method)
        (p,), (s,), (c,) = positions.collect(), sales.collect(), cash.collect()
        assert (p["symbol"], p["market"], p["currency"], p["quantity"], p["total_cost"], p["avg_cost"]) == ("AAPL", "us", "USD", 150, 750, 5)
        assert (s["proceeds"], s["basis"], s["realized"]) == (398, 250, 148) and c["balance"] == 5000 - 1000 + 100 + 398
        assert accounts.first()["status"] == "ok"
    before = ledger.replay(t, a, m, as_of=F.lit(_day(1)))[0].first()
    assert (before["quantity"], before["avg_cost"]) == (200, 5)


def test_same_day_action_comes_before_trade(spark):
    t, a, _ = _tables(spark, [(1, 1, _day(0), "X", "us", "USD", "buy", 10.0, 1.0, 0.0, 0.0), (1, 2, _day(1), "X", "us", "USD", "sell", 20.0, 1.0, 0.0, 0.0)], [(1, 9, _day(1), "X", "us", "USD", "split_adjustment", 2.0, None)])
    r = ledger.available_quantity(t, a, F.lit(_day(1))).first()
    assert (r["quantity"], r["problem"]) == (0, None)


@pytest.mark.parametrize("rows", [200_000, 1])
def test_problems_are_told_by_the_first(spark, rows):
    bad = [
        (1, 1, _day(0), "X", "us", "USD", "buy", 10.0, 1.0, 0.0, 0.0), (1, 2, _day(1), "X", "us", "USD", "sell", 10.5, 1.0, 0.0, 0.0),
        (2, 3, _day(0), "X", "us", "USD", "short", 10.0, 1.0, 0.0, 0.0), (3, 4, _day(0), "X", "us", "USD", "buy", 0.0, 1.0, 0.0, 0.0),
        (4, 5, _day(0), "X", "us", "USD", "buy", 10.0, 1.0, 0.0, 0.0), (5, 6, _day(0), "X", "us", "USD", "buy", 3.0, 1.0, None, None), (5, 7, _day(0), "X", "us", "USD", "sell", 3.0, 1.0, None, None),
    ]
    t, a, m = _tables(spark, bad, [(4, 1, _day(1), "X", "us", "USD", "split_adjustment", 0.0, None), (6, 2, _day(1), "X", "us", "USD", "merger", 2.0, None)], [(7, 1, _day(0), "USD", "sideways", 1.0)])
    got = {r["account"]: r["status"] for r in ledger.replay(t, a, m, rows=rows)[3].collect()}
    assert got == {1: "oversell", 2: "unsupported_side", 3: "invalid_trade", 4: "invalid_split", 5: "ok", 6: "unsupported_action", 7: "unsupported_direction"}


def test_empty_ledger(spark):
    positions, sales, cash, accounts = ledger.replay(*_tables(spark))
    assert positions.count() == sales.count() == cash.count() == accounts.count() == 0


def test_conversion_direct_inverse_and_stale(spark):
    rates = spark.createDataFrame([("USD", "CNY", _day(0), 7.0, False), ("USD", "CNY", _day(9), 8.0, True), ("CNY", "HKD", _day(0), 2.0, False), ("EUR", "CNY", _day(5), 0.0, False)], RATES)
    rows = spark.createDataFrame([("USD", "CNY", _day(3), 10.0), ("USD", "CNY", _day(9), 10.0), ("HKD", "CNY", _day(3), 10.0), ("EUR", "CNY", _day(6), 10.0), ("CNY", "CNY", _day(3), 10.0), ("GBP", "CNY", _day(3), 0.0)], "currency string, base string, date date, v double")
    got = {(r["currency"], r["date"]): (r["v_base"], r["fx_stale"]) for r in ledger.converted(rows, rates, ["v"], at="date").collect()}
    assert got == {("USD", _day(3)): (70, False), ("USD", _day(9)): (80, True), ("HKD", _day(3)): (5, False), ("EUR", _day(6)): (10, True), ("CNY", _day(3)): (10, False), ("GBP", _day(3)): (0, False)}
    last = {r["currency"]: (r["v_base"], r["fx_stale"]) for r in ledger.converted(rows.where("currency in ('USD', 'HKD')"), rates, ["v"]).collect()}
    assert last == {"USD": (80, True), "HKD": (5, False)}


def test_valuation_and_account_totals(spark):
    t, a, m = _tables(spark, [(1, 1, _day(0), "X", "us", "USD", "buy", 10.0, 5.0, 1.0, 0.0), (1, 2, _day(2), "X", "us", "USD", "sell", 5.0, 6.0, 0.0, 1.0), (1, 3, _day(0), "Y", "us", "USD", "buy", 1.0, 5.0, 0.0, 0.0)], (), [(1, 1, _day(0), "CNY", "in", 100.0)])
    accounts = spark.createDataFrame([(1, "CNY"), (2, "USD")], "account long, base string")
    prices = spark.createDataFrame([("X", _day(0), 5.0), ("X", _day(3), 8.0), ("Y", _day(1), 0.0)], "symbol string, date date, close double")
    rates = spark.createDataFrame([("USD", "CNY", _day(0), 7.0, False)], RATES)
    positions, sales, cash, _ = ledger.replay(t, a, m)
    v = ledger.valued(positions, accounts, prices, rates)
    by = {r["symbol"]: r for r in v.collect()}
    assert by["X"]["value_base"] == pytest.approx(280) and by["X"]["cost_base"] == pytest.approx(5 * 5.1 * 7) and by["X"]["unrealized_pct"] == pytest.approx((40 / 25.5 - 1) * 100)
    assert (by["Y"]["price_available"], by["Y"]["value_base"], by["Y"]["unrealized_pct"]) == (False, 0, None)
    total = {r["account"]: r for r in ledger.account_totals(accounts, v, sales, cash, t, rates).collect()}
    one = total[1]
    assert one["cash"] == pytest.approx(100 + 7 * (-51 + 29 - 5)) and one["equity"] == pytest.approx(one["cash"] + 280)
    assert (one["realized"], one["fees"], one["taxes"], one["fx_stale"]) == (pytest.approx(7 * (29 - 25.5)), pytest.approx(7), pytest.approx(7), False)
    assert tuple(total[2])[2:] == (0, 0, 0, 0, 0, 0, 0, False)


def test_days_without_snapshot_and_their_equity(spark):
    t, a, m = _tables(spark, [(1, 1, _day(1), "X", "us", "USD", "buy", 10.0, 5.0, 0.0, 0.0)], [(1, 2, _day(3), "X", "us", "USD", "split_adjustment", 2.0, None)], [(1, 1, _day(0), "USD", "in", 100.0)])
    prices = spark.createDataFrame([("X", _day(1), 5.0), ("X", _day(3), 3.0)], "symbol string, date date, close double")
    activity = t.select("account", "date").union(a.select("account", "date")).union(m.select("account", "date"))
    snapshots = spark.createDataFrame([(1, _day(2))], "account long, date date")
    days = ledger.missing_days(activity, snapshots, F.lit(_day(4)), 30)
    assert sorted(r["date"] for r in days.collect()) == [_day(0), _day(1), _day(3), _day(4)]
    assert sorted(r["date"] for r in ledger.missing_days(activity, snapshots, F.lit(_day(4)), 1).collect()) == [_day(3), _day(4)]
    got = {r["date"]: (r["cash"], r["market_value"]) for r in ledger.daily_equity(days, t, a, m, prices).collect()}
    assert got == {_day(0): (100, 0), _day(1): (50, 50), _day(3): (50, 60), _day(4): (50, 60)}


@pytest.mark.parametrize("chunk", [2, 3, 128])
def test_affine_recurrence(spark, chunk):
    r = random.Random(chunk)
    rows = [(k, i, r.choice([0.0, 0.5, 1.0, 0.9]), r.random()) for k in range(3) for i in range([1, 20, 57][k])]
    got = affine(spark.createDataFrame(rows, "k long, i long, f double, a double"), ["k"], ["i"], "f", "a", "before", "after", chunk=chunk).collect()
    want, value = {}, defaultdict(float)
    for k, i, f, a in rows:
        want[k, i] = (value[k], f * value[k] + a)
        value[k] = want[k, i][1]
    assert {(x["k"], x["i"]): (pytest.approx(x["before"]), pytest.approx(x["after"])) for x in got} == want


@pytest.mark.parametrize("rows", [4, 1000])
def test_whole_positions_are_dealt_out_once(spark, rows):
    """Positions of few rows each need one shuffle, however many rows there are; results don't depend on it."""
    trades, actions, _ = _tables(spark, [(a, i, _day(0), "S", "us", "USD", "sell" if i == 3 else "buy", float(i), 10.0, 0.0, 0.0) for a in range(6) for i in (1, 2, 3)])
    states = ledger.position_states(ledger.ledger_events(trades, actions), rows)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" not in plan
    assert sorted((r.account, r.id, r.held, r["__last"]) for r in states.collect()) == [(a, i, h, i == 3) for a in range(6) for i, h in ((1, 1.0), (2, 3.0), (3, 0.0))]
