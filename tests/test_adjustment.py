"""Adjustment factors worked by hand, and everything that must fail closed."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quantloom.operators import adjustment

T0, T1, T2 = dt.date(2026, 8, 27), dt.date(2026, 8, 28), dt.date(2026, 8, 31)
EVENTS = "entity string, event_key string, group_id string, role string, revision int, state string, action string, quantity decimal(30,6), denominator decimal(30,6), ex_date date, available_at date, record_date date, payment_date date"


def _event(action="DIVIDEND", quantity="1", key="cash", ex=T1, revision=1, group="plan", role=None, state="ACTIVE", per="1", known=T0, record=None, payment=None, entity="e"):
    number = lambda x: None if x is None else Decimal(x)
    return (entity, key, group, role or key, revision, state, action, number(quantity), number(per), ex, known, record, payment)


def _run(spark, events, closes=("10", "9", "9"), **kw):
    frame = spark.createDataFrame([("e", t, None if p is None else Decimal(p)) for t, p in zip((T0, T1, T2), closes, strict=True)], "entity string, date date, close decimal(20,6)")
    return adjustment.adjustment_factors(frame, spark.createDataFrame(events, EVENTS), **kw).orderBy("date").collect()


BONUS, SPLIT = _event("BONUS", "0.5", key="bonus"), _event("SPLIT", "2", key="split")
CASES = {
    "none": ([], ("10", "11", "11"), ["1", "1", "1"], ["1", "1", "1"]),
    "cash": ([_event()], ("10", "9", "9"), ["0.9", "1", "1"], ["1", "1.111111111111111111", "1.111111111111111111"]),
    "two parts count once": ([_event(), _event(key="cash_b")], ("10", "8", "8"), ["0.8", "1", "1"], ["1", "1.25", "1.25"]),
    "cash and bonus": ([_event(), BONUS], ("10", "6", "6"), ["0.6", "1", "1"], ["1", "1.666666666666666667", "1.666666666666666667"]),
    "for ten shares": ([_event(quantity="10", per="10"), _event("BONUS", "5", key="bonus", per="10")], ("10", "6", "6"), ["0.6", "1", "1"], ["1", "1.666666666666666667", "1.666666666666666667"]),
    "split": ([SPLIT], ("10", "5", "5"), ["0.5", "1", "1"], ["1", "2", "2"]),
    "chain": ([_event(), _event("SPLIT", "2", key="split", ex=T2, group="other")], ("10", "9", "4.5"), ["0.45", "0.5", "1"], ["1", "1.111111111111111111", "2.222222222222222222"]),
    "revised": ([_event(), _event(quantity="2", revision=2, known=T1)], ("10", "8", "8"), ["0.8", "1", "1"], ["1", "1.25", "1.25"]),
    "cancelled": ([_event(), _event(quantity=None, per=None, revision=2, known=T1, state="CANCELLED")], ("10", "9", "9"), ["1", "1", "1"], ["1", "1", "1"]),
}


@pytest.mark.parametrize("name", CASES)
def test_by_hand(spark, name):
    events, closes, forward, backward = CASES[name]
    rows = _run(spark, events, closes)
    assert [r["forward"] for r in rows] == [Decimal(x) for x in forward]
    assert [r["backward"] for r in rows] == [Decimal(x) for x in backward]


def test_events_outside_the_days_do_nothing(spark):
    rows = _run(spark, [_event(ex=T2), _event(key="base", ex=T0, group="b")], base=F.lit(T0), anchor=F.lit(T1))
    assert [(r["date"], r["forward"], r["backward"], r["problem"]) for r in rows] == [(T0, 1, 1, None), (T1, 1, 1, None)]
    told = adjustment.select_revisions(spark.createDataFrame([_event(ex=T2), _event(key="x"), _event(key="x", revision=2, known=T1)], EVENTS), F.lit(T0), F.lit(T1)).collect()
    assert sorted((r["event_key"], r["revision"], r["disposition"]) for r in told) == [("cash", 1, "OUT_OF_RANGE"), ("x", 1, "SUPERSEDED"), ("x", 2, "SELECTED")]


PROBLEMS = {
    "several_plans_on_one_day": [_event(), _event(key="b", group="other")],
    "role_twice_in_plan": [_event(), _event(key="alias", role="cash")],
    "split_beside_others": [_event(), SPLIT],
    "revisions_not_consecutive": [_event(), _event(revision=3, known=T1)],
    "identity_changed": [_event(), _event(revision=2, known=T1, role="other")],
    "availability_not_rising": [_event(), _event(revision=2)],
    "unsupported_action": [_event("RIGHTS")],
    "quantity_not_positive": [_event(quantity="0")],
    "split_without_new_shares": [_event("SPLIT", "1", key="split")],
    "record_date_not_before_ex": [_event(record=T1)],
    "payment_date_before_ex": [_event(payment=T0)],
    "reference_not_positive": [_event(quantity="10")],
    "ex_date_no_session": [_event(ex=dt.date(2026, 8, 29))],
    "no_session_before": [_event(ex=T0)],
    "factor_out_of_range": [_event("SPLIT", "10000000000000000000", key="split")],
}


@pytest.mark.parametrize("name", PROBLEMS)
def test_fails_closed(spark, name):
    rows = _run(spark, PROBLEMS[name])
    assert [(r["forward"], r["backward"], r["problem"]) for r in rows] == [(None, None, name)] * 3


@pytest.mark.parametrize("price", [None, "0", "-1"])
def test_reference_prices_are_not_filled(spark, price):
    assert {r["problem"] for r in _run(spark, [_event()], (price, "9", "9"))} == {"no_reference_price"}


def test_session_before_comes_from_the_calendar(spark):
    days = spark.createDataFrame([(T0,), (dt.date(2026, 8, 27) + dt.timedelta(hours=0),), (T1,), (T2,)], "date date")
    assert [str(r["forward"])[:4] for r in _run(spark, [_event()], calendar=days)] == ["0.90", "1.00", "1.00"]
    more = spark.createDataFrame([(T0,), (T1,), (dt.date(2026, 8, 30),), (T2,)], "date date")
    assert {r["problem"] for r in _run(spark, [_event(ex=T2)], calendar=more)} == {"no_reference_price"}


def test_other_entities_keep_their_factors(spark):
    closes = spark.createDataFrame([(e, t, Decimal(10)) for e in ("e", "f") for t in (T0, T1)], "entity string, date date, close decimal(20,6)")
    rows = adjustment.adjustment_factors(closes, spark.createDataFrame([_event("RIGHTS"), _event(entity="f")], EVENTS)).collect()
    assert {(r["entity"], r["date"], r["problem"], r["forward"]) for r in rows} == {("e", T0, "unsupported_action", None), ("e", T1, "unsupported_action", None), ("f", T0, None, Decimal("0.9")), ("f", T1, None, Decimal(1))}
