"""Mapping rules one by one, their order, the two outputs and the report."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quantloom.operators import canonical as cn

BAR = cn.Mapping(
    "bar_1d_raw",
    (
        cn.Field("entity_key", "symbol", "string", required=True, identity="entity_key"), cn.Field("trade_date", "day", "date", required=True), cn.Field("trading_status", "state", "string", enum={"T": "TRADED", "S": "SUSPENDED"}),
        *[cn.Field(x, x, "number") for x in ("open", "high", "low", "close")], cn.Field("volume_shares", "lots", "integer", unit="100"), cn.Field("published_at", "published", "timestamptz"), cn.Field("available_at", "known", "timestamptz"),
    ),
)
ROW = {"symbol": "600001", "day": "2026-01-05", "state": "T", "open": "10", "high": "11.5", "low": "9", "close": "10.25", "lots": "12", "published": "2026-01-05T08:00:00Z", "known": "2026-01-05T09:00:00+00:00"}
SCHEMA = "n long, " + ", ".join(f"{x} string" for x in ROW)


def _run(spark, changes, mapping=BAR, calendar=True, schema=SCHEMA, base=None):
    base = base or ROW
    rows = [(i, *[(base | change)[x] for x in base]) for i, change in enumerate(changes)]
    identities = spark.createDataFrame([("600001", "RESOLVED", "stock:sh600001", "sh600001"), ("600002", "INACTIVE", "stock:sh600002", None), ("600003", "AMBIGUOUS", None, None), ("600004", "NOT_FOUND", None, None), ("600005", "RESOLVED", None, "x")], "value string, status string, entity_key string, canonical_id string")
    days = spark.createDataFrame([("CN", dt.date(2026, 1, 5), True), ("CN", dt.date(2026, 1, 6), False), ("US", dt.date(2026, 1, 7), True)], "market string, trade_date date, is_open boolean")
    return cn.map_rows(spark.createDataFrame(rows, schema), mapping, "n", identities, days if calendar else None, now=F.lit("2026-01-06T00:00:00Z").cast("timestamp"))


def test_a_good_row(spark):
    mapped = _run(spark, [{}])
    (r,) = cn.accepted(mapped).collect()
    assert tuple(r)[:8] == ("stock:sh600001", dt.date(2026, 1, 5), "TRADED", Decimal(10), Decimal("11.5"), Decimal(9), Decimal("10.25"), 1200) and r["available_at"].hour == 9
    assert cn.rejected(mapped).count() == 0
    (q,) = cn.quality_report(mapped, BAR).collect()
    assert q.asDict() == {"row_count": 1, "rejected_row_count": 0, "duplicate_key_count": 0, "identity_unresolved_count": 0, "identity_ambiguous_count": 0, "failure_reasons": [], "quality_status": "COMPLETE"}


CASES = [
    ({"day": None}, "CANONICAL_NULL_FORBIDDEN", "trade_date"),
    ({"state": "X"}, "CANONICAL_ENUM_UNKNOWN", "trading_status"),
    ({"lots": "many"}, "CANONICAL_TYPE_INVALID", "volume_shares"),
    ({"lots": "0.005"}, "CANONICAL_TYPE_INVALID", "volume_shares"),  # half a share
    ({"symbol": "600003"}, "CANONICAL_IDENTITY_AMBIGUOUS", "entity_key"),
    ({"symbol": "600004"}, "CANONICAL_IDENTITY_UNRESOLVED", "entity_key"),
    ({"symbol": "600005"}, "CANONICAL_IDENTITY_UNRESOLVED", "entity_key"),
    ({"symbol": "unknown"}, "CANONICAL_IDENTITY_UNRESOLVED", "entity_key"),
    ({"close": "NaN"}, "CANONICAL_TYPE_INVALID", "close"),
    ({"day": "05/01/2026"}, "CANONICAL_TYPE_INVALID", "trade_date"),
    ({"day": "2026-02-30"}, "CANONICAL_TYPE_INVALID", "trade_date"),
    ({"known": "2026-01-05T09:00:00"}, "CANONICAL_TYPE_INVALID", "available_at"),
    ({"known": "2026-01-07T09:00:00Z"}, "CANONICAL_AVAILABLE_AT_FUTURE", "available_at"),
    ({"published": "2026-01-05T10:00:00Z"}, "CANONICAL_DISCLOSURE_AFTER_AVAILABLE", None),
    ({"lots": "-1"}, "CANONICAL_NEGATIVE_VALUE", None),
    ({"high": "10.2"}, "CANONICAL_OHLC_INVALID", None),
    ({"low": "10.1"}, "CANONICAL_OHLC_INVALID", None),
    ({"day": "2026-01-06"}, "CANONICAL_NON_TRADING_DAY", None),
    ({"day": "2026-01-07"}, "CANONICAL_TRADING_CALENDAR_UNAVAILABLE", None),
]


def test_each_rule(spark):
    mapped = _run(spark, [change for change, _, _ in CASES])
    got = {r["ordinal"]: (r["code"], r["field"]) for r in cn.rejected(mapped).collect()}
    assert got == {i: (code, name) for i, (_, code, name) in enumerate(CASES)}
    (q,) = cn.quality_report(mapped, BAR).collect()
    assert (q["quality_status"], q["rejected_row_count"], q["identity_unresolved_count"], q["identity_ambiguous_count"]) == ("FAILED", len(CASES), 3, 1)
    assert q["failure_reasons"] == sorted({code for _, code, _ in CASES}) and sum(r["n"] for r in cn.rejections(mapped).collect()) == len(CASES)


def test_first_rule_counts_and_nulls_are_fine_where_allowed(spark):
    mapped = _run(spark, [{"symbol": "600003", "day": None, "close": "bad"}, {"day": None, "close": "bad"}, {"symbol": "600002", "open": None, "lots": None, "state": None, "published": None, "high": "1e1", "close": "10.0000000000004", "low": " 9 "}])
    assert {r["ordinal"]: r["code"] for r in mapped.collect()} == {0: "CANONICAL_IDENTITY_AMBIGUOUS", 1: "CANONICAL_NULL_FORBIDDEN", 2: None}
    (r,) = cn.accepted(mapped).collect()
    assert (r["entity_key"], r["open"], r["volume_shares"], r["high"], r["close"], r["low"]) == ("stock:sh600002", None, None, 10, 10, 9)


def test_of_equal_keys_the_first_good_row_is_kept(spark):
    mapped = _run(spark, [{"close": "bad"}, {"close": "10"}, {"close": "9.5"}, {"close": "9.6"}])
    assert {r["ordinal"]: r["code"] for r in mapped.collect()} == {0: "CANONICAL_TYPE_INVALID", 1: None, 2: "CANONICAL_DUPLICATE_KEY", 3: "CANONICAL_DUPLICATE_KEY"}
    assert cn.quality_report(mapped, BAR).first()["duplicate_key_count"] == 2


def test_booleans_and_integers(spark):
    m = cn.Mapping("flags", (cn.Field("k", "k", "integer"), cn.Field("b", "b", "boolean")))
    values = ["true", "1", "YES", " y ", "open", "FALSE", "0", "no", "closed", "maybe", None]
    rows = spark.createDataFrame([(i, str(i), v) for i, v in enumerate(values)] + [(11, "true", "1"), (12, "1.5", "1"), (13, "13.0", "n")], "n long, k string, b string")
    got = {r["ordinal"]: (r["out"]["k"], r["out"]["b"], r["code"]) for r in cn.map_rows(rows, m, "n").collect()}
    assert [got[i][1] for i in range(11)] == [True] * 5 + [False] * 4 + [None, None] and got[9][2] == "CANONICAL_TYPE_INVALID" and got[10][2] is None
    assert got[11][2] == got[12][2] == "CANONICAL_TYPE_INVALID" and got[13] == (13, False, None)


def test_listing_intervals(spark):
    m = cn.Mapping("listing_status_history", (cn.Field("entity_key", "e", "string", required=True), cn.Field("effective_from", "a", "date"), cn.Field("effective_to", "b", "date")))
    frame = lambda *rows: cn.map_rows(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, e string, a string, b string"), m, "n")
    bad = frame(("x", "2026-01-02", "2026-01-02"), ("x", "2026-01-01", None), ("x", "2026-01-03", None))
    assert cn.quality_report(bad, m).first()["failure_reasons"] == ["CANONICAL_LISTING_INTERVAL_INVALID", "CANONICAL_LISTING_INTERVAL_OVERLAP"]
    assert cn.quality_report(frame(("x", "2026-01-01", "2026-01-03"), ("x", "2026-01-03", None)), m).first()["quality_status"] == "COMPLETE"


@pytest.mark.parametrize(
    ("dataset", "fields", "row", "code"),
    [
        ("trading_calendar", {"market": "string", "trade_date": "date", "is_open": "boolean", "session_open_at": "timestamptz", "session_close_at": "timestamptz"}, ("CN", "2026-01-05", "open", "2026-01-05T07:00:00Z", "2026-01-05T01:30:00Z"), "CANONICAL_CALENDAR_INVALID"),
        ("trading_calendar", {"market": "string", "trade_date": "date", "is_open": "boolean", "session_open_at": "timestamptz", "session_close_at": "timestamptz"}, ("CN", "2026-01-05", "closed", "2026-01-05T07:00:00Z", None), "CANONICAL_CALENDAR_INVALID"),
        ("instrument_status_daily", {"entity_key": "string", "status_date": "date", "instrument_status": "string", "is_tradable": "boolean"}, ("x", "2026-01-05", "DELISTED", "y"), "CANONICAL_STATUS_INCONSISTENT"),
        ("corporate_action", {"corporate_action_id": "string", "revision": "integer", "ex_date": "date", "record_date": "date"}, ("x", "1", "2026-01-05", "2026-01-04"), "CANONICAL_ACTION_DATES_INVALID"),
        ("corporate_action", {"corporate_action_id": "string", "revision": "integer", "cash_amount": "number"}, ("x", "1", "-0.1"), "CANONICAL_ACTION_AMOUNT_INVALID"),
        ("corporate_action", {"corporate_action_id": "string", "revision": "integer"}, ("x", "0"), "CANONICAL_REVISION_INVALID"),
        ("financial_statement", {"entity_key": "string", "unit": "string", "revision": "integer"}, ("x", "bushels", "1"), "CANONICAL_UNIT_UNKNOWN"),
    ],
)
def test_rules_of_datasets(spark, dataset, fields, row, code):
    m = cn.Mapping(dataset, tuple(cn.Field(x, x, kind) for x, kind in fields.items()), key=(next(iter(fields)),))
    rows = spark.createDataFrame([(0, *row)], "n int, " + ", ".join(f"{x} string" for x in fields))
    assert [r["code"] for r in cn.map_rows(rows, m, "n").collect()] == [code]


def test_empty_input_and_wrong_mappings(spark):
    mapped = _run(spark, [])
    assert cn.accepted(mapped).count() == 0 and cn.quality_report(mapped, BAR).first()["quality_status"] == "COMPLETE"
    with pytest.raises(ValueError, match="types"):
        cn.Mapping("x", (cn.Field("a", "a", "text"),))
    with pytest.raises(ValueError, match="twice"):
        cn.Mapping("x", (cn.Field("a", "a", "string"), cn.Field("a", "b", "string")))
    with pytest.raises(ValueError, match="identities"):
        cn.map_rows(spark.createDataFrame([(1, "x")], "n int, symbol string"), BAR, "n")
