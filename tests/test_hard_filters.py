"""Hard filters by name, loose values, and the waterfall with its samples."""

import pytest
from pyspark.sql import functions as F

from quantloom.functions import loose
from quantloom.operators import hard_filters as hf

SNAP = "code string, name string, price double, pe_ratio string, ma_bullish boolean, macd_status string, change_60d double"
ROWS = [
    ("1", "Alpha", 10.0, "12", True, "bullish", 5.0), ("2", "*ST Beta", 10.0, "12", True, "bullish", 5.0), ("3", None, 9.0, "-", True, "bullish", 5.0), ("4", "退市 Gamma", None, "8", True, "neutral", None),
    ("5", "Delta", 30.0, "n/a", None, None, 80.0), ("6", "Epsilon", float("nan"), " 20 ", False, "bearish", -3.0),
]


@pytest.fixture(scope="module")
def snap(spark):
    return spark.createDataFrame(ROWS, SNAP)


@pytest.mark.parametrize(
    ("settings", "kept"),
    [
        ({}, "123456"), ({"exclude_st": True}, "1356"), ({"exclude_st": False}, "123456"), ({"price_min": 10}, "125"), ({"price_max": 10}, "123"), ({"price_min": 0, "price_max": 1000}, "1235"), ({"pe_ttm_min": 8.0}, "1246"), ({"pe_ttm_max": 12}, "124"),
        ({"require_ma_bullish": True}, "1234"), ({"require_ma_bullish": False}, "123456"), ({"macd_status_whitelist": ["bullish", "neutral"]}, "1234"), ({"macd_status_whitelist": []}, "123456"), ({"change_60d_min": -3, "change_60d_max": 5}, "1236"),
        ({"exclude_st": True, "price_min": 5, "pe_ttm_max": 15, "require_ma_bullish": True}, "1"),
    ],
)
def test_filters(snap, settings, kept):
    assert "".join(sorted(r["code"] for r in hf.apply_hard_filters(snap, settings).collect())) == kept


def test_every_filter_of_the_table(spark):
    """Thirty-eight filters, each on a row that just passes and one that just fails."""
    assert len(hf.FILTERS) == 38
    for name, f in hf.FILTERS.items():
        good, bad = {"min": (1.0, 0.9), "max": (1.0, 1.1), "flag": (True, False), "any_of": ("x", "y"), "name": ("Alpha", "ST A")}[f.kind]
        rows = spark.createDataFrame([(1, good), (2, bad), (3, None)], f"id int, `{f.columns[0]}` {'boolean' if f.kind == 'flag' else 'string' if f.kind in ('any_of', 'name') else 'double'}")
        got = {r["id"] for r in hf.apply_hard_filters(rows, {name: {"flag": True, "name": True, "any_of": ["x"]}.get(f.kind, 1.0)}).collect()}
        assert got == ({1, 3} if f.kind == "name" else {1}), name


def test_other_names_of_columns(spark):
    rows = spark.createDataFrame([("A", "1,5", 3.0), ("B", "4", 3.0)], "`名称` string, `现价` string, x double")
    assert [r["名称"] for r in hf.apply_hard_filters(rows, {"price_min": 2, "exclude_st": True}).collect()] == ["B"]


def test_missing_columns_and_unknown_filters(snap):
    with pytest.raises(hf.MissingColumn, match="pb_min"):
        hf.rules(snap, {"pb_min": 1.0})
    with pytest.raises(hf.MissingColumn, match="exclude_st"):
        hf.rules(snap.drop("name"), {"exclude_st": True})
    with pytest.raises(ValueError, match="unknown"):
        hf.rules(snap, {"price_around": 1.0})
    assert hf.rules(snap, {"pb_min": None}) == []


def test_daily_filters_are_told_apart():
    assert not hf.needs_daily({"price_min": 1, "atr_20_pct_max": None, "require_ma_bullish": False}) and hf.needs_daily({"atr_20_pct_max": 1})
    assert hf.without_daily({"price_min": 1, "atr_20_pct_max": 2}) == {"price_min": 1}


def test_waterfall_samples_and_suggestions(snap):
    rows = hf.filter_waterfall(snap, {"exclude_st": True, "price_min": 9.5, "pe_ttm_max": 1}, samples=1).orderBy("step").collect()
    assert [(r["rule"], r["before"], r["after"], r["removed"]) for r in rows] == [("exclude_st", 6, 4, 2), ("price_min", 4, 2, 2), ("pe_ttm_max", 2, 0, 2)]
    assert [tuple(r["samples"][0]) for r in rows] == [("2", "*ST Beta", "*ST Beta"), ("3", None, "9.0"), ("1", "Alpha", "12")]
    assert [r["suggestion"] != "" for r in rows] == [False, False, True] and "all" in rows[2]["suggestion"]
    told = [(r["rule"], r["removed"]) for r in hf.rejection_summary(snap, {"exclude_st": True, "price_max": 1000, "pe_ttm_max": 1}, 2).collect()]
    assert told == [("exclude_st", 2), ("price_max", 1)]
    assert hf.filter_waterfall(snap, {}).count() == 0


def test_loose_values(spark):
    texts = [None, " NaN ", "None", "", "  a b ", "600001", "1", "600001.SH", "sh600519", "12.0", "1234567", "AAPL", "BRK-B", "x12y", "1,234.5%", "-", "--", "-3.9", "nan%", "YES", "on", "0", "\t7　"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    t = F.col("t")
    rows = got.select(loose.safe_text(t, 4).alias("t"), loose.safe_code(t).alias("c"), loose.safe_code(t, tickers=True).alias("k"), loose.safe_number(t).alias("n"), loose.safe_int(t).alias("i"), loose.safe_bool(t).alias("b")).collect()
    assert [r["t"] for r in rows[:6]] == ["", "", "", "", "a b", "6000"]
    assert [r["c"] for r in rows] == ["", "", "", "", "", "600001", "000001", "600001", "600519", "000012", "234567", "", "", "000012", "012345", "", "", "000039", "", "", "", "000000", "000007"]
    assert [r["k"] for r in rows[11:14]] == ["AAPL", "BRK-B", "X12Y"]
    assert [r["n"] for r in rows[14:19]] == [1234.5, None, None, -3.9, None] and [r["i"] for r in rows[14:18]] == [1234, None, None, -3] and rows[5]["n"] == 600001
    assert [r["b"] for r in rows] == [None] * 4 + [False] * 2 + [True] + [False] * 12 + [True, True, False, False]
