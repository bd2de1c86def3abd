"""Loose provider rows and broker files, worked by hand."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quantloom.sources import readers as rd


def test_clean_bars_tells_rows_apart(spark):
    df = spark.createDataFrame([("2024-01-05", "1.5", "10", "x"), ("2024/1/6 09:30:00", " 2e1 ", "1", "3"), ("20240107", ".5", "0", None), (None, "1", "1", "1"), ("soon", "1", "1", "1"), ("2024-01-08", "1,0", "1", "1"), ("2024-01-08", "1d", "1", "1"), ("2024-01-09", "1", "nan", "1")],
        "date string, close string, volume string, open string")
    good, bad = rd.clean_bars(df)
    assert sorted((str(r.date), r.close, r.volume, r.open) for r in good.collect()) == [("2024-01-05", 1.5, 10.0, None), ("2024-01-06", 20.0, 1.0, 3.0), ("2024-01-07", 0.5, 0.0, None), ("None", 1.0, 1.0, 1.0)]
    assert sorted((r.date, r.close, r.problem) for r in bad.collect()) == [("2024-01-08", "1,0", "close"), ("2024-01-08", "1d", "close"), ("2024-01-09", "1", "volume"), ("soon", "1", "date")]


def test_alert_bars_leave_an_unfinished_bar_out(spark):
    rows = [("a", 1, "2024-01-04", "1"), ("a", 2, "2024-01-05", "2"), ("b", 1, "2024-01-05", "3"), ("b", 2, "2024-01-04", "4"), ("c", 1, "2024-01-04", "5"), ("c", 2, "later", "6"), ("d", 1, "2024-01-04", "7"), ("d", 2, "2024-01-05", "--")]
    df = spark.createDataFrame(rows, "code string, position int, `交易日期` string, ` Close_Price ` string")
    got = lambda now: sorted(r.close for r in rd.alert_bars(df, ["close"], now).collect())
    assert got(dt.datetime(2024, 1, 5, 15, 59)) == [1, 3, 4, 5, 7]
    assert got(dt.datetime(2024, 1, 5, 16, 0)) == [1, 2, 3, 4, 5, 6, 7]
    assert got(dt.datetime(2024, 1, 6, 9, 0)) == [1, 2, 3, 4, 5, 7]
    with pytest.raises(ValueError, match="volume"):
        rd.alert_bars(df, ["close", "volume"], dt.datetime(2024, 1, 5))


def test_snapshots_by_provider(spark):
    df = spark.createDataFrame([("000001", "9.5", "-", "bank", "k"), ("000002", "0", "1", "x", "k"), ("000003", None, "1", "x", "k")], "`股票代码` string, `最新价` string, `市盈率(动)` string, `所属行业` string, extra string")
    assert [r.asDict() for r in rd.provider_snapshot(df, "efinance").collect()] == [{"code": "000001", "price": 9.5, "pe_ratio": None, "industry": "bank", "extra": "k"}]
    clash = spark.createDataFrame([("1", 2.0, 3.0)], "symbol string, close double, price double")
    assert [r.asDict() for r in rd.provider_snapshot(clash, "tushare").collect()] == [{"code": "1", "price": 2.0}]
    assert rd.provider_snapshot(df, "unknown").columns == df.columns


HEAD = "成交日期,证券代码,买卖标志,成交数量,成交均价,手续费,过户费,印花税,成交编号,币种\n"
LINES = ["2024-01-05,sh600000,证券买入,\"1,000\",10.5,5,0.1,,7,cny", "2024-01-05,sh600000,证券买入,\"1,000\",10.5,5,0.1,,7,cny", "20240106,000001,卖出,100,9,x,,1.5,,", "soon,000001,卖出,100,9,,,,,", "2024-01-06,,卖出,100,9,,,,,", "2024-01-06,1,分红,100,9,,,,,", "2024-01-06,1,买,0,9,,,,,", "2024-01-06,1,买,5,,,,,,"]


@pytest.mark.parametrize("encodings", [("utf-8-sig", "gbk"), ("gbk", "utf-8"), ("gbk",), ("utf-8",)])
def test_broker_files_in_either_encoding(spark, encodings):
    folder = tempfile.mkdtemp(prefix="broker-")
    for i, encoding in enumerate(encodings):
        with open(os.path.join(folder, f"{i}.csv"), "w", encoding=encoding) as f:
            f.write(HEAD + "\n".join(LINES) + "\n")
    raw = rd.read_broker_files(spark, folder)
    good, bad = rd.broker_trades(raw, "huatai")
    n = len(encodings)
    got = sorted((r.symbol, r.side, r.quantity, r.price, round(r.fee, 6), r.tax, r.trade_uid, r.currency, r["copy"]) for r in good.collect())
    assert got == sorted([("SH600000", "buy", 1000.0, 10.5, 5.1, 0.0, "7", "CNY", k) for k in (1, 2)] * n + [("000001", "sell", 100.0, 9.0, 0.0, 1.5, None, None, 1)] * n)
    assert good.select("dedup_hash").distinct().count() == 3
    assert sorted(r.problem for r in bad.collect()) == sorted(["trade_date", "symbol", "side", "quantity", "price"] * n)


def test_brokers_prefer_their_own_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-02-02", "1", "买入", "9", "3", "4"), (None, "2024-02-02", "1", "买入", "9", "3", " ")], "`发生日期` string, `成交日期` string, `代码` string, `操作` string, `数量` string, `成交均价` string, `成交价格` string")
    got = lambda broker: sorted((str(r.trade_date), r.price) for r in rd.broker_trades(df, broker)[0].collect())
    assert got("huatai") == [("2024-02-02", 3.0), ("2024-02-02", 3.0)]
    assert got("citic") == [("2024-01-01", 4.0), ("2024-02-02", 3.0)]
    assert rd.broker_trades(df.limit(0), "cmb")[0].agg(F.count("*")).first()[0] == 0


def test_broker_lines_are_read_once(spark):
    """A condition on parsed columns parses a line once; trades and bad rows come from one reading; wide lines stay."""
    folder = tempfile.mkdtemp(prefix="broker-")
    with open(os.path.join(folder, "0.csv"), "w") as f:
        f.write(HEAD + "\n".join([*LINES, LINES[2] + "," * 600]) + "\n")
    raw = rd.read_broker_files(spark, folder)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(raw.where("`成交数量` > 0 AND `成交均价` > 0")).count("from_csv(") == 1
    good, bad = rd.broker_trades(raw, "huatai")
    assert "from_csv(" not in plan(good) and "from_csv(" not in plan(bad)
    assert good.count() == 4 and bad.columns == [*raw.columns, "problem"]
