"""Streams in several files, late and twice, against folds over the same rows."""

import datetime as dt
import os

import pandas as pd
import pytest

from quantloom.streaming import alerts, bars, queries

SCHEMA = "user_id long, ts timestamp, value double, event_id long"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def _stream(spark, tmp_path, *batches):
    """A stream that reads one file of rows (user, minutes, value) in each micro-batch, in order."""
    n = 0
    for i, rows in enumerate(batches):
        data = [(u, START + dt.timedelta(minutes=m), v, n + k) for k, (u, m, v) in enumerate(rows)]
        n += len(rows)
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
            (tmp_path / "files").mkdir(exist_ok=True)
            target = tmp_path / "files" / f"{i:03d}.parquet"
            target.write_bytes(f.read_bytes())
            stamp = 1_700_000_000 + i
            os.utime(target, (stamp, stamp))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/files")


def _told(df):
    return sorted((r["rule"], r["code"], int((r["at"].replace(tzinfo=dt.UTC) - START).total_seconds() // 60), r["price"]) for r in df.collect())


END = [(9, 6000, 1.0)]  # moves the watermark past everything before


def test_late_ticks_stand_at_their_place(spark, tmp_path):
    """In the order of arrival 10 -> 30 would cross again after the late 15."""
    stream = _stream(spark, tmp_path, [(1, 0, 10.0), (1, 20, 30.0)], [(1, 10, 15.0), (1, 30, 31.0), (1, 12, 25.0)], END)
    assert _told(queries.run_stream(alerts.alerts(stream, [alerts.LevelRule("r", 20.0, cooldown_s=0)]), "append")) == [("r", 1, 12, 25.0)]


def test_cool_down_by_rule_target_and_severity(spark, tmp_path):
    ups = [(u, m, v) for u in (1, 2) for m, v in ((0, 10.0), (10, 30.0), (20, 10.0), (30, 30.0), (80, 10.0), (90, 30.0))]
    rules = [alerts.LevelRule("a", 20.0, cooldown_s=3600), alerts.LevelRule("b", 20.0, "below", "info", 0)]
    got = _told(queries.run_stream(alerts.alerts(_stream(spark, tmp_path, ups[:5], ups[5:], END), rules), "append"))
    assert got == sorted([("a", u, m, 30.0) for u in (1, 2) for m in (10, 90)] + [("b", u, m, 10.0) for u in (1, 2) for m in (20, 80)])


def test_state_is_forgotten_after_a_silent_day(spark, tmp_path):
    """The price of a day before isn't the one that a crossing starts from."""
    stream = _stream(spark, tmp_path, [(1, 0, 10.0), (2, 0, 10.0)], [(2, 600, 10.0), (3, 2000, 1.0)], [(3, 4500, 1.0)], [(1, 4600, 30.0), (2, 4600, 10.0), (2, 4601, 30.0)], [(3, 9000, 1.0)])
    assert _told(queries.run_stream(alerts.alerts(stream, [alerts.LevelRule("r", 20.0)]), "append")) == [("r", 2, 4601, 30.0)]


def test_rows_without_price_are_left_out(spark, tmp_path):
    stream = _stream(spark, tmp_path, [(1, 0, 10.0), (1, 5, None), (1, 10, 30.0)], END)
    assert _told(queries.run_stream(alerts.alerts(stream, [alerts.LevelRule("r", 20.0)]), "append")) == [("r", 1, 10, 30.0)]


def test_rules_share_a_targets_ticks(spark, tmp_path):
    """Ticks aren't copied for each rule; rules of one name and severity share a cool-down, others don't."""
    rules = [alerts.LevelRule("a", 20.0, cooldown_s=3600), alerts.LevelRule("a", 10.0, cooldown_s=60), alerts.LevelRule("b", 20.0, cooldown_s=0), alerts.LevelRule("b", 50.0, severity="info")]
    out = alerts.alerts(_stream(spark, tmp_path, [(1, 0, 5.0), (1, 1, 15.0)], [(1, 30, 25.0), (1, 40, 5.0), (1, 50, 60.0)], END), rules)
    assert "Generate" not in out._jdf.queryExecution().logical().toString()
    assert _told(queries.run_stream(out, "append")) == [("a", 1, 1, 15.0), ("a", 1, 30, 25.0), ("b", 1, 30, 25.0), ("b", 1, 50, 60.0), ("b", 1, 50, 60.0)]


def test_told_once(spark, tmp_path):
    stream = _stream(spark, tmp_path, [(1, 0, 1.0), (1, 0, 1.0), (None, 0, 1.0)], [(1, 0, 1.0), (1, 1, 1.0), (None, 0, 2.0)])
    got = queries.run_stream(alerts.told_once(stream.selectExpr("user_id", "ts", "ts as second"), ["user_id", "second"], "ts"), "append")
    assert sorted((r["user_id"] or 0, r["ts"].minute) for r in got.collect()) == [(0, 0), (1, 0), (1, 1)]


def test_bars_of_two_files(spark, tmp_path):
    stream = _stream(spark, tmp_path, [(1, 0, 10.0), (1, 20, 30.0)], [(1, 10, 5.0)])
    out = queries.run_stream(bars.ohlc(stream), "update").toPandas()
    last = out.sort_values("ticks").iloc[-1]
    assert (last["open"], last["high"], last["low"], last["close"], last["ticks"]) == (10, 30, 5, 30, 3)


def test_rules_have_a_direction():
    with pytest.raises(ValueError, match="direction"):
        alerts.LevelRule("r", 1.0, "sideways")


def test_alerts_of_the_table_same_as_fold(spark, sf_dir):
    events, want = pd.read_parquet(f"{sf_dir}/events.parquet").sort_values(["ts", "event_id"]), {}
    end = events["ts"].max() - pd.Timedelta("2h")
    for user, rows in events[events["ts"] <= end].groupby("user_id"):
        last, seen, until, n = None, None, pd.Timestamp(0), 0
        for t, x in zip(rows["ts"], rows["value"], strict=True):
            if last is not None and t - seen <= pd.Timedelta("1D") and last <= 20.0 < x and t >= until:
                n, until = n + 1, t + pd.Timedelta("1h")
            last, seen = x, t
        if n:
            want[user] = n
    assert {r["code"]: r["alerts"] for r in queries.stream_alerts(spark, sf_dir).collect() if r["rule"] == "high"} == want
