"""Rules whose SQL twin could repeat a mistake, worked by hand."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from quantloom.functions.columns import with_percentiles
from quantloom.operators import backtest as bt
from quantloom.operators import indicators as ind
from quantloom.operators import research as rs
from quantloom.operators import screening as scr
from quantloom.operators import sentiment as sm


def _day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def _picked(spark, scores, k, seed="s", **kw):
    rows = spark.createDataFrame([("g", f"c{i:02d}", float(x), i != 99) for i, x in enumerate(scores)], "g string, code string, screen_score double, fine boolean")
    return [(r["code"], r["place"]) for r in scr.seeded_rotation(rows, seed, "2024-01", "g", k, **kw).orderBy("place").collect()]


def _hashes(codes):
    return sorted(codes, key=lambda x: hashlib.sha256(f"s\0{'2024-01'}\0{x}".encode()).digest())


def test_rotation_keeps_the_head_and_draws_the_tail_by_hash(spark):
    """Four places: two are kept, two drawn from all within 1.5 of the fourth."""
    got = _picked(spark, [80, 79, 78.5, 78, 77.5, 77, 76.6, 76.4], 4)
    drawn = sorted(_hashes([f"c{i:02d}" for i in range(2, 7)])[:2])
    assert got == [(x, i + 1) for i, x in enumerate(["c00", "c01", *drawn])]


def test_rotation_protects_what_is_far_better_than_the_cut(spark):
    """The first three are more than 1.5 above the fourth, so one place is open."""
    got = _picked(spark, [90, 85, 80, 70, 69.5, 69], 4)
    assert got[:3] == [("c00", 1), ("c01", 2), ("c02", 3)] and got[3][0] == _hashes(["c03", "c04", "c05"])[0]


@pytest.mark.parametrize(("scores", "k", "kw"), [([80, 79.9, 79.8], 2, {"seed": ""}), ([80, 79.9, 79.8], 1, {}), ([80, 79.9], 2, {}), ([80, 79.9, 79.8, 79.7], 3, {"share": 0.0}), ([80, 79, 60], 2, {})])
def test_rotation_leaves_the_best_alone(spark, scores, k, kw):
    assert _picked(spark, scores, k, **kw) == [(f"c{i:02d}", i + 1) for i in range(k)]


@pytest.mark.parametrize(
    ("latest", "trend", "persistence", "cooling", "n", "state", "stage"),
    [
        (70.0, -6.0, 40.0, 0.0, 3, "weakening", "retreat"), (55.0, 0.0, 40.0, 6.0, 3, "cooling", "retreat"), (65.0, 0.0, 40.0, 6.0, 3, "cooling", "divergence"), (55.0, 0.0, 40.0, 8.0, 3, "flat", "retreat"),
        (80.0, 9.0, 50.0, 0.0, 3, "warming", "acceleration"), (60.0, 0.0, 10.0, 0.0, 3, "persistent_hot", "diffusion"), (60.0, 5.0, 10.0, 0.0, 2, "warming", "diffusion"), (60.0, 5.0, 10.0, 0.0, 1, "warming", "first_move"),
    ],
)
def test_stages(spark, latest, trend, persistence, cooling, n, state, stage):
    row = spark.createDataFrame([(latest, trend, persistence, cooling, n, state)], "latest double, trend double, persistence double, cooling_score double, observations int, state string")
    assert row.select(rs.hotspot_stage()).first()[0] == stage


@pytest.mark.parametrize(("heats", "state"), [([70, 60, 66, 72, 66], "cooling"), ([60, 62, 65], "warming"), ([70, 71, 70, 69, 70], "persistent_hot"), ([62, 50, 40, 45, 41], "weakening"), ([50, 50], "flat")])
def test_heat_states(spark, heats, state):
    rows = spark.createDataFrame([("b", _day(i), float(x)) for i, x in enumerate([5, *heats][-5 if len(heats) == 5 else -len(heats) :])], "board string, at date, heat double")
    assert rs.board_heat_trend(rows).first()["state"] == state


def test_quotes_keep_what_they_lack(spark):
    bars = spark.createDataFrame([("x", _day(0), 1.0, 5.0), ("x", _day(1), 2.0, 6.0)], "code string, date date, close double, volume double")
    quotes = spark.createDataFrame([("x", _day(1), 3.0, None), ("x", _day(2), 4.0, None)], bars.schema)
    assert [tuple(r)[1:] for r in rs.merge_realtime(bars, quotes).orderBy("date").collect()] == [(_day(0), 1, 5), (_day(1), 3, 6), (_day(2), 4, None)]


def test_conflicts_count_whatever_their_dates(spark):
    asked = spark.createDataFrame([(1, "a", _day(5), _day(5)), (2, "b", _day(5), _day(5)), (3, "c", _day(5), _day(5))], "id int, alias string, day date, known_at date")
    known = [("a", "e1", _day(0), None, _day(0), "VERIFIED", True), ("a", "e2", _day(0), _day(1), _day(9), "CONFLICT", True), ("b", "e1", _day(0), None, _day(0), "VERIFIED", False)]
    aliases = spark.createDataFrame(known, "alias string, entity string, valid_from date, valid_to date, available_at date, state string, active boolean")
    assert {r["id"]: r["status"] for r in rs.resolve_aliases(asked, aliases).collect()} == {1: "CONFLICT", 2: "INACTIVE", 3: "NOT_FOUND"}


def test_requests_alike_meet_aliases_once(spark):
    D = dt.date
    asked = spark.createDataFrame([(i, "a", D(2024, 1, 1), D(2024, 1, 1)) for i in range(5)] + [(5, "a", None, None), (6, None, D(2024, 1, 1), None), (7, "a", D(2024, 1, 1), D(2024, 1, 1)), (7, "b", D(2024, 1, 1), D(2024, 1, 1))], "id long, alias string, day date, known_at date")
    aliases = spark.createDataFrame([("a", "x", D(2020, 1, 1), None, D(2020, 1, 1), "VERIFIED", True), ("b", "y", D(2020, 1, 1), None, D(2020, 1, 1), "VERIFIED", True)], "alias string, entity string, valid_from date, valid_to date, available_at date, state string, active boolean")
    out = rs.resolve_aliases(asked, aliases)
    assert {r["id"]: (r["status"], r["entity"]) for r in out.collect()} == {**{i: ("RESOLVED", "x") for i in range(5)}, 5: ("NOT_FOUND", None), 6: ("NOT_FOUND", None), 7: ("AMBIGUOUS", None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [alias" in plan[plan.index("Join LeftOuter, (alias"):]



def test_no_trade_score_before_twenty_rows_and_bullish_before_twenty_six(spark):
    rows = spark.createDataFrame([("x", _day(i), 100.0 - i) for i in range(30)], "code string, date date, close double")
    signals = [r["signal"] for r in ind.macd_signal(rows).orderBy("date").collect()]
    assert set(signals[:25]) == {"BULLISH"} and set(signals[25:]) == {"BEARISH"}
    full = rows.withColumns({"ma5": F.col("close"), "trend": F.lit("BULL"), "volume_status": F.lit(None).cast("string"), "support_ma5": F.lit(False), "support_ma10": F.lit(False), "signal": F.lit("BULLISH"), "rsi": F.lit(50.0)})
    scores = [r["trade_score"] for r in rs.trade_score(full).orderBy("date").collect()]
    assert scores[:19] == [None] * 19 and None not in scores[19:]


@pytest.mark.parametrize("missing", [7.0])
def test_percentiles_of_ties_nulls_and_both_directions(spark, missing):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([3.0, 1.0, 1.0, None, 2.0, 1.0])], "i int, x double")
    got = with_percentiles(rows, {"up": (F.col("x"), False, missing), "down": (F.col("x"), True, missing), "none": (F.lit(None).cast("double"), False, missing)}).orderBy("i").collect()
    assert [r["up"] for r in got] == [100, 40, 40, 7, 80, 40] and [r["down"] for r in got] == [20, 80, 80, 7, 40, 80] and {r["none"] for r in got} == {7}


def test_percentiles_over_several_blocks(spark, monkeypatch):
    from quantloom.functions import columns, scans

    monkeypatch.setattr(columns, "in_blocks", lambda df, keys, order: scans.in_blocks(df, keys, order, rows=9))
    rows = spark.createDataFrame([(i, float(i * 7 % 50)) for i in range(100)], "i int, x double")
    got = with_percentiles(rows, {"up": (F.col("x"), False, 0.0), "down": (F.col("x"), True, 0.0)}).collect()
    assert all(r["up"] == pytest.approx(2 * r["x"] + 1.5) and r["down"] == pytest.approx(101 - r["up"]) for r in got) and len(got) == 100


def test_profile_overrides_by_public_name():
    from quantloom.operators.profile import SCORING_PROFILE, scoring_profile

    assert len(SCORING_PROFILE) == 67 and scoring_profile() == SCORING_PROFILE
    assert scoring_profile({"momentum_base": "70", "no_such_key": 1}) == SCORING_PROFILE | {"momentum_base": 70.0}
    with pytest.raises(ValueError, match="finite"):
        scoring_profile({"momentum_base": float("nan")})


def test_topics_and_alignment(spark):
    rows = spark.createDataFrame([(1, "AI,Chips:90", None, "chips:80|AI", 70.0), (2, "Banks", "nan", "AI Rank:1", 70.0), (3, None, "None", "AI", 70.0), (4, "AI", None, "<NA>", None), (5, "AI/x", None, "x；y", None)], "i int, industry string, concepts string, board_heat_summary string, board_heat_score double")
    out = scr.score(rows, {"topic_alignment": 1.0}).orderBy("i").collect()
    assert [r["topic_alignment_score"] for r in out] == [80, 38, 50, 50, 75]


def test_theme_heat_falls_back(spark):
    frame = lambda columns, *rows: spark.createDataFrame(list(rows), columns)
    heat = lambda df: [r["theme_heat_score"] for r in scr.score(df, {"theme_heat": 1.0}).collect()]
    assert heat(frame("industry_heat_score double, concept_heat_score double", (60.0, 70.0), (None, 40.0), (None, None))) == [70, 40, 50]
    assert heat(frame("industry_change_pct double, industry_rank double", (2.0, 3.0), (None, None), (1.0, 40.0))) == [69, 50, 56]
    assert heat(frame("x int", (1,))) == [50]
    assert heat(frame("board_heat_score double, board_heat_trend_score double, board_heat_observations int", (90.0, 20.0, 2), (90.0, 20.0, 1), (50.0, -30.0, 5))) == [94, 89, 38]


def _weights(spark, *buckets):
    rows = [(skill, h, status, hit) for skill, h, hits, misses, seen, unable in buckets for status, hit, n in (("evaluated", True, hits), ("evaluated", False, misses), ("observational", None, seen), ("unable", None, unable)) for _ in range(n)]
    return {r["skill"]: r["weight"] for r in bt.skill_weights(spark.createDataFrame(rows, "skill string, horizon string, status string, hit boolean")).collect()}


def test_skill_weights(spark):
    """30 of 30 hits with 15 and 15 before make 45 of 60: a score of 0.5. A quarter unable costs a sixteenth."""
    got = _weights(spark, ("few", "1d", 29, 0, 0, 0), ("sure", "1d", 30, 0, 0, 0), ("torn", "1d", 30, 0, 0, 10), ("two", "1d", 30, 0, 0, 0), ("two", "5d", 0, 60, 0, 0), ("two", "9d", 9, 0, 5, 5), ("bad", "1d", 0, 3000, 0, 0))
    two = (0.5 * 0.5 + (2 * 15 / 90 - 1) * 60 / 90) / (0.5 + 60 / 90)
    assert got == {"few": 1.0, "sure": pytest.approx(1.2**0.5), "torn": pytest.approx(1.2 ** (0.5 - 0.25 * 0.25)), "two": pytest.approx(1.2**two), "bad": pytest.approx(1.2 ** (2 * 15 / 3030 - 1))}


def test_market_breadth_by_boards(spark):
    quotes = [
        ("600001", "A", 11.0, 10.0, 5e8), ("600002", "*st B", 10.5, 10.0, 1.0), ("600003", "*ST C", 11.0, 10.0, 1.0), ("688001", "D", 12.0, 10.0, 1.0), ("300001", "ST E", 8.0, 10.0, 1.0), ("830001", "F", 13.0, 10.0, 1.0), ("900901", "G", 9.0, 10.0, 1.0),
        ("600004", None, 10.0, 10.0, None), ("600005", "H", 11.0, 10.0, 0.0), ("600006", "I", None, 10.0, 1.0), ("600007", "J", 0.0, 10.0, 1.0), ("600008", "K", 3.66, 3.33, 1.0), ("600009", "L", 3.67, 3.33, 1.0),
    ]
    (r,) = sm.market_breadth(spark.createDataFrame(quotes, "code string, name string, close double, prev_close double, amount double")).collect()
    # At the limit up: 600001, 600002, 688001, 830001, 600008 (3.663 is 3.66); down: 300001, 900901.
    assert (r["up"], r["down"], r["flat"], r["limit_up"], r["limit_down"]) == (7, 2, 1, 5, 2) and r["total_amount"] == pytest.approx(5.0000001)
