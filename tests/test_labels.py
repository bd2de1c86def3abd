"""Label and heat merges worked by hand."""

from pyspark.sql import functions as F

from quantloom.operators import labels as lb


def test_unions_keep_the_first_of_each(spark):
    df = spark.createDataFrame([("a，b、a, nan", " b ,c"), (None, "x"), ("", None), ("None,<NA>", " , ")], "l string, r string")
    got = [r[0] for r in df.select(lb.label_union(F.col("l"), F.col("r"))).collect()]
    assert got == ["a,b,c", "x", "", ""]
    many = spark.createDataFrame([("\n".join("abcde") + "|a", "f|g|h|i|j")], "l string, r string")
    assert many.select(lb.summary_union(F.col("l"), F.col("r"))).first()[0] == "a | b | c | d | e | f | g | h"
    boards = spark.createDataFrame([("AI: 90:1 | :3 |chips\nAI: 90:1",)], "x string").select(lb.summary_boards(F.col("x"))).first()[0]
    assert boards == ["AI", "chips"]


def test_each_column_by_its_resolver(spark):
    snap = spark.createDataFrame([("1", "", "a", 5, 10.0, -3.0, "x"), ("000002", "own", None, None, None, 3.0, None), ("9", "z", "q", 1, 1.0, 1.0, "s")],
        "code string, industry string, concepts string, industry_rank int, board_heat_score double, board_heat_trend_score double, mine string")
    mapping = spark.createDataFrame([("000001", "bank", "a,b", "3.9", "9", "-4", 1), ("sz000002", "other", "c", "7", "8%", "-3", 1), ("000002.0", "late", "none", "8", "--", "2", 0), (None, "n", "n", "1", "1", "1", 2), ("0", "n", "n", "1", "1", "1", 2)],
        "code string, industry string, concepts string, industry_rank string, board_heat_score string, board_heat_trend_score string, at int")
    last = lb.last_of_each(mapping, "code", ["at"])
    assert sorted(r.code for r in last.collect()) == ["000001", "000002"]
    got = {r.code: r for r in lb.merge_mapping(snap, last).collect()}
    cols = ["industry", "concepts", "industry_rank", "board_heat_score", "board_heat_trend_score", "mine", "changed"]
    values = {k: tuple(r[x] for x in cols) for k, r in got.items()}
    assert values["1"] == ("bank", "a,b", 3, 10.0, -4.0, "x", ["industry", "concepts", "industry_rank", "board_heat_trend_score"])
    assert values["000002"] == ("own", "c", 7, 8.0, 3.0, None, ["concepts", "industry_rank", "board_heat_score"])
    assert values["9"] == ("z", "q", 1, 1.0, 1.0, "s", [])
    assert lb.merge_mapping(snap, last.limit(0)).where("size(changed) > 0").count() == 0


def test_best_board_by_observations_then_scores_then_place(spark):
    trends = spark.createDataFrame([("A", 1.0, 5.0, 0.0, 0.0, 3, "a"), ("B", 2.0, -1.0, 0.0, 0.0, 3, "b"), ("C", 2.0, 1.0, 0.0, 0.0, 3, "c"), ("D", None, None, 0.0, 0.0, 2, "d"), ("E", 9.0, 9.0, 0.0, 0.0, None, "e")],
        "board string, board_heat_latest_score double, board_heat_trend_score double, board_heat_persistence_score double, board_heat_cooling_score double, board_heat_observations int, board_heat_state string")
    mapping = spark.createDataFrame([(1, "A:1|C:2|B:3"), (2, "B|C"), (3, "E|D"), (4, "none of them"), (5, None), (6, "1|2|3|4|5|6|7|8|A")], "id int, board_heat_summary string").withColumn("board_heat_state", F.lit("old"))
    got = {r.id: r.board_heat_state for r in lb.best_board_trend(mapping, trends, "id").collect()}
    assert got == {1: "c", 2: "b", 3: "d", 4: "old", 5: "old", 6: "old"}


def test_fan_out_meets_each_member_once(spark):
    left = spark.createDataFrame([("u", [1, 1, 2, None]), ("v", [9]), ("w", None)], "u string, members array<int>")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "k int, q string")
    assert sorted((r.u, r.k, r.q) for r in lb.fan_out(left, "members", right, "k").collect()) == [("u", 1, "a"), ("u", 1, "b"), ("u", 2, "a")]


def test_codes_are_put_in_form_by_spelling(spark):
    """The last row over all spellings of a code, and no work on a code's text ahead of the first aggregate."""
    mapping = spark.createDataFrame([("1", 1, "a"), ("000001", 3, "b"), ("1.0", 2, "c"), (None, 9, "d"), ("0", 9, "e"), ("2", 1, "f"), ("2", 4, None)], "code string, at int, x string")
    last = lb.last_of_each(mapping, "code", ["at"])
    assert sorted((r.code, r["at"], r.x) for r in last.collect()) == [("000001", 3, "b"), ("000002", 4, None)]
    plan = last._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("regexp_replace") < plan.rindex("Aggregate")
