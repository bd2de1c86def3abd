"""Closure, gates and decisions worked by hand; sinks run again."""

import datetime as dt

from pyspark.sql import functions as F

from quantloom.operators import feature_store as fs
from quantloom.sources import sinks
from quantloom.sources.scratch import shared_folder

AT = fs.Publication(cutoff="2024-02-01 00:00:00", date_from="2024-01-03", date_to="2024-01-04", warmup=2)
ROWS = "instance string, entity string, date date, value double, quality string, available_at timestamp"


def day(n):
    return dt.date(2024, 1, n)


def full(name, **kw):
    """Two entities on days 1 to 4, complete and in time; kw maps (entity, day) to a changed row or None."""
    rows = {(e, n): (name, e, day(n), float(n), "COMPLETE", dt.datetime(2024, 1, n)) for e in "ab" for n in range(1, 5)}
    for key, row in kw.items():
        rows[key[0], int(key[1:])] = row
    return [r for r in rows.values() if r]


def test_affected_follows_diamonds_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "y"), (None, "z"), ("a", "b")], "dependency string, consumer string")
    got = fs.affected(edges, spark.createDataFrame([("a",), ("a",), (None,)], "instance string"))
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert fs.affected(edges, spark.createDataFrame([], "instance string")).count() == 0


def _problems(spark, rows, entities="ab", dates=(3, 4)):
    f = spark.createDataFrame(rows, ROWS)
    gated = fs.gate(f, spark.createDataFrame([(e,) for e in entities], "entity string"), spark.createDataFrame([(day(n),) for n in dates], "date date"), AT)
    return {r.instance: r.problem for r in gated.collect()}


def test_gate_tells_the_first_problem(spark):
    stamp = dt.datetime(2024, 1, 5)
    row = lambda name, e, n, v=1.0, q="COMPLETE", at=stamp: (name, e, day(n), v, q, at)
    rows = full("good")
    rows += full("twice") + [row("twice", "a", 3)]
    rows += full("late", a3=row("late", "a", 3, at=dt.datetime(2024, 2, 2)))
    rows += full("unknown", a3=row("unknown", "a", 3, at=None))
    rows += full("empty", a3=None, a4=None, b3=None, b4=None)
    rows += full("poorwarm", b1=row("poorwarm", "b", 1, v=None))
    rows += full("shortwarm", b1=None)
    rows += full("entity", b4=None)
    rows += full("stranger") + [row("stranger", "z", n) for n in range(1, 5)]
    rows += full("date", a4=None, b4=None)
    rows += full("poor", a4=row("poor", "a", 4, q="PARTIAL"))
    assert _problems(spark, rows) == {
        "good": None, "twice": "repeated", "late": "late", "unknown": "late", "empty": "empty", "poorwarm": "warm-up quality", "shortwarm": "warm-up evidence",
        "entity": "entities", "stranger": "entities", "date": "dates", "poor": "quality"}
    assert _problems(spark, full("good"), entities="") == {"good": "entities"}
    assert _problems(spark, full("good"), dates=()) == {"good": "dates"}
    assert _problems(spark, []) == {}


def test_decisions_and_publishing(spark):
    edges = spark.createDataFrame([("raw", "mean"), ("bad", "user"), ("user", "last")], "dependency string, consumer string")
    names = ("raw", "mean", "same", "fresh", "sly", "user", "last")
    rows = [r for n in names for r in full(n)] + full("bad", b4=None)
    f = spark.createDataFrame(rows, ROWS)
    gated = fs.gate(f, spark.createDataFrame([("a",), ("b",)], "entity string"), spark.createDataFrame([(day(3),), (day(4),)], "date date"), AT)
    hashes = {r.instance: r.content_hash for r in gated.collect()}
    before = [(n, "0" if n in ("raw", "sly") else hashes[n], 4) for n in ("raw", "mean", "same", "sly", "user", "last")]
    decided = fs.decide(gated, edges, spark.createDataFrame(before, "instance string, content_hash string, revision int"), spark.createDataFrame([("raw",)], "instance string"))
    got = {r.instance: (r.action, r.revision, r.problem) for r in decided.collect()}
    assert got == {
        "raw": ("correction", 5, None), "mean": ("correction", 5, None), "same": ("kept", 4, None), "fresh": ("new", 1, None), "sly": ("held", 4, "undeclared"),
        "bad": ("held", None, "entities"), "user": ("held", 4, "dependency"), "last": ("held", 4, "dependency")}
    path = shared_folder(spark, "published")
    for _ in range(2):
        fs.publish(f, decided, AT, path)
    back = spark.read.parquet(path)
    assert {(r.instance, r["count"]) for r in back.groupBy("instance").count().collect()} == {("raw", 4), ("mean", 4), ("fresh", 4)}
    assert back.agg(F.min("date")).first()[0] == day(3)


def test_content_hash_needs_no_order_but_counts_repeats(spark):
    df = spark.createDataFrame([("k", "a", None), ("k", "", "b"), ("k", "a,1:b", "c")], "k string, x string, y string")
    one = sinks.content_hashes(df, ["k"]).first()
    two = sinks.content_hashes(df.select("y", "x", "k").orderBy(F.desc("x")), ["k"]).first()
    assert one.content_hash == two.content_hash
    others = [df.union(df.limit(1)), df.fillna(""), df.withColumn("x", F.lit("a")), df.where("y IS NULL")]
    assert len({sinks.content_hashes(o, ["k"]).first().content_hash for o in others} | {one.content_hash}) == 5


def test_upsert_leaves_other_partitions(spark):
    path = shared_folder(spark, "upsert")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "v int, k string")
    first = sinks.upsert(df, path, ["k"])
    second = sinks.upsert(spark.createDataFrame([(3, "b"), (9, "c")], "v int, k string"), path, ["k"], first)
    assert {(r.k, r.action) for r in second.collect()} == {("a", "absent"), ("b", "unchanged"), ("c", "new")}
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 2), ("b", 3), ("c", 9)]
