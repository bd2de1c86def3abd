"""Feature rows checked for coverage, warm-up and cut-off, hashed, and published instance by instance.

Rows are tall: instance, entity, date, value, quality, available_at. What a replay would raise for the whole
plan is here told per instance, and consumers of an instance that fails are held back with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.sources import sinks
from quantloom.sources.scratch import written

c = F.col
KEY = ("instance", "entity", "date")
#: Fixed value: the state of a row that publishing asks for.
COMPLETE = "COMPLETE"


@dataclass(frozen=True)
class Publication:
    """Output runs from date_from to date_to, both included; `warmup` dates before it each entity needs."""

    cutoff: str
    date_from: str
    date_to: str
    warmup: int = 0


def affected(edges: DataFrame, corrected: DataFrame) -> DataFrame:
    """instance, steps: the corrected instances and all that depend on them, however far.

    edges holds dependency and consumer. One round follows all edges out of what the round before reached,
    and only instances not reached yet go on, so diamonds aren't walked twice and cycles end. Each round is
    a written table; there are as many rounds as the longest of the shortest ways.
    """
    edges = written(edges.select("dependency", "consumer").where("dependency IS NOT NULL AND consumer IS NOT NULL").distinct(), "edges")
    front = written(corrected.select(c("instance")).where("instance IS NOT NULL").distinct().withColumn("steps", F.lit(0)), "reached")
    reached, step = front, 0
    while not front.isEmpty():
        step += 1
        new = edges.join(front, edges["dependency"] == front["instance"], "left_semi").select(c("consumer").alias("instance")).distinct()
        front = written(new.join(reached, "instance", "left_anti").withColumn("steps", F.lit(step)), "reached")
        reached = reached.unionByName(front)
    return reached


def _cells(rows: DataFrame, entities: DataFrame, at: Publication) -> DataFrame:
    """One row per instance, entity and date: how many rows, and what is wrong with them."""
    day = c("date")
    warm, out = day < F.lit(at.date_from).cast("date"), day.between(F.lit(at.date_from).cast("date"), F.lit(at.date_to).cast("date"))
    poor = c("value").isNull() | (F.coalesce(c("quality"), F.lit("")) != COMPLETE)
    late = F.coalesce(c("available_at") > F.lit(at.cutoff).cast("timestamp"), F.lit(True))
    cells = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(late).alias("late"), F.max(poor).alias("poor"), F.max(warm).alias("warm"), F.max(out).alias("out"))
    known = entities.select("entity").distinct().withColumn("known", F.lit(True))
    return cells.join(known, "entity", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def gate(rows: DataFrame, entities: DataFrame, dates: DataFrame, at: Publication) -> DataFrame:
    """instance, n_rows, n_warmup, content_hash, problem: each instance's output and the first thing wrong.

    In this order: repeated (two rows of an entity and date), late (available after the cut-off, or no one
    knows when), empty (no output rows), warm-up quality, warm-up evidence (an entity of the output has
    fewer warm-up dates than asked for), entities (on some date they aren't exactly the expected ones),
    dates (not exactly the expected ones), quality (of the output). Without expected entities or dates the
    instance fails. Rows after the output are checked for cut-off and repeats, but never published.
    """
    cells = _cells(rows, entities, at)
    by_entity = cells.groupBy("instance", "entity").agg(
        F.max(c("n") > 1).alias("repeated"), F.max("late").alias("late"), F.count_if("warm").alias("n_warm"), F.count_if("out").alias("n_out"),
        F.max(c("warm") & c("poor")).alias("warm_poor"), F.max(c("out") & c("poor")).alias("out_poor"))
    entity_side = by_entity.groupBy("instance").agg(
        F.max("repeated").alias("repeated"), F.max("late").alias("late"), F.max("warm_poor").alias("warm_poor"), F.max("out_poor").alias("out_poor"),
        F.sum("n_warm").alias("n_warmup"), F.min(F.when(c("n_out") > 0, c("n_warm"))).alias("least_warm"))
    expected = dates.select("date").distinct().withColumn("on", F.lit(True))
    by_date = cells.where("out").groupBy("instance", "date").agg(F.count_if("known").alias("n_known"), F.count_if(~c("known")).alias("n_other")).join(expected, "date", "left")
    date_side = by_date.groupBy("instance").agg(F.min("n_known").alias("least_known"), F.max("n_other").alias("most_other"), F.count_if("on").alias("n_on"), F.count_if(c("on").isNull()).alias("n_off"))
    output = rows.where(c("date").between(F.lit(at.date_from).cast("date"), F.lit(at.date_to).cast("date")))
    hashes = sinks.content_hashes(output.select(*KEY, "value", "quality", "available_at"), ["instance"])

    n_entities = entities.agg(F.count_distinct("entity")).scalar()
    n_dates = dates.agg(F.count_distinct("date")).scalar()
    problem = (
        F.when(c("repeated"), "repeated").when(c("late"), "late").when(c("n_rows").isNull(), "empty")
        .when(c("warm_poor") & F.lit(at.warmup > 0), "warm-up quality").when(c("least_warm") < at.warmup, "warm-up evidence")
        .when((c("least_known") != n_entities) | (c("most_other") > 0) | (n_entities == 0), "entities")
        .when((c("n_on") != n_dates) | (c("n_off") > 0) | (n_dates == 0), "dates").when(c("out_poor"), "quality")
    )
    sides = entity_side.join(date_side, "instance", "left").join(hashes, "instance", "left")
    return sides.select("instance", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_warmup", "content_hash", problem.alias("problem"))


def decide(gated: DataFrame, edges: DataFrame, before: DataFrame, corrected: DataFrame) -> DataFrame:
    """What becomes of each instance: action and revision, with the problem that holds one back.

    before holds instance, content_hash and revision of what is published; corrected the instances whose
    sources were corrected. new: not published so far; correction: a corrected instance or a consumer of
    one, with the next revision even if its rows came out the same; kept: neither corrected nor changed;
    undeclared (a problem): changed though nothing it depends on was corrected. An instance with a problem
    is held, and so are its consumers (problem dependency).
    """
    gated = written(gated, "gated")
    lineage = affected(edges, corrected).select("instance", F.lit(True).alias("_corrected"))
    old = before.select("instance", c("content_hash").alias("_old"), c("revision").alias("_revision"))
    joined = gated.join(lineage, "instance", "left").join(old, "instance", "left")
    undeclared = c("_old").isNotNull() & c("_corrected").isNull() & (c("_old") != c("content_hash"))
    checked = written(joined.withColumn("problem", F.coalesce("problem", F.when(undeclared, "undeclared"))), "checked")
    held = affected(edges, checked.where("problem IS NOT NULL")).select("instance", F.lit("dependency").alias("_held"))
    out = checked.join(held, "instance", "left").withColumn("problem", F.coalesce("problem", "_held"))
    action = F.when(c("problem").isNotNull(), "held").when(c("_old").isNull(), "new").when(c("_corrected"), "correction").otherwise("kept")
    revision = F.when(c("action") == "new", 1).when(c("action") == "correction", c("_revision") + 1).otherwise(c("_revision"))
    return out.withColumn("action", action).select("instance", "n_rows", "n_warmup", "content_hash", "problem", "action", revision.alias("revision"))


def publish(rows: DataFrame, decided: DataFrame, at: Publication, path: str) -> None:
    """Writes the output rows of new and corrected instances, warm-up left out; other partitions stay."""
    chosen = decided.where(c("action").isin("new", "correction")).select("instance", "revision")
    output = rows.where(c("date").between(F.lit(at.date_from).cast("date"), F.lit(at.date_to).cast("date"))).select(*KEY, "value", "quality", "available_at")
    sinks.overwrite_partitions(output.join(chosen, "instance"), path, ["instance"])
