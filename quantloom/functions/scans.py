"""Running results over long ordered groups, in blocks: no group has to fit one task.

Rows are cut into blocks by range, so a group may lie in many of them. Each block is summed up on its own,
the sums of a group's earlier blocks are put together, and each block goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.sources.scratch import written

c = F.col
Step = Callable[[Column, Column], Column]


def in_blocks(df: DataFrame, keys: list[str], order: list[str], rows: int = 200_000) -> DataFrame:
    """The rows with `__block`: numbers that rise with (keys, order), each for about `rows` rows.

    A table is written, so that a row's block stays the same whatever is computed again. Of a boundary
    between two blocks at most one key has rows on both sides.
    """
    return split_blocks(df, keys, order, rows)[0]


def split_blocks(df: DataFrame, keys: list[str], order: list[str], rows: int = 200_000) -> tuple[DataFrame, bool]:
    """The rows in blocks, and whether a key may have several. Where no key has more than `rows` rows, keys stay
    whole: they are dealt out once, about `rows` rows to a task, and what follows by key needs no other shuffle."""
    once = written(df, "blocks")
    n = once.count()
    if n <= rows:
        return once.withColumn("__block", F.lit(0)), False
    if once.groupBy(*keys).count().agg(F.max("count")).first()[0] <= rows:
        return once.repartition(-(-n // rows), *keys).withColumn("__block", F.lit(0)), False
    return written(once.repartitionByRange(-(-n // rows), *keys, *order).withColumn("__block", F.spark_partition_id()), "blocks"), True


def block_window(keys: list[str], order: list[str]) -> Window:
    """All rows of a key's block up to the present one."""
    return Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def before_blocks(ends: DataFrame, keys: list[str], start: dict[str, Column], step: dict[str, Step]) -> DataFrame:
    """What a key's earlier blocks come to, for each of its blocks but those of keys with one block.

    `ends` has one row for each key and block. `start` gives the values before the first block, `step` the
    value after a block, from those before it and the block's own row. The result has
    fewer than two rows for each block, since a boundary is crossed by one key at most: it may be broadcast.
    """
    names, own = list(start), [x for x in ends.columns if x not in keys]
    listed = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__block", *[x for x in own if x != "__block"]))).alias("blocks")).where(F.size("blocks") > 1)
    state = F.struct(*[start[x].alias(x) for x in names])
    kind = ends.select(F.struct(c("__block"), *[start[x].alias(x) for x in names]).alias("s")).schema["s"].dataType.simpleString()
    first = F.struct(state.alias("now"), F.array().cast(f"array<{kind}>").alias("out"))

    def after(acc: Column, block: Column) -> Column:
        values = {x: step[x](acc["now"], block) for x in names}
        here = F.struct(block["__block"].alias("__block"), *[acc["now"][x].alias(x) for x in names])
        return F.struct(F.struct(*[values[x].alias(x) for x in names]).alias("now"), F.concat(acc["out"], F.array(here)).alias("out"))

    return listed.select(*keys, F.inline(F.aggregate("blocks", first, after, lambda acc: acc["out"])))


def affine(df: DataFrame, keys: list[str], order: list[str], factor: str, added: str, before: str, after: str, chunk: int = 128, block: str | None = None) -> DataFrame:
    """Each row with the value before and after it of the recurrence  value = factor * value + added,
    which begins with 0.

    Such steps compose: a run of them is a step of the same form. So each key's rows are cut into chunks,
    each chunk is folded on its own as an array, the chunks' own steps are a recurrence again, shorter by
    the factor `chunk`, and its results begin the chunks. Keys must not be null and `order` must be unique
    within one; with `block` (of in_blocks) not even the numbering of rows needs a whole key in one task.
    Null is no step: give 1 and 0 for a row that changes nothing.
    """
    place = [*keys, *([block] if block else [])]
    part = max((x for x in df.columns if x.startswith("__chunk")), default="__chunk", key=len) + "_"  # chunks of chunks have another name
    number = F.row_number().over(Window.partitionBy(*place).orderBy(*order)) - 1
    ordered = [x for x in order if x not in place]
    held = [x for x in df.columns if x not in place and x not in ordered]
    step = F.struct(*order, c(factor).cast("double").alias("__times"), c(added).cast("double").alias("__plus"), F.struct(*held).alias("__row"))
    chunks = df.withColumn(part, F.floor(number / chunk)).groupBy(*place, part).agg(F.array_sort(F.collect_list(step)).alias("__steps"))
    start = F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("a"), F.array().cast("array<struct<f:double,a:double>>").alias("out"))
    so_far = lambda acc: F.array(F.struct(acc["f"].alias("f"), acc["a"].alias("a")))
    fold = lambda acc, x: F.struct((acc["f"] * x["__times"]).alias("f"), (acc["a"] * x["__times"] + x["__plus"]).alias("a"), F.concat(acc["out"], so_far(acc)).alias("out"))
    chunks = written(chunks.withColumn("__fold", F.aggregate("__steps", start, fold)), "chunks")
    if (chunks.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > 1:
        steps = chunks.select(*place, part, c("__fold.f").alias("__f"), c("__fold.a").alias("__a"))
        heads = affine(steps, keys, [*([block] if block else []), part], "__f", "__a", "__head", "__tail", chunk)
        chunks = chunks.join(heads.select(*place, part, "__head"), [*place, part])
    else:
        chunks = chunks.withColumn("__head", F.lit(0.0))
    out = chunks.select(*place, "__head", F.inline(F.arrays_zip(c("__steps").alias("step"), c("__fold.out").alias("at"))))
    out = out.withColumn(before, c("at.f") * c("__head") + c("at.a")).withColumn(after, c("step.__times") * c(before) + c("step.__plus"))
    return out.select(*place, *[f"step.{x}" for x in ordered], "step.__row.*", before, after).select(*df.columns, before, after)
