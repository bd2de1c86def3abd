"""Sequential folds over ordered groups, on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_fold(df: DataFrame, keys: list[str], order: list[str], start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], give: list[str], chunk: int = 128) -> DataFrame:
    """Each row with the state's fields `give` after it. `start` is the typed state before a group's first row, `step`
    makes the next state from it and a row.

    A group's rows are one array in one task, so this is for folds that aren't of the form of functions.scans:
    histories of an instrument, some thousands of rows. What is given is gathered in chunks, so that the array
    that grows is copied once a chunk and not once a row.
    """
    others = [x for x in df.columns if x not in keys]
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*others).alias("__row")))).alias("__rows"))
    kind = df.select(F.struct(*[start[x].alias(x) for x in give]).alias("s")).schema["s"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    first = F.struct(*[x.alias(name) for name, x in start.items()], none.alias("__new"), F.array().cast(f"array<array<{kind}>>").alias("__done"))

    def merge(acc: Column, row: Column) -> Column:
        def add(state: Column) -> Column:
            def close(new: Column) -> Column:
                full = F.size(new) >= chunk
                done = F.when(full, F.concat(acc["__done"], F.array(new))).otherwise(acc["__done"])
                return F.struct(*[state[x].alias(x) for x in start], F.when(full, none).otherwise(new).alias("__new"), done.alias("__done"))

            return let(F.concat(acc["__new"], F.array(F.struct(*[state[x].alias(x) for x in give]))), close)

        return let(F.struct(*[x.alias(name) for name, x in step(acc, row["__row"]).items()]), add)

    folded = F.aggregate("__rows", first, merge, lambda acc: F.concat(F.flatten(acc["__done"]), acc["__new"]))
    rows = rows.withColumn("__told", folded).select(*keys, F.inline(F.arrays_zip(c("__rows").alias("__r"), c("__told").alias("__t"))))
    return rows.select(*keys, "__r.__row.*", *[c(f"__t.{x}").alias(x) for x in give]).select(*df.columns, *give)
