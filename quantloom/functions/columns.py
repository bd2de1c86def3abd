"""Column builders that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quantloom.functions.scans import before_blocks, block_window, in_blocks
from quantloom.sources.scratch import written


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null (greatest and least skip nulls by themselves)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def over(x: Column) -> Column:
    """The part of x above zero; null stays null."""
    return clip(x, low=0.0)


def bars(n: int, before: int = 0, key: str = "code", order: str = "date") -> Window:
    """The last n rows of an instrument, ending `before` rows ago."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1) - before, -before)


def history(key: str = "code", order: str = "date") -> Window:
    return Window.partitionBy(key).orderBy(order)


def rolling(f, x: Column, n: int, before: int = 0) -> Column:
    """f over a full frame of n non-null values, else null."""
    w = bars(n, before)
    return F.when(F.count(x).over(w) == n, f(x).over(w))


def percentile_score(x: Column, *, lower_is_better: bool, missing: float, by: list | None = None) -> Column:
    """Tie-averaged percentile rank of the non-null values, in percent; `missing` for nulls.

    A window without partition would bring all rows to one task; `by` names the cross-section, such
    as a date.
    """
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = x.desc_nulls_last() if lower_is_better else x.asc_nulls_last()
    rank = F.rank().over(part.orderBy(order))
    ties = F.count(x).over(Window.partitionBy(*(by or [F.lit(0)]), x))
    n = F.count(x).over(part)
    return F.when(x.isNotNull() & (n > 0), clip((rank + (ties - 1) / 2) / n * 100, 0, 100)).otherwise(F.lit(float(missing)))


def ladder(*steps: tuple[Column, object], otherwise=None) -> Column:
    """The value of the first condition that holds."""
    first, *rest = steps
    out = F.when(first[0], F.lit(first[1]))
    for condition, value in rest:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def rounded(df, digits: int = 6, skip: tuple = ()):
    """All double columns rounded: sums of floats differ in their last bits from engine to engine."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def with_percentiles(df, ranks: dict):
    """Columns of tie-averaged percentile ranks over the whole frame: name -> (x, lower_is_better, missing).

    The frame is written once, with the ranked values. All ranks then go through one tall table: each distinct
    value is counted once, and running counts in blocks tell how many rows lie below it, so that no task sees
    all values of a rank. A value's score comes back by a join on the value.
    """
    df = written(df.withColumns({f"__x_{name}": x.cast("double") for name, (x, _, _) in ranks.items()}), "ranked")
    tall = df.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rank"), F.col(f"__x_{name}").alias("x")) for name in ranks])))
    counts = in_blocks(tall.where("x is not null").groupBy("rank", "x").agg(F.count("*").alias("n")), ["rank"], ["x"])
    local = counts.withColumn("upto", F.sum("n").over(block_window(["rank"], ["x"])))
    ends = local.groupBy("rank", "__block").agg(F.sum("n").alias("m"))
    heads = before_blocks(ends, ["rank"], {"m0": F.lit(0).cast("long")}, {"m0": lambda now, block: now["m0"] + block["m"]})
    totals = ends.groupBy("rank").agg(F.sum("m").alias("total"))  # one row for each rank
    placed = local.join(F.broadcast(heads), ["rank", "__block"], "left").join(F.broadcast(totals), "rank")
    upto, down = F.col("upto") + F.coalesce("m0", F.lit(0)), F.col("rank").isin([name for name, (_, lower, _) in ranks.items() if lower])
    outside = F.when(down, F.col("total") - upto).otherwise(upto - F.col("n"))
    scores = written(placed.select("rank", "x", ((outside + (F.col("n") + 1) / 2) / F.col("total") * 100).alias("score")), "scores")
    for name, (_, _, missing) in ranks.items():
        mine = scores.where(F.col("rank") == name).select(F.col("x").alias(f"__x_{name}"), F.col("score").alias(name))
        df = df.join(mine, f"__x_{name}", "left").withColumn(name, F.coalesce(clip(F.col(name), 0, 100), F.lit(float(missing)))).drop(f"__x_{name}")
    return df
