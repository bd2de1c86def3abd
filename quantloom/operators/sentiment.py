"""Market breadth, robust scores, streaks, and point-in-time tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import clip, history, ladder

c = F.col


def limit_state(ratio: float = 0.10, tolerance: float = 0.005) -> Column:
    """LIMIT_UP, LIMIT_DOWN or NORMAL against the close before, rounded half up to cents; null if unknown."""
    before = F.lag("close").over(history())
    up, down = F.floor(before * (1 + ratio) * 100 + 0.5) / 100, F.floor(before * (1 - ratio) * 100 + 0.5) / 100
    return F.when(before.isNotNull() & c("close").isNotNull(), ladder((c("close") >= up - tolerance, "LIMIT_UP"), (c("close") <= down + tolerance, "LIMIT_DOWN"), otherwise="NORMAL"))


def breadth(bars: DataFrame) -> DataFrame:
    """Per day: instruments up, down, flat, at a limit; the median change; the top-20 share of the amount."""
    b = bars.withColumns({"change": c("close") / F.lag("close").over(history()) - 1, "state": limit_state()})
    place = F.row_number().over(Window.partitionBy("date").orderBy(c("amount").desc(), "code"))
    return b.withColumn("place", place).groupBy("date").agg(
        F.count_if(c("change") > 0).alias("up"), F.count_if(c("change") < 0).alias("down"), F.count_if(c("change") == 0).alias("flat"), F.count_if(c("state") == "LIMIT_UP").alias("limit_up"), F.count_if(c("state") == "LIMIT_DOWN").alias("limit_down"),
        F.median("change").alias("median_change"), (F.sum(F.when(c("place") <= 20, c("amount"))) / F.sum("amount")).alias("top20_share"))


#: Code beginnings of the boards with other price limits, and the limits.
BEIJING, STAR_CHINEXT = ("92", "43", "81", "82", "83", "87", "88"), ("688", "30")
LIMITS = {"beijing": 0.30, "star_chinext": 0.20, "special": 0.05, "other": 0.10}


def limit_ratio(code: Column, name: Column) -> Column:
    """The daily price limit of a stock, by its six-digit code and by ST in its name."""
    starts = lambda prefixes: code.rlike(f"^({'|'.join(prefixes)})")
    beijing = code.rlike(r"^\d{6}$") & starts(BEIJING)
    special = F.contains(F.upper(F.coalesce(name, F.lit(""))), F.lit("ST"))
    return ladder((beijing, LIMITS["beijing"]), (starts(STAR_CHINEXT), LIMITS["star_chinext"]), (special, LIMITS["special"]), otherwise=LIMITS["other"])


def market_breadth(quotes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of up, down, flat, limit_up and limit_down, and the amount in hundred millions, of quotes (code, name,
    close, prev_close, amount).

    A limit is the close before, times one plus or minus the stock's ratio, rounded half up to cents; a price at
    most as far from it as rounding moved it is there. Quotes without a price or a close before, or with an amount of
    0, are suspended and don't count; prices of 0 and less don't either.
    """
    live = c("close").isNotNull() & c("prev_close").isNotNull() & ~F.coalesce(c("amount") == 0, F.lit(False)) & (c("close") > 0)
    ratio = limit_ratio(c("code"), c("name"))

    def at(share: Column) -> Column:
        exact = c("prev_close") * share
        limit = F.floor(exact * 100 + 0.5) / 100
        return F.abs(c("close") - limit) <= F.round(F.abs(exact - limit), 10)

    n = lambda x: F.count_if(F.coalesce(live & x, F.lit(False)))
    return quotes.groupBy(*(by or [])).agg(
        n(c("close") > c("prev_close")).alias("up"), n(c("close") < c("prev_close")).alias("down"), n(c("close") == c("prev_close")).alias("flat"), n(at(1 + ratio)).alias("limit_up"), n(at(1 - ratio)).alias("limit_down"), (F.sum("amount") / 1e8).alias("total_amount"))


def streaks(bars: DataFrame, holds: Column) -> DataFrame:
    """How many rows in a row, up to each, `holds` is true."""
    breaks = F.sum(F.when(holds, 0).otherwise(1)).over(history().rowsBetween(Window.unboundedPreceding, 0))
    out = bars.withColumns({"__holds": F.coalesce(holds, F.lit(False)), "__island": breaks})
    n = F.sum(c("__holds").cast("int")).over(Window.partitionBy("code", "__island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("streak", n.cast("long")).drop("__holds", "__island")


def robust_score(df: DataFrame, x: str, longest: int = 252, least: int = 60, negative: bool = False, key: str = "code") -> DataFrame:
    """50 + z * 100 / 6 with z within 3, from the median and median deviation of the rows before."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(-longest, -1)
    out = df.withColumn("__past", F.array_sort(F.collect_list(x).over(w)))
    middle = "(element_at({0}, cast((size({0}) + 1) div 2 as int)) + element_at({0}, cast(size({0}) div 2 + 1 as int))) / 2"
    out = out.withColumn("__median", F.when(F.size("__past") >= least, F.expr(middle.format("__past"))))
    out = out.withColumn("__dev", F.expr("array_sort(transform(__past, v -> abs(v - __median)))"))
    out = out.withColumn("__mad", F.when(F.size("__past") >= least, F.expr(middle.format("__dev"))))
    z = (c(x) - c("__median")) / (1.4826 * c("__mad") + 1e-12) * (-1 if negative else 1)
    return out.withColumn("score", clip(50 + clip(z, -3, 3) * 100 / 6, 0, 100)).drop("__past", "__median", "__dev", "__mad")


def known_at(rows: DataFrame, key: list[str], cutoff: Column) -> DataFrame:
    """Of what was available at the cut-off, the latest revision of each key."""
    w = Window.partitionBy(*key).orderBy(c("revision").desc(), c("available_at").desc())
    return rows.where(c("available_at") <= cutoff).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def in_force(facts: DataFrame, intervals: DataFrame, key: str, day: str) -> DataFrame:
    """Facts with the interval of their key that holds their day, and how many do: an end is exclusive,
    a null end is open."""
    on = (facts[key] == intervals[key]) & (facts[day] >= intervals["valid_from"]) & (intervals["valid_to"].isNull() | (facts[day] < intervals["valid_to"]))
    return facts.join(intervals, on, "left").drop(intervals[key])


def overlapping(intervals: DataFrame, key: str) -> DataFrame:
    """Intervals that begin before the one before them of the same key has ended."""
    w = Window.partitionBy(key).orderBy("valid_from")
    return intervals.withColumn("next_from", F.lead("valid_from").over(w)).where(c("next_from").isNotNull() & (c("valid_to").isNull() | (c("next_from") < c("valid_to"))))


def changes(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys added, removed or revised between two versions."""
    o, n = old.select(*key, F.struct(*values).alias("old")), new.select(*key, F.struct(*values).alias("new"))
    kind = ladder((c("old").isNull(), "added"), (c("new").isNull(), "removed"), (~c("old").eqNullSafe(c("new")), "revised"))
    return o.join(n, key, "full_outer").withColumn("change", kind).where("change is not null").select(*key, "change")


def content_hash(*columns: str) -> Column:
    """SHA-256 of a row's values in the given order, as JSON."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def month_gaps(done: DataFrame, key: str, day: str) -> DataFrame:
    """Months between a key's first and last day in which it has no row."""
    months = done.select(key, F.trunc(day, "MM").alias("month")).distinct()
    span = months.groupBy(key).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = span.select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).withColumn("month", F.to_date("month"))
    return every.join(months, [key, "month"], "left_anti")
