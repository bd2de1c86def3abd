"""Evaluation of recorded advice against later bars, and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import ladder

c = F.col


def as_of(left: DataFrame, right: DataFrame, values: list[str], key: str = "code", at: str = "date", strict: bool = False) -> DataFrame:
    """The last row of `right` not after (strict: before) each row of `left`, per key.

    Both are put in one stream of rows and ordered once, so there is no range join, and a key's rows
    are read once whatever their number.
    """
    order = [c("__at").asc(), c("__side").asc() if not strict else c("__side").desc()]
    l = left.select(c(key).alias("__key"), c(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__value"))  # noqa: E741
    r = right.select(c(key).alias("__key"), c(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__value"))
    last = F.last("__value", ignorenulls=True).over(Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = l.unionByName(r).withColumn("__last", last).where("__side = 1")
    return both.select("__row.*", *[c("__last")[v].alias(f"asof_{v}") for v in values])


def forward_bars(bars: DataFrame, n: int) -> DataFrame:
    """Each bar with the array of the n bars after it."""
    w = Window.partitionBy("code").orderBy("date").rowsBetween(1, n)
    return bars.withColumn("ahead", F.collect_list(F.struct("date", "high", "low", "close")).over(w))


def direction(action: Column) -> Column:
    return ladder((action.isin("buy", "add"), "up"), (action.isin("sell", "reduce"), "down"), ((action == "hold"), "not_down"), otherwise="flat")


def evaluate(signals: DataFrame, bars: DataFrame, n: int = 5, band: float = 2.0, stop: float = 0.95, target: float = 1.05) -> DataFrame:
    """Outcome of each signal over the n bars after its own.

    The first bar that touches the stop or the target ends a long position, at the stop if both do
    (ambiguous); what would be hit later isn't recorded. The outcome compares the return with the
    direction that the action expects, within a neutral band.
    """
    out = signals.join(forward_bars(bars, n).select("code", "date", c("close").alias("start"), "ahead"), ["code", "date"])
    out = out.withColumn("status", F.when(F.size("ahead") < n, "insufficient_data").when(c("start").isNull() | (c("start") <= 0), "error").otherwise("completed"))
    done = c("status") == "completed"
    out = out.withColumns({
        "end_close": F.when(done, F.element_at("ahead", -1)["close"]), "max_high": F.when(done, F.array_max(c("ahead.high"))), "min_low": F.when(done, F.array_min(c("ahead.low"))),
        "long": c("action").isin("buy", "add", "hold"), "expects": direction(c("action")),
        "stop_at": F.when(done, F.array_position(F.transform("ahead", lambda x: x["low"] <= c("start") * stop), True)), "target_at": F.when(done, F.array_position(F.transform("ahead", lambda x: x["high"] >= c("start") * target), True)),
    })
    s, t = F.nullif("stop_at", F.lit(0)), F.nullif("target_at", F.lit(0))
    hit = F.when(done & c("long"), ladder((s == t, "ambiguous"), (s.isNotNull() & (t.isNull() | (s < t)), "stop_loss"), (t.isNotNull(), "take_profit"), otherwise="neither"))
    out = out.withColumns({"return_pct": (c("end_close") / c("start") - 1) * 100, "first_hit": hit, "hit_days": F.when(done & c("long"), F.least(s, t))})
    r = c("return_pct")
    outcome = F.when(c("expects") == "up", ladder((r >= band, "win"), (r <= -band, "loss"), otherwise="neutral")).when(c("expects") == "down", ladder((r <= -band, "win"), (r >= band, "loss"), otherwise="neutral")).when(c("expects") == "not_down", ladder((r >= 0, "win"), (r <= -band, "loss"), otherwise="neutral")).otherwise(ladder((F.abs(r) <= band, "win"), otherwise="loss"))
    return out.withColumn("outcome", F.when(done, outcome)).drop("ahead", "stop_at", "target_at")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(F.count_if(whole) > 0, F.count_if(part) / F.count_if(whole) * 100)


def summary_columns() -> list[Column]:
    """Counts, and rates over the rows to which they apply."""
    done, win, loss = c("status") == "completed", c("outcome") == "win", c("outcome") == "loss"
    long = done & c("long")
    return [
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(c("status") == "insufficient_data").alias("insufficient"), F.count_if(long).alias("longs"),
        F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), F.count_if(c("outcome") == "neutral").alias("neutrals"), _rate(win, win | loss).alias("win_rate_pct"), _rate(c("outcome") == "neutral", done).alias("neutral_rate_pct"),
        F.avg(F.when(done, c("return_pct"))).alias("avg_return_pct"), _rate(c("first_hit").isin("stop_loss", "ambiguous"), long).alias("stop_rate_pct"), _rate(c("first_hit") == "take_profit", long).alias("target_rate_pct"),
        _rate(c("first_hit") == "ambiguous", long).alias("ambiguous_rate_pct"), F.avg(F.when(c("first_hit") != "neither", c("hit_days"))).alias("avg_hit_days"),
    ]


def summaries(evaluated: DataFrame) -> DataFrame:
    """Overall (code null) and per instrument, in one pass."""
    return evaluated.rollup("code").agg(*summary_columns())


def breakdowns(evaluated: DataFrame, dimensions: list[str]) -> DataFrame:
    """The same counts by each dimension alone: grouping sets, so rows are read once."""
    tall = evaluated.groupingSets([[c(d)] for d in dimensions], *dimensions).agg(F.grouping_id().alias("g"), *summary_columns())
    name = F.coalesce(*[F.when(F.col("g").bitwiseAND(1 << (len(dimensions) - 1 - i)) == 0, F.lit(d)) for i, d in enumerate(dimensions)])
    value = F.coalesce(*[c(d).cast("string") for d in dimensions], F.lit("unknown"))
    return tall.select(name.alias("dimension"), value.alias("value"), "total", "completed", "wins", "losses", "win_rate_pct", "avg_return_pct")


#: Hits and misses that every bucket begins with, what not being able to judge costs, the least number
#: of judged samples, and the largest weight.
PRIOR_HITS, PRIOR_MISSES, UNABLE_PENALTY, LEAST_SAMPLES, MOST_WEIGHT = 15, 15, 0.25, 30, 1.2


def skill_weights(samples: DataFrame) -> DataFrame:
    """skill and weight, from samples (skill, horizon, status: evaluated, observational or unable; hit).

    A skill and horizon is a bucket. With samples enough it scores the posterior hit rate, from -1 to 1, less a share
    of what it couldn't judge; buckets count by their evidence. A weight lies between 1 / 1.2 and 1.2; skills without
    a bucket that counts have 1.
    """
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    judged = c("status") == "evaluated"
    buckets = samples.groupBy("skill", "horizon").agg(n(judged).alias("evaluated"), n(judged & c("hit")).alias("hits"), n(c("status") == "unable").alias("unable"), n(c("status").isin("evaluated", "observational", "unable")).alias("ended"))
    prior = PRIOR_HITS + PRIOR_MISSES
    rate = (c("hits") + PRIOR_HITS) / (c("evaluated") + prior)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * rate - 1 - UNABLE_PENALTY * c("unable") / c("ended")))
    counts = c("evaluated") >= LEAST_SAMPLES
    evidence = F.when(counts, c("evaluated") / (c("evaluated") + prior))
    mean = F.sum(evidence * score) / F.sum(evidence)
    weight = F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(1 / MOST_WEIGHT), F.exp(F.log(F.lit(MOST_WEIGHT)) * mean)))
    return buckets.groupBy("skill").agg(F.sum("evaluated").alias("evaluated"), F.when(mean.isNotNull(), weight).otherwise(1.0).alias("weight"))


def invalidations(signals: DataFrame) -> DataFrame:
    """Each signal with the time of the next one of the opposite side for the same instrument."""
    side = ladder((c("action").isin("buy", "add"), 1), (c("action").isin("sell", "reduce"), -1))
    out = signals.withColumn("side", side).where("side is not null")
    w = Window.partitionBy("code").orderBy("ts", "id").rowsBetween(1, Window.unboundedFollowing)
    up, down = (F.first(F.when(c("side") == x, c("ts")), ignorenulls=True).over(w) for x in (1, -1))
    return out.withColumn("invalidated_at", F.when(c("side") == 1, down).otherwise(up))
