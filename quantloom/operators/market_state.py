"""The market's state day by day: who counts, raw metrics, scores, smoothed emotion and regime, in one plan.

Inputs:
  calendar  trade_date, is_open
  master    entity, asset_type, exchange, board, list_date, delist_date
  listing   entity, effective_from, effective_to (exclusive; null is open), listing_status
  status    entity, date, instrument_status, is_tradable
  bars      entity, date, trading_status, open, high, low, close, prev_close, price_limit_up, price_limit_down,
            volume, amount; and, if present, factor (close * factor is comparable over time), shares and float_shares
  index     date, close of the benchmark
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import clip

c = F.col
#: The scope, the weights of metrics in a dimension and of dimensions in the whole, the metrics whose
#: rise is bad news, the bounds of coverage.
EXCHANGES, BOARDS = ("SH", "SZ"), ("MAIN", "STAR", "CHINEXT")
DIMENSIONS = {
    "breadth": {"net_advance_ratio": 30, "above_ma20_ratio": 25, "above_ma60_ratio": 15, "new_high_low_spread_20": 15, "median_return": 15},
    "limit": {"limit_up_down_spread": 30, "limit_break_rate": 25, "max_streak_height": 20, "promotion_rate": 25},
    "risk_appetite": {"prior_limit_up_premium": 30, "high_turnover_return_spread": 25, "small_large_return_spread": 20, "top_amount20_median_return": 25},
    "liquidity": {"amount_ratio_20": 60, "rising_amount_share": 40},
    "safety": {"tail_loss_ratio": 40, "return_dispersion_mad": 30, "benchmark_realized_vol_20": 30},
}
TOTAL = {"breadth": 25, "limit": 30, "risk_appetite": 20, "liquidity": 15, "safety": 10}
NEGATIVE = ("limit_break_rate", "tail_loss_ratio", "return_dispersion_mad", "benchmark_realized_vol_20")
LEAST_COVERAGE, MOST_EXCLUDED, MOST_EXCLUDED_COUNT = 0.998, 0.002, 10
LONGEST, LEAST, DEVIATION, TINY = 252, 60, 1.4826, 1e-12
BANDS = ("PANIC", "WEAK", "RANGE", "ACTIVE", "OVERHEATED")
STATUSES = ("ACTIVE", "ST", "SUSPENDED", "DELISTED", "NOT_LISTED")
TRADING = ("TRADED", "SUSPENDED", "NO_DATA", "NOT_LISTED")


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def freeze_universe(calendar: DataFrame, master: DataFrame, listing: DataFrame, status: DataFrame, bars: DataFrame) -> DataFrame:
    """One row for each stock in scope and open day, with its bar: flags listed, valid, observable, ruled (it has
    usable price limits), reasons (sorted), problem.

    A day has exactly one listing interval of a stock; intervals are few, so they come along as an array and no
    range join is needed. Problems, which make a day's metrics null: listing_interval, status_contract,
    status_conflict (the status says unlisted and the interval listed, or the reverse), bar_contract.
    """
    scope = master.where((c("asset_type") == "stock") & c("exchange").isin(*EXCHANGES) & c("board").isin(*BOARDS))
    spans = listing.groupBy("entity").agg(F.collect_list(F.struct("effective_from", "effective_to", "listing_status")).alias("spans"))
    days = calendar.where("is_open").select(c("trade_date").alias("date")).distinct()
    # One row: the first and the last open day.
    bounds = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null")
    every = scope.join(spans, "entity", "left").select("entity", "list_date", "delist_date", F.coalesce("spans", F.array().cast(dict(spans.dtypes)["spans"])).alias("spans"))
    grid = every.join(F.broadcast(bounds), F.lit(True)).withColumn("date", F.explode(F.sequence("a", "b"))).join(F.broadcast(days), "date", "left_semi")
    now = F.filter("spans", lambda s: (s["effective_from"] <= c("date")) & (s["effective_to"].isNull() | (c("date") < s["effective_to"])))
    grid = grid.withColumn("now", now)
    rows = grid.join(status.select("entity", "date", "instrument_status", "is_tradable", F.lit(True).alias("has_status")), ["entity", "date"], "left")
    rows = rows.join(bars.withColumn("has_bar", F.lit(True)), ["entity", "date"], "left")
    listed = _true((F.element_at("now", 1)["listing_status"] == "LISTED") & (c("list_date") <= c("date")) & (c("delist_date").isNull() | (c("date") < c("delist_date"))))
    rows = rows.withColumn("listed", F.when(F.size("now") > 0, listed).otherwise(False))
    suspended = _true(c("instrument_status") == "SUSPENDED") | _true(c("trading_status") == "SUSPENDED")
    ordered = (c("low") > 0) & (c("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= c("high")) & (c("volume") >= 0) & (c("amount") >= 0)
    whole = c("open").isNotNull() & c("high").isNotNull() & c("low").isNotNull() & c("close").isNotNull()
    priced = _true((c("trading_status") == "TRADED") & whole & ordered)
    rows = rows.withColumns({"suspended": suspended, "priced": priced})
    observable = c("listed") & c("priced") & ~c("suspended") & _true(c("is_tradable")) & _true(c("prev_close") > 0)
    rows = rows.withColumn("observable", observable)
    ruled = c("observable") & _true((c("price_limit_down") > 0) & (c("price_limit_up") > c("price_limit_down")))
    new = _true(c("list_date") == c("date"))
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(c("has_status").isNull(), F.lit("STATUS_UNKNOWN")), F.when(c("suspended"), F.lit("SUSPENDED")), F.when(_true(c("instrument_status") == "ST"), F.lit("ST")),
        F.when(new, F.lit("NEW_LISTING")), F.when(c("listed") & ~(c("priced") | c("suspended")), F.lit("BAR_UNAVAILABLE")))))
    unlisted = c("instrument_status").isin("NOT_LISTED", "DELISTED")
    problem = (
        F.when(F.size("now") != 1, "listing_interval")
        .when(c("has_status") & (~_true(c("instrument_status").isin(*STATUSES)) | c("is_tradable").isNull()), "status_contract")
        .when(c("has_status") & (unlisted == c("listed")), "status_conflict")
        .when(c("has_bar") & ~_true(c("trading_status").isin(*TRADING)), "bar_contract")
    )
    rows = rows.withColumns({"valid": c("listed") & (c("priced") | c("suspended")), "ruled": ruled, "new_listing": new, "reasons": reasons, "problem": problem})
    return rows.drop("spans", "now", "list_date", "delist_date", "has_bar", "has_status", "instrument_status", "is_tradable", "trading_status", "a", "b")


def _member_columns(universe: DataFrame) -> DataFrame:
    """Each stock and day with what the day's metrics add up: limit states, streaks, returns, means."""
    has = lambda x: x in universe.columns
    w = Window.partitionBy("entity").orderBy("date")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    up, down = c("ruled") & (c("close") >= c("price_limit_up")), c("ruled") & (c("close") <= c("price_limit_down"))
    broken = c("ruled") & (c("high") >= c("price_limit_up")) & (c("close") < c("price_limit_up"))
    u = universe.withColumns({"up": _true(up), "down": _true(down), "broken": _true(broken)})
    # A streak begins after a day without limit-up, or with a listing; one that begins at a gap is unknown.
    known = c("listed") & c("ruled")
    begins = ~c("up") | c("new_listing")
    u = u.withColumn("island", F.sum(F.when(begins, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("entity", "island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    sound = F.first(F.when(begins, c("up") | known).otherwise(False)).over(island)
    u = u.withColumn("streak", F.when(c("up") & sound, F.sum(c("up").cast("int")).over(island)))
    comparable = F.when(c("listed") & c("priced") & ~c("suspended"), c("close") * (F.coalesce("factor", F.lit(1.0)) if has("factor") else F.lit(1.0)))
    u = u.withColumn("level", comparable)
    back = F.lag("level").over(w)
    u = u.withColumns({"ret": F.when(c("observable") & (back > 0), c("level") / back - 1), "was_up": F.lag("up").over(w), "was_streak": F.lag("streak").over(w)})
    full = lambda n, x: F.when(F.count("level").over(last(n)) == n, x)
    means = {f"over{n}": full(n, (c("level") > F.avg("level").over(last(n))).cast("int")) for n in (20, 60)}
    edge = {"new_high": full(20, (c("level") >= F.max("level").over(last(20))).cast("int")), "new_low": full(20, (c("level") <= F.min("level").over(last(20))).cast("int"))}
    u = u.withColumns(means | edge)
    u = u.withColumns({
        "turnover": F.when(c("ret").isNotNull() & (c("shares") > 0), c("volume") / c("shares")) if has("shares") else F.lit(None).cast("double"),
        "cap": F.when(c("ret").isNotNull() & (c("float_shares") > 0), c("close") * c("float_shares")) if has("float_shares") else F.lit(None).cast("double"),
        "paid": F.when(c("valid"), c("amount")), "moved": F.when(c("observable"), (c("high") - c("low")) / c("prev_close")),
    })
    day = Window.partitionBy("date")
    place = lambda x, n: F.when(c(x).isNotNull(), F.row_number().over(day.orderBy(c(x).desc_nulls_last(), "entity")) <= n)
    few = lambda x, share: F.floor(F.count(x).over(day) * share)
    low = F.when(c("cap").isNotNull(), F.row_number().over(day.orderBy(c("cap").asc_nulls_last(), "entity")) <= few("cap", 0.3))
    return u.withColumns({"top_paid": place("paid", 20), "high_turnover": place("turnover", few("turnover", 0.2)), "large": place("cap", few("cap", 0.3)), "small": low, "middle": F.median("ret").over(day)})


def raw_metrics(universe: DataFrame, index: DataFrame) -> DataFrame:
    """One row for each open day: counts, metrics (null where the day can't tell), and flags.

    A day with problems has no metric and the flag SCOPE_INVALID. SCOPE_SLA_FAILED marks a day whose valid bars
    cover too little of the listed stocks, HISTORY_GAP one with a streak of unknown length.
    """
    m = _member_columns(universe)
    n = lambda x: F.count_if(_true(x))
    ratio = lambda a, b: F.when(b > 0, a / b)
    when = lambda flag, x: F.when(_true(c(flag)), c(x))
    follow = c("was_up") & (c("was_streak") >= 2) & c("observable") & c("ruled")
    d = m.groupBy("date").agg(
        n(c("listed")).alias("listed_count"), n(c("valid")).alias("bar_valid_count"), n(c("ruled")).alias("limit_rule_count"), n(c("problem").isNotNull()).alias("problems"),
        n(c("up")).alias("ups"), n(c("down")).alias("downs"), n(c("broken")).alias("breaks"), n(c("up") & c("streak").isNull()).alias("unknown"), F.max("streak").alias("highest"), n(c("streak") >= 2).alias("long_streaks"),
        n(c("was_up") & c("was_streak").isNull()).alias("prior_unknown"), n(follow).alias("candidates"), n(follow & c("up")).alias("promoted"), F.max(c("was_up").isNotNull()).alias("has_prior"),
        F.sum("paid").alias("market_amount_cny"), F.count("paid").alias("paid_count"), F.sum(when("top_paid", "paid")).alias("top_paid"),
        n(c("listed") & (c("suspended") | _true(c("volume") == 0))).alias("still"), n(c("listed") & c("valid") & ~F.array_contains("reasons", "STATUS_UNKNOWN")).alias("told"), F.median("moved").alias("median_amplitude"),
        F.count("ret").alias("valid_return_count"), n(c("ret") > 0).alias("advance_count"), n(c("ret") < 0).alias("decline_count"), n(c("ret") == 0).alias("flat_count"), F.median("ret").alias("median_return"),
        F.avg("over20").alias("above_ma20_ratio"), F.avg("over60").alias("above_ma60_ratio"), F.avg(c("new_high") - c("new_low")).alias("new_high_low_spread_20"),
        F.avg(when("was_up", "ret")).alias("prior_limit_up_premium"), (F.median(when("high_turnover", "ret")) - F.median("ret")).alias("high_turnover_return_spread"),
        (F.avg(when("small", "ret")) - F.avg(when("large", "ret"))).alias("small_large_return_spread"), F.median(when("top_paid", "ret")).alias("top_amount20_median_return"),
        F.sum(F.when(c("ret").isNotNull(), c("paid"))).alias("traded"), F.sum(F.when(c("ret") > 0, c("paid"))).alias("rising"), F.median(F.abs(c("ret") - c("middle"))).alias("return_dispersion_mad"), n(c("ret") <= -0.05).alias("tails"),
    )
    touched = c("ups") + c("breaks")
    ruled = c("limit_rule_count") > 0
    d = d.withColumns({
        "limit_up_count": F.when(ruled, c("ups")), "limit_down_count": F.when(ruled, c("downs")), "limit_break_count": F.when(ruled, c("breaks")),
        "limit_up_down_spread": ratio(c("ups") - c("downs"), c("limit_rule_count")), "limit_break_rate": ratio(c("breaks"), touched),
        "max_streak_height": F.when(ruled & (c("unknown") == 0), F.coalesce("highest", F.lit(0))), "streak_stock_count": F.when(ruled & ((c("ups") == 0) | (c("unknown") < c("ups"))), c("long_streaks")),
        "promotion_rate": F.when(_true(c("has_prior")) & (c("prior_unknown") == 0), ratio(c("promoted"), c("candidates"))),
        "top20_amount_concentration": ratio(c("top_paid"), c("market_amount_cny")), "zero_or_suspended_ratio": F.when(c("told") == c("listed_count"), ratio(c("still"), c("listed_count"))),
        "net_advance_ratio": ratio(c("advance_count") - c("decline_count"), c("valid_return_count")), "advance_decline_log": F.when(c("valid_return_count") > 0, F.log((c("advance_count") + 1) / (c("decline_count") + 1))),
        "rising_amount_share": ratio(F.coalesce("rising", F.lit(0.0)), c("traded")), "tail_loss_ratio": ratio(c("tails"), c("valid_return_count")),
    })
    d = _with_index(_with_amount_ratio(d), index)
    excluded = c("listed_count") - c("bar_valid_count")
    thin = (c("listed_count") > 0) & ((c("bar_valid_count") < LEAST_COVERAGE * c("listed_count")) | (excluded > MOST_EXCLUDED * c("listed_count")) | (excluded > MOST_EXCLUDED_COUNT))
    gap = (c("unknown") > 0) | (c("prior_unknown") > 0)
    flags = F.array_compact(F.array(F.when(gap, F.lit("HISTORY_GAP")), F.when(c("problems") > 0, F.lit("SCOPE_INVALID")), F.when(thin, F.lit("SCOPE_SLA_FAILED"))))
    sound = c("problems") == 0
    return d.select("date", *[F.when(sound, c(x)).alias(x) for x in METRICS], flags.alias("flags"))


#: What raw_metrics gives: counts first.
METRICS = (
    "listed_count", "bar_valid_count", "limit_rule_count", "valid_return_count", "advance_count", "decline_count", "flat_count", "limit_up_count", "limit_down_count", "limit_break_count", "streak_stock_count", "max_streak_height",
    "net_advance_ratio", "advance_decline_log", "median_return", "above_ma20_ratio", "above_ma60_ratio", "new_high_low_spread_20", "limit_up_down_spread", "limit_break_rate", "promotion_rate",
    "prior_limit_up_premium", "high_turnover_return_spread", "small_large_return_spread", "top_amount20_median_return", "market_amount_cny", "amount_ratio_20", "rising_amount_share", "top20_amount_concentration",
    "zero_or_suspended_ratio", "median_amplitude", "return_dispersion_mad", "tail_loss_ratio", "benchmark_realized_vol_20", "market_drawdown_20",
)


def _with_amount_ratio(days: DataFrame) -> DataFrame:
    """The day's amount over the mean of the last 20 days before it that have one. Days are few: one series."""
    told = days.where("market_amount_cny is not null").select("date", "market_amount_cny")
    w = Window.orderBy("date")
    past = told.withColumn("sum20", F.when(F.count("*").over(w.rowsBetween(-20, -1)) == 20, F.sum("market_amount_cny").over(w.rowsBetween(-20, -1))))
    mean = past.select("date", (c("sum20") / 20).alias("mean20"))
    return days.join(mean, "date", "left").withColumn("amount_ratio_20", F.when(c("mean20") > 0, c("market_amount_cny") / c("mean20")))


def _with_index(days: DataFrame, index: DataFrame) -> DataFrame:
    w = Window.orderBy("date")  # one row for each day
    frame = lambda n: w.rowsBetween(-(n - 1), 0)
    i = index.select("date", c("close").alias("i")).withColumn("r", c("i") / F.lag("i").over(w) - 1)
    volatility = F.when(F.count("r").over(frame(20)) == 20, F.stddev_samp("r").over(frame(20)) * F.sqrt(F.lit(252.0)))
    fall = F.when(F.count("i").over(frame(20)) == 20, c("i") / F.max("i").over(frame(20)) - 1)
    return days.join(i.select("date", volatility.alias("benchmark_realized_vol_20"), fall.alias("market_drawdown_20")), "date", "left")


def normalized_metrics(days: DataFrame, metrics: list[str], longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """date and, for each metric, 50 + z * 100 / 6 with z within 3: by the median and the median deviation of its
    last `longest` known values before the day, of which there must be `least`. Null stays null."""
    w = Window.partitionBy("metric").orderBy("date").rowsBetween(-longest, -1)
    tall = days.unpivot("date", [c(x).cast("double").alias(x) for x in metrics], "metric", "value").where("value is not null")
    middle = "(element_at({0}, cast((size({0}) + 1) div 2 as int)) + element_at({0}, cast(size({0}) div 2 + 1 as int))) / 2"
    tall = tall.withColumn("past", F.array_sort(F.collect_list("value").over(w))).where(F.size("past") >= least)
    tall = tall.withColumn("center", F.expr(middle.format("past"))).withColumn("far", F.expr("array_sort(transform(past, v -> abs(v - center)))")).withColumn("mad", F.expr(middle.format("far")))
    z = (c("value") - c("center")) / (DEVIATION * c("mad") + TINY) * F.when(c("metric").isin(*NEGATIVE), -1).otherwise(1)
    scored = tall.select("date", "metric", clip(50 + clip(z, -3, 3) * 100 / 6, 0, 100).alias("score"))
    return days.select("date").join(scored.groupBy("date").pivot("metric", metrics).agg(F.first("score")), "date", "left")


def weighted(weights: dict[str, int]) -> Column:
    """Sum of scores by their weights, which make 100; null if any score is, never weighted anew."""
    if sum(weights.values()) != 100:
        raise ValueError("weights must sum to 100")
    return sum((c(x) * k / 100 for x, k in weights.items()), F.lit(0.0))


def emotion_scores(days: DataFrame) -> DataFrame:
    """date, the five dimensions' scores and emotion_raw."""
    scores = normalized_metrics(days, [x for weights in DIMENSIONS.values() for x in weights])
    scores = scores.select("date", *[weighted(weights).alias(name) for name, weights in DIMENSIONS.items()])
    return scores.withColumn("emotion_raw", weighted(TOTAL))


def regimes(scores: DataFrame, x: str = "score", key: list[str] | None = None) -> DataFrame:
    """Each day with `emotion`, `regime`, `regime_before` and `trigger`.

    emotion: the day's score, halfway to the day before's emotion. Its band of 20 points is the regime at the
    start (INITIALIZED). Later another band becomes the regime at once if emotion is five points or more beyond
    the regime's border (BOUNDARY_JUMP_GE_5), else on its second day running (TWO_DAY_CONFIRM). A null score ends
    everything, and the next one starts anew; a score outside 0 to 100 is an error.
    One fold in the JVM over a series' days, a few thousand numbers.
    """
    key = key or []
    others = [f for f in scores.columns if f not in key]
    listed = scores.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("date", c(x).cast("double").alias("__x"), F.struct(*others).alias("__row")))).alias("days"))
    out_type = "array<struct<emotion:double,regime:int,regime_before:int,trigger:string>>"
    start = F.struct(F.lit(None).cast("double").alias("emotion"), F.lit(None).cast("int").alias("regime"), F.lit(None).cast("int").alias("rival"), F.array().cast(out_type).alias("out"))

    def step(state: Column, day: Column) -> Column:
        score = F.when(day["__x"].isNull() | day["__x"].between(0, 100), day["__x"]).otherwise(F.raise_error(F.lit("score outside [0, 100]")).cast("double"))
        emotion = F.when(state["emotion"].isNull(), score).otherwise((score + state["emotion"]) / 2)
        band, regime = F.least(F.floor(emotion / 20), F.lit(4)).cast("int"), state["regime"]
        beyond = F.when(band > regime, emotion - 20 * (regime + 1)).otherwise(20 * regime - emotion)
        trigger = (
            F.when(emotion.isNull(), F.lit(None).cast("string")).when(regime.isNull(), "INITIALIZED").when(band == regime, "NONE")
            .when(beyond >= 5, "BOUNDARY_JUMP_GE_5").when(band == state["rival"], "TWO_DAY_CONFIRM").otherwise("NONE")
        )
        turned = trigger.isin("BOUNDARY_JUMP_GE_5", "TWO_DAY_CONFIRM")
        now = F.when(emotion.isNotNull(), F.when(regime.isNull() | turned, band).otherwise(regime))
        told = F.struct(emotion.alias("emotion"), now.alias("regime"), F.when(turned, regime).alias("regime_before"), trigger.alias("trigger"))
        return F.struct(emotion.alias("emotion"), now.alias("regime"), F.when(band != now, band).alias("rival"), F.concat(state["out"], F.array(told)).alias("out"))

    folded = listed.withColumn("out", F.aggregate("days", start, step, lambda s: s["out"]))
    rows = folded.select(*key, F.inline(F.arrays_zip(c("days").alias("day"), c("out").alias("told"))))
    name = lambda band: F.when(c(band).isNotNull(), F.element_at(F.array(*map(F.lit, BANDS)), c(band) + 1))
    return rows.select(*key, "day.__row.*", c("told.emotion").alias("emotion"), name("told.regime").alias("regime"), name("told.regime_before").alias("regime_before"), c("told.trigger").alias("trigger"))


def evaluate_market(calendar: DataFrame, master: DataFrame, listing: DataFrame, status: DataFrame, bars: DataFrame, index: DataFrame) -> DataFrame:
    """From bars and listings to the regime: raw metrics, five scores, raw and smoothed emotion, regime, trigger."""
    days = raw_metrics(freeze_universe(calendar, master, listing, status, bars), index)
    return regimes(days.join(emotion_scores(days), "date"), "emotion_raw")
