"""Time-series indicators over all instruments at once: one window specification, one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import bars, clip, history, ladder, rolling
from quantloom.functions.folds import running_fold

c = F.col


def moving_averages(df: DataFrame, periods: tuple = (5, 10, 20, 60)) -> DataFrame:
    """ma<n> over full frames; the longest falls back to ma20 for instruments with fewer rows."""
    out = df.withColumns({f"ma{n}": rolling(F.avg, c("close"), n) for n in periods})
    if 60 in periods and 20 in periods:
        rows = F.count("*").over(Window.partitionBy("code"))
        out = out.withColumn("ma60", F.when(rows >= 60, c("ma60")).otherwise(c("ma20")))
    return out


def partial_averages(df: DataFrame, periods: tuple = (5, 10, 20)) -> DataFrame:
    """ma<n> over as many rows as there are."""
    return df.withColumns({f"ma{n}": F.avg("close").over(bars(n)) for n in periods})


def bias(df: DataFrame, periods: tuple = (5, 10, 20)) -> DataFrame:
    """Distance from each average in percent, and whether the close is above it."""
    out = moving_averages(df, periods)
    return out.withColumns({f"bias{n}": (c("close") - c(f"ma{n}")) / c(f"ma{n}") * 100 for n in periods} | {f"above{n}": c("close") > c(f"ma{n}") for n in periods})


def volume_ratios(df: DataFrame) -> DataFrame:
    """Volume against the mean of the five, and of up to twenty, rows before."""
    five, twenty = F.avg("volume").over(bars(5, 1)), F.avg("volume").over(bars(20, 1))
    full = F.count("volume").over(bars(5, 1)) == 5
    return df.withColumns({"volume_ratio": F.coalesce(F.when(full & (five > 0), c("volume") / five), F.lit(1.0)), "volume_ratio_20d": F.when(twenty > 0, c("volume") / twenty)})


def true_range(df: DataFrame, n: int = 20) -> DataFrame:
    """Mean true range of n rows in percent of the close; the first row has no gap."""
    before = F.lag("close").over(history())
    out = df.withColumn("tr", F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before)))
    return out.withColumn(f"atr_{n}_pct", F.when(c("close") > 0, rolling(F.avg, c("tr"), n) / c("close") * 100)).drop("tr")


def volatility(df: DataFrame, n: int = 20) -> DataFrame:
    """Yearly standard deviation of the n - 1 returns within n closes, in percent."""
    out = df.withColumn("ret", c("close") / F.lag("close").over(history()) - 1)
    return out.withColumn(f"volatility_{n}d_pct", rolling(F.stddev_samp, c("ret"), n - 1) * F.sqrt(F.lit(252.0)) * 100).drop("ret")


def drawdown(df: DataFrame, n: int = 20) -> DataFrame:
    """Deepest fall from a running peak within the last n closes, in percent, at most 0."""
    closes = F.collect_list("close").over(bars(n))
    fold = "aggregate(closes, named_struct('peak', -1e308D, 'low', 0D), (a, x) -> named_struct('peak', greatest(a.peak, x), 'low', least(a.low, x / greatest(a.peak, x) - 1)), a -> a.low * 100)"
    return df.withColumn("closes", closes).withColumn(f"max_drawdown_{n}d_pct", F.when(F.size("closes") == n, F.expr(fold))).drop("closes")


def shape(df: DataFrame) -> DataFrame:
    """Range of the last 20 rows, the high before, the breakout above it, body and pullback."""
    high, low, before = F.max("high").over(bars(20)), F.min("low").over(bars(20)), F.max("high").over(bars(20, 1))
    return moving_averages(df, (20,)).withColumns({
        "range_20d_pct": (high / low - 1) * 100, "prev_high_20d": before, "breakout_20d_pct": (c("close") / before - 1) * 100,
        "body_pct": (c("close") / c("open") - 1) * 100, "pullback_ma20_pct": (c("close") / c("ma20") - 1) * 100,
    })


def consolidation(df: DataFrame, longest: int = 20, percent: float = 12.0) -> DataFrame:
    """The largest d from 2 to `longest` for which the range of the d rows before is narrow; 0 if
    none, null without a row before."""
    days = []
    for d in range(2, longest + 1):
        w = bars(d, 1)
        narrow = (F.count("close").over(w) == d) & ((F.max("high").over(w) / F.min("low").over(w) - 1) * 100 <= percent)
        days.append(F.when(narrow, F.lit(d)))
    return df.withColumn("consolidation_days", F.when(F.lag("close").over(history()).isNotNull(), F.coalesce(F.greatest(*days), F.lit(0))))


def change_60d(df: DataFrame) -> DataFrame:
    """Against the close 60 rows before, or the first."""
    first = F.first("close").over(history().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("change_60d", (c("close") / F.coalesce(F.lag("close", 60).over(history()), first) - 1) * 100)


def trend_state(df: DataFrame) -> DataFrame:
    """Order of the averages of 5, 10 and 20 rows; strong if their spread is wide and grows."""
    # A rising spread is measured against the slow average, a falling one against the fast.
    spread = F.when(c("ma5") < c("ma20"), (c("ma20") - c("ma5")) / c("ma5")).otherwise((c("ma5") - c("ma20")) / c("ma20")) * 100
    out = moving_averages(df, (5, 10, 20)).withColumn("spread", spread)
    fast, slow = F.lag("ma5", 4).over(history()), F.lag("ma20", 4).over(history())
    before = F.when(c("ma5") < c("ma20"), (slow - fast) / fast).otherwise((fast - slow) / slow) * 100
    wide = (c("spread") > 5) & (c("spread") > before)
    up, down = (c("ma5") > c("ma10")) & (c("ma10") > c("ma20")), (c("ma5") < c("ma10")) & (c("ma10") < c("ma20"))
    known = c("ma20").isNotNull()
    return out.withColumn("trend", F.when(known, ladder((up & wide, "STRONG_BULL"), (up, "BULL"), (down & wide, "STRONG_BEAR"), (down, "BEAR"), ((c("ma5") > c("ma10")) & (c("ma10") <= c("ma20")), "WEAK_BULL"), ((c("ma5") < c("ma10")) & (c("ma10") >= c("ma20")), "WEAK_BEAR"), otherwise="CONSOLIDATION"))).drop("spread")


def edge_cross(df: DataFrame, x: str, level: str) -> DataFrame:
    """up where x rises above the level from it or below, down where it falls likewise."""
    gap, before = c(x) - c(level), F.lag(c(x) - c(level)).over(history())
    return df.withColumn("cross", ladder(((before <= 0) & (gap > 0), "up"), ((before >= 0) & (gap < 0), "down")))


def simple_rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """From plain means of gains and losses; null without losses or enough rows."""
    out = df.withColumn("d", c("close") - F.lag("close").over(history()))
    gain = rolling(F.avg, F.when(c("d").isNotNull(), F.greatest(c("d"), F.lit(0.0))), n)
    loss = rolling(F.avg, F.when(c("d").isNotNull(), F.greatest(-c("d"), F.lit(0.0))), n)
    rsi = 100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))
    out = out.withColumn("rsi", rsi)
    return out.withColumn("rsi_status", ladder((c("rsi") <= 35, "oversold"), (c("rsi") >= 70, "overbought"), otherwise="neutral")).drop("d")


def _ewm(before: Column, x: Column, alpha: float) -> Column:
    """The exponential mean after x: x itself at the start; a null x leaves it as it is."""
    return F.when(x.isNull(), before).when(before.isNull(), x).otherwise(x * alpha + before * (1 - alpha))


def _means(df: DataFrame, alphas: dict[str, tuple[str, float]]) -> DataFrame:
    """df with exponential means: name -> (column, alpha). A name may read one that stands before it."""
    start = {name: F.lit(None).cast("double") for name in alphas}

    def step(acc: Column, row: Column) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for name, (x, alpha) in alphas.items():
            out[name] = _ewm(acc[name], out[x] if x in out else row[x].cast("double"), alpha)
        return out

    return running_fold(df, ["code"], ["date"], start, step, list(alphas))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """dif, the fast mean of closes less the slow one; dea, its own mean; and twice their distance."""
    start = {x: F.lit(None).cast("double") for x in ("f", "s", "dif", "dea")}

    def step(acc: Column, row: Column) -> dict[str, Column]:
        x = row["close"].cast("double")
        f, s = _ewm(acc["f"], x, 2 / (fast + 1)), _ewm(acc["s"], x, 2 / (slow + 1))
        return {"f": f, "s": s, "dif": f - s, "dea": _ewm(acc["dea"], f - s, 2 / (signal + 1))}

    return running_fold(df, ["code"], ["date"], start, step, ["dif", "dea"]).withColumn("macd", 2 * (c("dif") - c("dea")))


def macd_signal(df: DataFrame) -> DataFrame:
    """Crosses of DIF and DEA or of DIF and zero, then which side they are on; between the sides it counts
    as bullish, and so does everything before the slow average's number of rows."""
    out, w = macd(df), history()
    d0, d1 = F.lag(c("dif") - c("dea")).over(w), c("dif") - c("dea")
    z0, z1 = F.lag("dif").over(w), c("dif")
    golden, death = (d0 <= 0) & (d1 > 0), (d0 >= 0) & (d1 < 0)
    return out.withColumn("signal", ladder((golden & (z1 > 0), "GOLDEN_CROSS_ZERO"), ((z0 <= 0) & (z1 > 0), "CROSSING_UP"), (golden, "GOLDEN_CROSS"), (death, "DEATH_CROSS"), ((z0 >= 0) & (z1 < 0), "CROSSING_DOWN"), ((z1 > 0) & (c("dea") > 0), "BULLISH"), ((z1 < 0) & (c("dea") < 0), "BEARISH"), otherwise="BULLISH")).withColumn("signal", F.when(F.row_number().over(w) >= 26, c("signal")).otherwise("BULLISH"))


def wilder_rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """From exponential means, where the first change counts as 0; 50 where nothing moved."""
    change = F.coalesce(c("close") - F.lag("close").over(history()), F.lit(0.0))
    moved = df.withColumns({"__up": F.greatest(change, F.lit(0.0)), "__down": F.greatest(-change, F.lit(0.0))})
    out = _means(moved, {"__gain": ("__up", 1 / n), "__loss": ("__down", 1 / n)})
    gain, loss = c("__gain"), c("__loss")
    rsi = F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return out.withColumn("rsi", rsi).drop("__up", "__down", "__gain", "__loss")


def kdj(df: DataFrame, n: int = 9, k: int = 3, d: int = 3) -> DataFrame:
    """Place of the close in the range of n rows (50 where there is none), smoothed twice."""
    low, high = rolling(F.min, c("low"), n), rolling(F.max, c("high"), n)
    rsv = F.when(high == low, 50.0).otherwise((c("close") - low) / (high - low) * 100)
    out = df.withColumn("rsv", F.when(low.isNotNull(), rsv)).where(c("rsv").isNotNull())
    out = _means(out, {"k": ("rsv", 1 / k), "d": ("k", 1 / d)})
    return out.withColumn("j", 3 * c("k") - 2 * c("d"))


def cci(df: DataFrame, n: int = 14) -> DataFrame:
    """Distance of the typical price from its mean, over 0.015 times the mean deviation."""
    out = df.withColumn("tp", (c("high") + c("low") + c("close")) / 3)
    out = out.withColumns({"mean": rolling(F.avg, c("tp"), n), "tps": F.collect_list("tp").over(bars(n))})
    out = out.withColumn("dev", F.expr(f"aggregate(tps, 0D, (a, x) -> a + abs(x - mean)) / {n}"))
    return out.withColumn("cci", (c("tp") - c("mean")) / F.nullif(0.015 * c("dev"), F.lit(0.0))).drop("tp", "mean", "tps", "dev")


def _last_macd(closes: str, least_rows: int = 35) -> Column:
    """Status of an ordered array of closes: bullish above the signal line and zero, bearish below both. A fold on
    the JVM over one instrument's history."""
    step = "named_struct('f', x * (2D / 13) + a.f * (1 - 2D / 13), 's', x * (2D / 27) + a.s * (1 - 2D / 27))"
    fold = f"aggregate(slice({closes}, 2, size({closes})), named_struct('f', {closes}[0], 's', {closes}[0], 'd', 0D), (a, x) -> transform(array({step}), e -> named_struct('f', e.f, 's', e.s, 'd', (e.f - e.s) * 0.2D + a.d * (1 - 0.2D)))[0])"
    m = F.expr(fold)
    dif = m["f"] - m["s"]
    return F.when(F.size(closes) < least_rows, "neutral").otherwise(ladder(((dif > m["d"]) & (dif > 0), "bullish"), ((dif < m["d"]) & (dif < 0), "bearish"), otherwise="neutral"))


def macd_status(df: DataFrame, least_rows: int = 35) -> DataFrame:
    """code, macd_status of the last row."""
    closes = df.where(c("close").isNotNull()).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("x"))
    return closes.withColumn("x", F.transform("x", lambda e: e["close"].cast("double"))).select("code", _last_macd("x", least_rows).alias("macd_status"))


def signal_score() -> Column:
    """50 and bonuses for order, place, momentum and exhaustion, from the columns of daily_features()."""
    change = c("change_60d")
    score = F.lit(50.0) + F.when(c("ma_bullish"), 14.0).otherwise(0.0) + F.when(c("price_above_ma20"), 10.0).otherwise(0.0)
    score = score + ladder((c("macd_status") == "bullish", 12.0), (c("macd_status") == "bearish", -12.0), otherwise=0.0)
    drift = F.when((change >= 0) & (change <= 35), F.least(change * 0.35, F.lit(12.0))).when(change > 60, -F.least((change - 60) * 0.20, F.lit(12.0))).when(change < -25, -F.least(F.abs(change + 25) * 0.25, F.lit(10.0))).otherwise(0.0)
    return clip(score + drift + ladder((c("rsi_status") == "oversold", 4.0), (c("rsi_status") == "overbought", -6.0), otherwise=0.0), 0, 100)


def _last_consolidation(bars_: str, longest: int = 20, percent: float = 12.0) -> Column:
    """consolidation_days of the last of an array of bars: as consolidation()."""
    d_before = lambda d: F.slice(bars_, F.size(bars_) - d, d)
    narrow = lambda d: (
        F.forall(d_before(d), lambda b: b["close"].isNotNull()) & ((F.array_max(F.transform(d_before(d), lambda b: b["high"])) / F.array_min(F.transform(d_before(d), lambda b: b["low"])) - 1) * 100 <= percent)
    )
    days = F.filter(F.sequence(F.lit(2), F.least(F.lit(longest), F.size(bars_) - 1)), narrow)
    known = (F.size(bars_) > 1) & F.try_element_at(bars_, F.lit(-2))["close"].isNotNull()
    return F.when(known, F.when(F.size(bars_) > 2, F.coalesce(F.array_max(days), F.lit(0))).otherwise(0))


def _last_drawdown(bars_: str, n: int = 20) -> Column:
    """max_drawdown of the last of an array of bars: as drawdown()."""
    last = F.transform(F.slice(bars_, F.greatest(F.size(bars_) - n + 1, F.lit(1)), n), lambda b: b["close"].cast("double"))
    start = F.struct(F.lit(-1e308).alias("peak"), F.lit(0.0).alias("low"))
    fold = F.aggregate(last, start, lambda a, x: F.struct(F.greatest(a["peak"], x).alias("peak"), F.least(a["low"], x / F.greatest(a["peak"], x) - 1).alias("low")), lambda a: a["low"] * 100)
    return F.when((F.size(last) == n) & F.forall(last, lambda x: x.isNotNull()), fold)


def daily_features(df: DataFrame, longest: int = 61) -> DataFrame:
    """The latest row of each instrument with the features that screening reads.

    One scan and one exchange. What needs the whole history (quality, MACD, the first close) is told by the
    aggregate that lists an instrument's bars; frames of the latest row reach back over `longest` rows at most,
    so windows run over the list's end alone, where it is.
    """
    first = ["date", "close", "high", "low"]
    listed = F.sort_array(F.collect_list(F.struct(*first, *[x for x in df.columns if x not in ("code", *first)]))).alias("__bars")
    whole = df.groupBy("code").agg(listed, F.count("close").alias("daily_data_points"), *_quality_sums())
    closes = F.transform(F.filter("__bars", lambda b: b["close"].isNotNull()), lambda b: b["close"].cast("double"))
    score, flags = _quality()
    n = F.size("__bars")
    before = F.coalesce(F.when(n > 60, F.get("__bars", n - 61)["close"]), F.get("__bars", F.lit(0))["close"])
    whole = whole.withColumn("__closes", closes).select(
        "code", F.slice("__bars", F.greatest(n - longest + 1, F.lit(1)), longest).alias("__end"),
        F.struct("daily_data_points", _last_consolidation("__bars").alias("consolidation_days"), _last_drawdown("__bars").alias("max_drawdown_20d_pct"), _last_macd("__closes").alias("macd_status"), score, flags, before.alias("__before")).alias("__whole"))
    out = whole.select("code", "__whole", F.size("__end").alias("__size"), F.posexplode("__end").alias("__at", "__bar"))
    out = out.select("code", F.when(c("__at") == c("__size") - 1, c("__whole")).alias("__whole"), "__bar.*").select(*df.columns, "__whole")
    for step in (volume_ratios, true_range, volatility, simple_rsi, shape):
        out = step(out)
    # ma60 is null before 60 rows here; moving_averages() has the fallback.
    out = out.withColumns({f"ma{n}": rolling(F.avg, c("close"), n) for n in (5, 60)}).where("__whole is not null")
    out = out.select(*[x for x in out.columns if x != "__whole"], "__whole.*").withColumn("change_60d", (c("close") / c("__before") - 1) * 100).drop("__before")
    known = lambda x: F.coalesce(x, F.lit(False))
    out = out.withColumns({"ma_bullish": known((c("ma5") >= c("ma20")) & (c("ma20") >= c("ma60"))), "price_above_ma20": known(c("close") >= c("ma20"))})
    return out.withColumn("signal_score", signal_score())


def _quality_sums() -> list[Column]:
    """What the quality of an instrument's bars is told from: bars without a close are left out, and open, high and
    low are filled from it."""
    here, full = c("close").isNotNull(), {x: F.coalesce(x, "close") for x in ("open", "high", "low")}
    bad_range = (full["high"] < full["low"]) | (full["high"] < full["open"]) | (full["high"] < c("close")) | (full["low"] > full["open"]) | (full["low"] > c("close"))
    only = lambda x: F.when(here, x)
    return [
        F.count("close").alias("__rows"), F.avg(only(c("volume").isNull().cast("double"))).alias("__no_volume"), F.max(only(c("volume") < 0)).alias("__negative"), F.max(only(bad_range)).alias("__invalid"),
        F.max(only(F.least(*full.values(), c("close")) <= 0)).alias("__low_price"),
    ]


def _quality(stale: bool = False, source_errors: int = 0) -> tuple[Column, Column]:
    rules = [
        (c("__rows") < 30, F.lit(35.0), "short_history_lt30"), ((c("__rows") >= 30) & (c("__rows") < 60), F.lit(15.0), "short_history_lt60"), (c("__no_volume") > 0, F.least(c("__no_volume") * 20, F.lit(10.0)), "incomplete_volume"), (c("__negative"), F.lit(20.0), "negative_volume"),
        (c("__invalid"), F.lit(30.0), "invalid_ohlc"), (c("__low_price"), F.lit(35.0), "non_positive_price"), (F.lit(stale), F.lit(25.0), "stale_cache"), (F.lit(source_errors > 0), F.lit(float(min(source_errors * 5, 20))), "fallback_errors"),
    ]
    lost = sum((F.when(cond, points).otherwise(0.0) for cond, points, _ in rules), F.lit(0.0))
    return clip(100 - lost, low=0).alias("daily_quality_score"), F.concat_ws(";", *[F.when(cond, F.lit(name)) for cond, _, name in rules]).alias("daily_quality_flags")


def bar_quality(df: DataFrame, stale: bool = False, source_errors: int = 0) -> DataFrame:
    """Per instrument with a close: daily_quality_score and daily_quality_flags (joined by ;)."""
    return df.groupBy("code").agg(*_quality_sums()).where("__rows > 0").select("code", *_quality(stale, source_errors))


def candles(df: DataFrame) -> DataFrame:
    """Flags of single and double candle patterns."""
    w = history()
    body, span = F.abs(c("close") - c("open")), c("high") - c("low")
    o1, c1 = F.lag("open").over(w), F.lag("close").over(w)
    upper, lower = c("high") - F.greatest("open", "close"), F.least("open", "close") - c("low")
    return df.withColumns({
        "doji": (span > 0) & (body <= 0.1 * span), "hammer": (span > 0) & (lower >= 2 * body) & (upper <= body) & (body > 0), "shooting_star": (span > 0) & (upper >= 2 * body) & (lower <= body) & (body > 0),
        "bullish_engulfing": F.coalesce((c1 < o1) & (c("close") > c("open")) & (c("close") >= o1) & (c("open") <= c1), F.lit(False)), "bearish_engulfing": F.coalesce((c1 > o1) & (c("close") < c("open")) & (c("close") <= o1) & (c("open") >= c1), F.lit(False)),
    })


def point_in_time(df: DataFrame) -> DataFrame:
    """Return, 20-row mean amount, coefficient of variation and 14-row true range with strict nulls."""
    w = history()
    before = F.lag("close").over(w)
    out = df.withColumn("return_1d", F.try_divide(c("close"), before) - 1)
    out = out.withColumn("tr", F.when(before.isNull(), c("high") - c("low")).otherwise(F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))))
    return out.withColumns({"adv20": rolling(F.avg, c("amount"), 20), "variation_20": F.try_divide(rolling(F.stddev_pop, c("close"), 20), rolling(F.avg, c("close"), 20)), "atr14": rolling(F.avg, c("tr"), 14)}).drop("tr")


def adjusted(df: DataFrame, factors: DataFrame, forward: bool = True) -> DataFrame:
    """Prices times their date's factor, or the next known one; forward prices relative to the latest."""
    out = df.join(factors, ["code", "date"], "left")
    ahead = F.first("factor", ignorenulls=True).over(history().rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("factor", F.coalesce(ahead, F.lit(1.0)))
    if forward:
        latest = factors.groupBy("code").agg(F.max_by("factor", "date").alias("latest"))
        out = out.join(latest, "code", "left").withColumn("factor", c("factor") / F.coalesce("latest", F.lit(1.0))).drop("latest")
    return out.withColumns({x: c(x) * c("factor") for x in ("open", "high", "low", "close")})
