"""Advice in words: the direction and position it means, what became of it, and summaries of that."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import ladder
from quantloom.operators.backtest import as_of, forward_bars

c = F.col
#: The words of each intent, words that negate, and what may stand between those and an intent.
INTENTS = {
    "bullish": ("买入", "加仓", "强烈买入", "增持", "建仓", "strong buy", "buy", "add"),
    "bearish": ("卖出", "减仓", "强烈卖出", "清仓", "strong sell", "sell", "reduce"),
    "hold": ("持有", "震荡观望", "洗盘观察", "持有观察", "hold", "range-bound watch", "shakeout watch", "hold and watch"),
    "wait": ("观望", "等待", "wait"),
}
NEGATIONS = ("not", "don't", "do not", "no", "never", "avoid", "不要", "不", "别", "勿", "没有")
CONNECTORS = ("建议", "应", "应当", "宜", "先", "再", "暂", "不必", "必须", "无需")
#: Characters before an intent that a negation reaches, and letters it may skip outside Chinese.
REACH, SKIP = 12, 6
PAUSES, CHINESE = re.compile("[，,。；;:!?！？]"), re.compile("[一-鿿]")


def _pattern(word: str) -> re.Pattern:
    """A word of Latin letters stands alone; Chinese has no word borders."""
    return re.compile(rf"(?<![a-zA-Z0-9_]){re.escape(word)}(?![a-zA-Z0-9_])" if re.search("[a-z]", word) else re.escape(word))


_WORDS = {intent: [_pattern(w) for w in words] for intent, words in INTENTS.items()}


def _bridges(gap: str, word: re.Pattern) -> bool:
    """Whether a negation reaches over the text between it and the word."""
    if not gap:
        return True
    if PAUSES.search(gap):
        return False
    if word.search(gap):
        return True
    return gap in CONNECTORS if CHINESE.search(gap) else len(gap) <= SKIP


def _negated(before: str, word: re.Pattern) -> bool:
    before = before.rstrip()
    if before.endswith(NEGATIONS):
        return True
    near = before[-REACH:]
    gaps = [near[near.rindex(n) + len(n) :].strip() for n in NEGATIONS if n in near]
    return any(_bridges(re.sub(r"\s", "", g) if CHINESE.search(g) else g, word) for g in gaps)


def _place(text: str, intent: str) -> int | None:
    """Where the intent is first expressed and not negated."""
    found = [next((m.start() for m in word.finditer(text) if not _negated(text[: m.start()], word)), None) for word in _WORDS[intent]]
    return min((x for x in found if x is not None), default=None)


def intent_places(advice: Column) -> Column:
    """bullish, bearish, hold, wait: where each intent first stands in the text, or null. Each text of an
    Arrow batch is read once, however many rows repeat it; nothing is shuffled."""

    @F.pandas_udf("struct<bullish:int,bearish:int,hold:int,wait:int>")
    def places(texts: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(texts)
        rows = pd.DataFrame([{i: _place(t, i) for i in INTENTS} for t in distinct], columns=list(INTENTS), dtype="Int32")
        return rows.iloc[codes].reset_index(drop=True)

    # Python's own white space goes, not only blanks.
    return places(F.lower(F.regexp_replace(F.coalesce(advice, F.lit("")), r"(?U)^\s+|\s+$", "")))


def with_direction(rows: DataFrame, advice: str = "advice") -> DataFrame:
    """Rows with `expects` (up, down, not_down, flat) and `position` (long, cash).

    Selling comes first, then waiting if it is said before buying and holding, then buying, then holding;
    everything else is flat and cash.
    """
    rows = rows.withColumn("__at", intent_places(c(advice)))
    bear, wait, bull, hold = (c(f"__at.{x}") for x in ("bearish", "wait", "bullish", "hold"))
    waits = wait.isNotNull() & (bull.isNull() | (wait < bull)) & (hold.isNull() | (wait < hold))
    expects = ladder((bear.isNotNull(), "down"), (waits, "flat"), (bull.isNotNull(), "up"), (hold.isNotNull(), "not_down"), otherwise="flat")
    return rows.withColumn("expects", expects).withColumn("position", F.when(c("expects").isin("up", "not_down"), "long").otherwise("cash")).drop("__at")


def outcome(change: Column, expects: Column, band: float) -> Column:
    """win, loss or neutral by the change in percent; null without one. A flat forecast is never neutral."""
    band = abs(band)
    up = ladder((change >= band, "win"), (change <= -band, "loss"), otherwise="neutral")
    down = ladder((change <= -band, "win"), (change >= band, "loss"), otherwise="neutral")
    not_down = ladder((change >= 0, "win"), (change <= -band, "loss"), otherwise="neutral")
    return F.when(change.isNotNull(), F.when(expects == "up", up).when(expects == "down", down).when(expects == "not_down", not_down).otherwise(ladder((F.abs(change) <= band, "win"), otherwise="loss")))


def _ahead(rows: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """Rows with `start`, the close of the last bar on or before their day, and `ahead`, the n bars after that one."""
    if n <= 0:
        raise ValueError("the window must have days")
    after = forward_bars(bars.select("code", "date", "high", "low", "close"), n).select("code", c("date").alias("asof_date"), c("close").alias("start"), "ahead")
    return as_of(rows, bars.select("code", "date"), ["date"]).join(after, ["code", "asof_date"], "left").withColumn("ahead", F.coalesce("ahead", F.array().cast(after.schema["ahead"].dataType)))


def evaluate_advice(history: DataFrame, bars: DataFrame, n: int = 5, band: float = 2.0) -> DataFrame:
    """Each advice (id, code, date, advice, stop_loss, take_profit) with what the n bars after it did.

    status: error without a start price above zero, insufficient_data with fewer bars, else completed. The first
    bar that touches stop or target ends a long position, at the stop if both are touched (ambiguous). Cash earns
    nothing. hit_stop and hit_target are null where there is no such price, or no position.
    """
    out = _ahead(with_direction(history), bars, n)
    status = ladder((~F.coalesce(c("start") > 0, F.lit(False)), "error"), (F.size("ahead") < n, "insufficient_data"), otherwise="completed")
    out = out.withColumn("status", status)
    done = c("status") == "completed"
    long = done & (c("position") == "long")
    touch = lambda bar, price, below: F.coalesce(bar["low"] <= price if below else bar["high"] >= price, F.lit(False))
    first = lambda price, below: F.nullif(F.array_position(F.transform("ahead", lambda bar: touch(bar, c(price), below)), True), F.lit(0))
    out = out.withColumns({"__s": F.when(long, first("stop_loss", True)), "__t": F.when(long, first("take_profit", False)), "end_close": F.when(done, F.element_at("ahead", -1)["close"]), "max_high": F.when(done, F.array_max("ahead.high")), "min_low": F.when(done, F.array_min("ahead.low"))})
    s, t = c("__s"), c("__t")
    stopped, reached = s.isNotNull() & (t.isNull() | (s <= t)), t.isNotNull() & (s.isNull() | (t <= s))
    first_hit = F.when(done & ~long, "not_applicable").when(long, ladder((stopped & reached, "ambiguous"), (stopped, "stop_loss"), (reached, "take_profit"), otherwise="neither"))
    reason = F.when(done & ~long, "cash").when(long, ladder((stopped & reached, "ambiguous_stop_loss"), (stopped, "stop_loss"), (reached, "take_profit"), otherwise="window_end"))
    exit_price = F.when(long, F.when(stopped, c("stop_loss")).when(reached, c("take_profit")).otherwise(c("end_close")))
    out = out.withColumns({
        "return_pct": (c("end_close") - c("start")) / c("start") * 100, "first_hit": first_hit, "hit_days": F.when(long, F.least(s, t)),
        "hit_stop": F.when(long & c("stop_loss").isNotNull(), stopped), "hit_target": F.when(long & c("take_profit").isNotNull(), reached), "exit_price": exit_price, "exit_reason": reason,
        "simulated_pct": F.when(done & ~long, 0.0).when(long, (exit_price - c("start")) / c("start") * 100),
    })
    out = out.withColumn("outcome", F.when(done, outcome(c("return_pct"), c("expects"), band)))
    right = F.when(c("outcome") == "win", True).when(c("outcome") == "loss", False)
    return out.withColumn("direction_right", right).drop("ahead", "__s", "__t", "asof_date")


def advice_summaries(evaluated: DataFrame) -> DataFrame:
    """Overall (code null) and for each code: counts, rates in percent over the rows they apply to (2 places),
    means (4 places), and counts by status and first hit as maps."""
    done = c("status") == "completed"
    long = done & (c("position") == "long")
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    rate = lambda part, whole: F.round(F.when(n(whole) > 0, n(whole & part) / n(whole) * 100), 2)
    mean = lambda x: F.round(F.avg(x), 4)
    any_target = long & (c("hit_stop").isNotNull() | c("hit_target").isNotNull())
    settled = done & c("outcome").isin("win", "loss")
    tally = lambda name, values: F.map_filter(F.create_map(*[x for v in values for x in (F.lit(v), n(c(name) == v))]), lambda _, k: k > 0)
    return evaluated.rollup("code").agg(
        F.count("*").alias("total"), n(done).alias("completed"), n(c("status") == "insufficient_data").alias("insufficient"), n(long).alias("long_count"), n(done & (c("position") == "cash")).alias("cash_count"),
        *[n(done & (c("outcome") == x)).alias(f"{x}_count") for x in ("win", "loss", "neutral")],
        rate(c("direction_right"), done & c("direction_right").isNotNull()).alias("direction_accuracy_pct"), rate(c("outcome") == "win", settled).alias("win_rate_pct"), rate(c("outcome") == "neutral", done).alias("neutral_rate_pct"),
        mean(F.when(done, c("return_pct"))).alias("avg_return_pct"), mean(F.when(done, c("simulated_pct"))).alias("avg_simulated_pct"),
        rate(c("hit_stop"), long & c("hit_stop").isNotNull()).alias("stop_rate_pct"), rate(c("hit_target"), long & c("hit_target").isNotNull()).alias("target_rate_pct"), rate(c("first_hit") == "ambiguous", any_target).alias("ambiguous_rate_pct"),
        mean(F.when(any_target & (c("first_hit") != "neither"), c("hit_days"))).alias("avg_hit_days"),
        tally("status", ("completed", "insufficient_data", "error")).alias("by_status"), tally("first_hit", ("not_applicable", "neither", "stop_loss", "take_profit", "ambiguous")).alias("by_first_hit"),
    )


def evaluate_signals(signals: DataFrame, bars: DataFrame, n: int = 5, band: float = 2.0) -> DataFrame:
    """Structured signals (id, code, date, expects: up, not_down or not_up) with hit, miss or neutral.

    What can't be judged is unable, with the reason: invalid_anchor_price, insufficient_forward_bars,
    missing_end_close or invalid_end_close (not a number, or infinite).
    """
    sound = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    out = _ahead(signals, bars, n).withColumns({"start": sound(c("start").cast("double")), "__end": F.try_element_at("ahead", F.lit(-1))["close"].cast("double")})
    out = out.withColumn("end_close", sound(c("__end")))
    short = F.size("ahead") < n
    reason = ladder((~F.coalesce(c("start") > 0, F.lit(False)), "invalid_anchor_price"), (short, "insufficient_forward_bars"), (c("__end").isNull(), "missing_end_close"), (c("end_close").isNull(), "invalid_end_close"))
    out = out.withColumn("unable_reason", reason).withColumn("status", F.when(c("unable_reason").isNull(), "completed").otherwise("unable"))
    r, band = (c("end_close") - c("start")) / c("start") * 100, abs(band)
    up = ladder((r >= band, "hit"), (r <= -band, "miss"), otherwise="neutral")
    not_down = ladder((r >= 0, "hit"), (r <= -band, "miss"), otherwise="neutral")
    judged = F.when(c("expects") == "up", up).when(c("expects") == "not_down", not_down).when(c("expects") == "not_up", F.when(r <= band, "hit").otherwise("miss"))
    done = c("status") == "completed"
    out = out.withColumns({"return_pct": F.when(done, r), "outcome": F.when(done, judged), "max_high": F.when(~short, F.array_max(F.transform("ahead", lambda b: sound(b["high"])))), "min_low": F.when(~short, F.array_min(F.transform("ahead", lambda b: sound(b["low"]))))})
    return out.drop("ahead", "__end", "asof_date")


def expire(signals: DataFrame, now: Column) -> DataFrame:
    """Active signals whose time is up are expired; a null end never comes."""
    return signals.withColumn("status", F.when((c("status") == "active") & (c("expires_at") <= now), "expired").otherwise(c("status")))
