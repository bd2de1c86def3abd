"""Research signals on bars and snapshots: volume and support states, trade scores, theme heat, roles,
cost distributions, market light, upserts and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import bars, clip, history, ladder, rolling

from quantloom.operators.profile import SCORING_PROFILE
from quantloom.operators.screening import heat_adjusted

c = F.col

#: Points of each state in a trade score.
TREND_POINTS = {"STRONG_BULL": 30, "BULL": 26, "WEAK_BULL": 18, "CONSOLIDATION": 12, "WEAK_BEAR": 8, "BEAR": 4, "STRONG_BEAR": 0}
VOLUME_POINTS = {"SHRINK_VOLUME_DOWN": 15, "HEAVY_VOLUME_UP": 12, "NORMAL": 10, "SHRINK_VOLUME_UP": 6, "HEAVY_VOLUME_DOWN": 0}
MACD_POINTS = {"GOLDEN_CROSS_ZERO": 15, "GOLDEN_CROSS": 12, "CROSSING_UP": 10, "BULLISH": 8, "BEARISH": 2, "CROSSING_DOWN": 0, "DEATH_CROSS": 0}


def volume_status(df: DataFrame, heavy: float = 1.5, shrink: float = 0.7) -> DataFrame:
    """volume_ratio_5d against the mean of the five rows before (0 if there is none) and the state it makes
    with the price change; NORMAL where there are fewer than five rows."""
    mean = F.avg("volume").over(bars(5, 1))
    rows, up = F.row_number().over(history()), c("close") > F.lag("close").over(history())
    out = df.withColumn("volume_ratio_5d", F.when((rows >= 5) & (mean > 0), c("volume") / mean).otherwise(0.0))
    state = ladder(((c("volume_ratio_5d") >= heavy) & up, "HEAVY_VOLUME_UP"), (c("volume_ratio_5d") >= heavy, "HEAVY_VOLUME_DOWN"), ((c("volume_ratio_5d") <= shrink) & up, "SHRINK_VOLUME_UP"), (c("volume_ratio_5d") <= shrink, "SHRINK_VOLUME_DOWN"), otherwise="NORMAL")
    return out.withColumn("volume_status", F.when(rows < 5, "NORMAL").otherwise(state))


def support_resistance(df: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Whether the close rests on ma5 or ma10 (which the frame has), the levels below it and the 20-row
    high above it."""
    near = lambda ma: F.coalesce((c("close") >= c(ma)) & (F.abs(c("close") - c(ma)) / c(ma) <= tolerance), F.lit(False))
    high = F.max("high").over(bars(20))
    out = df.withColumns({"support_ma5": near("ma5"), "support_ma10": near("ma10"), "resistance": F.when((F.row_number().over(history()) >= 20) & (high > c("close")), high)})
    levels = F.array(F.when(c("support_ma5"), c("ma5")), F.when(c("support_ma10") & ~F.coalesce(c("support_ma5") & (c("ma5") == c("ma10")), F.lit(False)), c("ma10")), F.when(c("close") >= c("ma20"), c("ma20")))
    return out.withColumn("support_levels", F.array_compact(levels))


def _points(x: str, points: dict, otherwise: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in points.items() for v in kv])[c(x)], F.lit(otherwise))


def trade_score(df: DataFrame, threshold: float = 5.0) -> DataFrame:
    """trade_score of at most 100 from trend, bias to ma5, volume_status, supports, signal (MACD) and rsi; null
    before 20 rows.

    A strong rising trend widens the bias threshold by half. RSI classes: above 70, above 60, from 40, from 30.
    """
    bias = F.coalesce((c("close") - c("ma5")) / c("ma5") * 100, F.lit(0.0))
    wide = F.when(c("trend") == "STRONG_BULL", threshold * 1.5).otherwise(threshold)
    place = ladder(((bias < 0) & (bias > -3), 20), ((bias < 0) & (bias > -5), 16), (bias < 0, 8), (bias < 2, 18), (bias < threshold, 14), (bias > wide, 4), ((bias > threshold) & (c("trend") == "STRONG_BULL"), 10), otherwise=4)
    rsi = ladder((c("rsi") > 70, 0), (c("rsi") > 60, 8), (c("rsi") >= 40, 5), (c("rsi") >= 30, 3), (c("rsi") < 30, 10), otherwise=5)
    score = _points("trend", TREND_POINTS, 12) + place + _points("volume_status", VOLUME_POINTS, 8) + c("support_ma5").cast("int") * 5 + c("support_ma10").cast("int") * 5 + _points("signal", MACD_POINTS, 5) + rsi
    return df.withColumn("trade_score", F.when(F.row_number().over(history()) >= 20, score))


def change_percent(df: DataFrame, first: float | None = None) -> DataFrame:
    """pct_chg against the row before; the first row gets `first`."""
    return df.withColumn("pct_chg", F.when(F.lag("close").over(history()).isNull(), F.lit(first).cast("double")).otherwise((c("close") / F.lag("close").over(history()) - 1) * 100))


def day_context(df: DataFrame) -> DataFrame:
    """Each row beside the one before: volume ratio, price change in percent, order of ma5, ma10 and ma20."""
    w = history()
    order = ladder(((c("close") > c("ma5")) & (c("ma5") > c("ma10")) & (c("ma10") > c("ma20")), "bull"), ((c("close") < c("ma5")) & (c("ma5") < c("ma10")) & (c("ma10") < c("ma20")), "bear"), ((c("close") > c("ma5")) & (c("ma5") > c("ma10")), "short_up"), ((c("close") < c("ma5")) & (c("ma5") < c("ma10")), "short_down"), otherwise="mixed")
    before, volume = F.lag("close").over(w), F.lag("volume").over(w)
    return df.withColumns({"volume_change": F.when(volume > 0, c("volume") / volume), "price_change": F.when(before > 0, (c("close") / before - 1) * 100), "ma_status": order})


def volume_spike(df: DataFrame, multiplier: float = 2.0, n: int = 20) -> DataFrame:
    """triggered where the volume exceeds a multiple of the mean of n full rows, this one included."""
    return df.withColumn("triggered", c("volume") > multiplier * rolling(F.avg, c("volume"), n))


def amount_ratio(df: DataFrame, x: str = "amount", n: int = 20) -> DataFrame:
    """x over the mean of its last n known values before the row; null without n of them."""
    known = F.sum(c(x).isNotNull().cast("int")).over(history().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    values = df.where(c(x).isNotNull()).withColumn("__past", rolling(F.avg, c(x), n)).select("code", "date", "__past")
    out = df.join(values, ["code", "date"], "left").withColumn("__known", known)
    past = F.last("__past", ignorenulls=True).over(history().rowsBetween(Window.unboundedPreceding, -1))
    enough = F.max("__known").over(history().rowsBetween(Window.unboundedPreceding, -1)) >= n
    return out.withColumn("amount_ratio_20", F.when(enough & (past > 0), c(x) / past)).drop("__past", "__known")


#: Fixed value: the share of hot observations, in percent, from which heat is lasting.
LASTING = 66.6667


def board_heat_trend(heat: DataFrame, n: int = 5, hot: float = 60.0, cooling: float = 5.0) -> DataFrame:
    """board, latest, trend, persistence, cooling_score, observations and state of the last n heats (0 to 100)."""
    last = Window.partitionBy("board").orderBy(c("at").desc())
    rows = heat.where(c("heat").between(0, 100)).withColumn("nth", F.row_number().over(last)).where(c("nth") <= n)
    out = rows.groupBy("board").agg(F.min_by("heat", "nth").alias("latest"), F.max_by("heat", "nth").alias("__first"), F.max(F.when(c("nth") == 2, c("heat"))).alias("__previous"), (F.avg((c("heat") >= hot).cast("double")) * 100).alias("persistence"), F.count("*").alias("observations"))
    out = out.select("board", "latest", (c("latest") - c("__first")).alias("trend"), "persistence", F.greatest(F.coalesce("__previous", "latest") - c("latest"), F.lit(0.0)).alias("cooling_score"), "observations")
    lasting = (c("persistence") >= LASTING) & F.lit(hot > 0)
    return out.withColumn("state", ladder((c("cooling_score") >= cooling, "cooling"), (c("trend") >= cooling, "warming"), (lasting, "persistent_hot"), (c("trend") <= -cooling, "weakening"), otherwise="flat"))


def hotspot_stage() -> Column:
    """The lifecycle stage of a board from the columns of board_heat_trend()."""
    weak = (c("latest") < 60) | (c("trend") <= -5)
    fading = c("state").isin("weakening", "cooling") | (c("cooling_score") >= 8)
    lasting = (c("state") == "persistent_hot") | (c("persistence") >= LASTING)
    return ladder((fading & weak, "retreat"), (c("cooling_score") >= 5, "divergence"), ((c("latest") >= 75) & (c("trend") >= 8) & (c("persistence") >= 50), "acceleration"), (lasting, "diffusion"), ((c("trend") >= 5) & (c("observations") >= 2), "diffusion"), otherwise="first_move")


def theme_heat(p: dict = SCORING_PROFILE) -> Column:
    """Theme heat from the columns of board_heat_trend()."""
    return heat_adjusted(F.coalesce("latest", F.lit(p["theme_heat_unknown_score"])), p, c("trend"), c("observations"), c("persistence"), c("cooling_score"))


def hotspot_score(inflow: Column | None = None, limit_up: Column | None = None, active_days: Column | None = None, evidence: Column | None = None) -> Column:
    """Strength of a constituent: 35 and clamped terms of change, amount, turnover, volume, inflow, active days and
    pieces of evidence."""
    inflow, limit_up = F.lit(0.0) if inflow is None else inflow, F.lit(False) if limit_up is None else limit_up
    x = lambda name: F.coalesce(c(name).cast("double"), F.lit(0.0))
    lasting = sum((clip(F.coalesce(n.cast("int"), F.lit(0)) * k, 0, 8) for n, k in ((active_days, 2.5), (evidence, 2.0)) if n is not None), F.lit(0.0))
    money = F.when(x("amount") > 0, clip((F.log10(x("amount")) - 6) / 4 * 18, 0, 18)).otherwise(0.0)
    flow = F.when(inflow > 0, clip((F.log10(inflow) - 5) / 4 * 12, 0, 12)).when(inflow < 0, -clip((F.log10(-inflow) - 5) / 4 * 8, 0, 8)).otherwise(0.0)
    return clip(35 + clip(x("change_pct") * 2.7, -18, 32) + money + clip(x("turnover_rate") * 1.1, 0, 14) + clip(x("volume_ratio") * 3.0, 0, 12) + flow + F.when(limit_up, 8.0).otherwise(0.0) + lasting, 0, 100)


def stock_roles(df: DataFrame, theme: str) -> DataFrame:
    """place and role of each constituent in its theme, by (score, change, amount, code) descending."""
    order = Window.partitionBy(theme).orderBy(c("hot_score").desc(), F.coalesce("change_pct", F.lit(-999.0)).desc(), F.coalesce("amount", F.lit(-1.0)).desc(), c("code").desc())
    top, s, change = F.max("hot_score").over(Window.partitionBy(theme)), c("hot_score"), F.coalesce("change_pct", F.lit(0.0))
    out = df.withColumns({"place": F.row_number().over(order), "__top": top})
    role = ladder(((c("place") == 1) & (s >= 70), "leader"), ((c("place") <= 3) & (s >= F.greatest(F.lit(68.0), c("__top") - 8)) & (change >= 5), "leader"), ((s >= 62) & (change >= 3), "support"), ((s >= 48) & (change >= 0), "catch_up"), (s >= 38, "rear"), otherwise="laggard")
    return out.withColumn("role", role).drop("__top")


def cost_distribution(levels: DataFrame, current: DataFrame) -> DataFrame:
    """Per code, from (code, price, weight) and (code, close): winner rate, mean cost, cost bands of 90 and
    70 % and their concentration. A band's end is the first price whose cumulative share reaches it."""
    w = Window.partitionBy("code").orderBy("price")
    rows = levels.groupBy("code", "price").agg(F.sum("weight").alias("weight"))
    rows = rows.withColumn("share", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(Window.partitionBy("code")) * 100).join(current, "code")
    at = lambda p: F.coalesce(F.min(F.when(c("share") >= p, c("price"))), F.max("price"))
    out = rows.groupBy("code").agg((F.sum(F.when(c("price") <= c("close"), c("weight")).otherwise(0.0)) / F.sum("weight")).alias("winner_rate"), (F.sum(c("price") * c("weight")) / F.sum("weight")).alias("avg_cost"), *[at(p).alias(f"c{p}") for p in (5, 15, 85, 95)])
    band = lambda a, b: F.when(c(a) + c(b) != 0, (c(b) - c(a)) / (c(b) + c(a))).otherwise(0.0)
    return out.withColumns({"concentration_90": band("c5", "c95"), "concentration_70": band("c15", "c85")})


def market_light(days: DataFrame) -> DataFrame:
    """score (0 to 100) and label of each day, from up, down, limit_up, limit_down and index_change.

    Each part is truncated to a whole number and is 50 where its data lack; the sum is rounded half to even.
    """
    breadth = F.when(c("up") + c("down") > 0, (c("up") / (c("up") + c("down")) * 100).cast("int")).otherwise(50)
    index = F.when(c("index_change").isNotNull(), clip(50 + c("index_change") * 12, 0, 100).cast("int")).otherwise(50)
    limit = F.when(c("limit_up") + c("limit_down") > 0, (c("limit_up") / (c("limit_up") + c("limit_down")) * 100).cast("int")).otherwise(50)
    # In hundredths the sum is exact, so halves are halves.
    cents = breadth * 45 + index * 35 + limit * 20
    whole, rest = F.floor(cents / 100), cents % 100
    out = days.withColumns({"breadth_score": breadth, "index_score": index, "limit_score": limit, "score": (whole + F.when((rest > 50) | ((rest == 50) & (whole % 2 == 1)), 1).otherwise(0)).cast("int")})
    return out.withColumn("label", ladder((c("score") >= 70, "risk-on"), (c("score") >= 55, "constructive"), (c("score") >= 40, "mixed"), otherwise="defensive"))


def stop_loss(positions: DataFrame, alert_pct: float = 10.0, near_ratio: float = 0.8) -> DataFrame:
    """Positions whose loss against the average cost is near or beyond the alert."""
    loss = F.greatest(F.lit(0.0), (c("avg_cost") - c("last_price")) / c("avg_cost") * 100)
    return positions.where(c("avg_cost") > 0).withColumn("loss_pct", loss).where(c("loss_pct") >= alert_pct * near_ratio).withColumn("is_triggered", c("loss_pct") >= alert_pct)


def calibration(samples: DataFrame, by: str, confidence: float = 0.6, least: int = 30) -> DataFrame:
    """factor = accuracy / confidence within 0.5 and 1.5 where there are samples enough, else 1."""
    out = samples.groupBy(by).agg(F.count("*").alias("samples"), F.avg(c("right").cast("double")).alias("accuracy"))
    return out.withColumn("factor", F.when(c("samples") >= least, clip(c("accuracy") / confidence, 0.5, 1.5)).otherwise(1.0))


def merge_realtime(bars_: DataFrame, quotes: DataFrame) -> DataFrame:
    """History with today's quotes: a quote updates the bar of its date, which keeps the fields that the quote lacks,
    or is appended."""
    both = bars_.withColumn("__source", F.lit(1)).unionByName(quotes.withColumn("__source", F.lit(0)))
    values = [x for x in bars_.columns if x not in ("code", "date")]
    return both.groupBy("code", "date").agg(*[F.min_by(x, F.when(c(x).isNotNull(), c("__source"))).alias(x) for x in values]).select(*bars_.columns)


def supplement(primary: DataFrame, secondary: DataFrame, on: str) -> DataFrame:
    """Nulls of the primary quote are filled from the secondary, column by column."""
    other = secondary.select(on, *[c(x).alias(f"__{x}") for x in primary.columns if x != on])
    return primary.join(other, on, "left").select(on, *[F.coalesce(c(x), c(f"__{x}")).alias(x) for x in primary.columns if x != on])


def upsert(rows: DataFrame, key: list[str], at: str, fields: list[str]) -> DataFrame:
    """One row per key: of each field the last non-null value in the order of `at`."""
    return rows.groupBy(*key).agg(*[F.max_by(x, F.when(c(x).isNotNull(), c(at))).alias(x) for x in fields])


def relaxed_duplicates(rows: DataFrame, key: list[str], id_column: str) -> DataFrame:
    """Rows that aren't the first (smallest id) of their key; nulls in the key are equal to each other."""
    first = F.min(id_column).over(Window.partitionBy(*key))
    return rows.withColumn("survivor", first).where(c(id_column) != c("survivor"))


def resolve_aliases(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """status and entity of each request (id, alias, day, known_at) by aliases (alias, entity, valid_from,
    valid_to, available_at, state, active): CONFLICT, NOT_FOUND, AMBIGUOUS, INACTIVE or RESOLVED.

    An alias counts from its day on and before its end, once available, and if not rejected. An open conflict about
    an alias is one whatever its dates.
    """
    fits = (c("valid_from") <= c("day")) & (c("valid_to").isNull() | (c("day") < c("valid_to"))) & (c("available_at") <= c("known_at")) & (c("state") != "REJECTED")
    # What is told depends on alias and days alone: requests alike in these meet the aliases once.
    asked = ["alias", "day", "known_at"]
    found = requests.select(*asked).distinct().join(aliases, "alias", "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
    entity = F.when(c("fits"), c("entity"))
    told = found.groupBy(*asked).agg(F.max(F.coalesce(c("state") == "CONFLICT", F.lit(False))).alias("open"), F.min(entity).alias("least"), F.max(entity).alias("most"), F.max(c("fits") & c("active")).alias("live"))
    told = told.withColumnsRenamed({x: f"_{x}" for x in asked})
    same = c("alias").eqNullSafe(c("_alias")) & c("day").eqNullSafe(c("_day")) & c("known_at").eqNullSafe(c("_known_at"))
    out = requests.join(told, same, "left").groupBy("id").agg(F.max("open").alias("open"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("live").alias("live"))
    status = ladder((c("open"), "CONFLICT"), (c("least").isNull(), "NOT_FOUND"), (c("least") != c("most"), "AMBIGUOUS"), (~c("live"), "INACTIVE"), otherwise="RESOLVED")
    return out.select("id", status.alias("status"), F.when(c("least") == c("most"), c("least")).alias("entity"))


def coverage_flag(days: DataFrame, least: float = 0.998, most_share: float = 0.002, most: int = 10) -> DataFrame:
    """met: whether a day's observed share and its exclusions keep the service level."""
    ratio, share = F.try_divide(c("observed"), c("expected")), F.try_divide(c("excluded"), c("expected"))
    return days.withColumn("met", F.coalesce((ratio >= least) & (share <= most_share) & (c("excluded") <= most), F.lit(False)))


#: Partition states from best to worst.
STATES = ("COMPLETE", "STALE", "PARTIAL", "UNAVAILABLE", "FAILED")


def worst_state(rows: DataFrame, by: str, state: str) -> DataFrame:
    """The worst state of each group."""
    ranks = F.array(*map(F.lit, STATES))
    return rows.groupBy(by).agg(F.max(F.array_position(ranks, c(state))).alias("__rank")).select(by, F.element_at(ranks, c("__rank").cast("int")).alias("state"))
