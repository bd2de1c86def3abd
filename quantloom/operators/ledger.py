"""Replay of account ledgers with splits and dividends, valuation of what is held, and daily equity.

Inputs (extra columns are ignored):
  trades   account, id, date, symbol, market, currency, side (buy, sell), quantity, price, fee, tax
  actions  account, id, date, symbol, market, currency, action (split_adjustment, cash_dividend), ratio, per_share
  cash     account, id, date, currency, direction (in, out), amount
  prices   symbol, date, close
  rates    source, target, date, rate, stale
Of one day, cash comes first, then actions, then trades; of one kind, the smaller id.

A split multiplies what is held, so quantities over the product of the splits so far are plain sums. A sale
first in first out then costs the difference of one function, the cost of the first x units bought, at two
places: an as-of lookup, no pairs of purchases and sales. Average cost is a recurrence of the form
cost = factor * cost + added. Both are running results in blocks, so neither an account nor a position has
to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import ladder
from quantloom.functions.scans import affine, before_blocks, block_window, split_blocks
from quantloom.sources.scratch import written

c = F.col
KEY = ["account", "symbol", "market", "currency"]
ORDER = ["date", "priority", "id"]
#: What counts as nothing; the order of kinds within a day.
EPSILON = 1e-8
CASH, ACTION, TRADE = 0, 1, 2


def _amount(name: str) -> Column:
    return F.coalesce(c(name).cast("double"), F.lit(0.0))


def _key() -> list[Column]:
    """Symbols and currencies in capitals, markets in small letters; unknown ones as empty text."""
    clean = lambda x: F.coalesce(F.trim(c(x).cast("string")), F.lit(""))
    return [c("account"), F.upper(clean("symbol")).alias("symbol"), F.lower(clean("market")).alias("market"), F.upper(clean("currency")).alias("currency")]


def ledger_events(trades: DataFrame, actions: DataFrame) -> DataFrame:
    """Trades and actions in one form: kind (buy, sell, split, dividend, none), quantity, gross, costs,
    ratio, per_share, problem.

    A row that can't be booked has kind none and says why in `problem`: invalid_trade (quantity or price not
    above zero), unsupported_side, invalid_split (ratio not above zero), unsupported_action. Dividends of
    nothing and splits of one to one change nothing and are no problem.
    """
    side, good = F.lower(F.trim("side")), (_amount("quantity") > 0) & (_amount("price") > 0)
    problem = ladder((~good, "invalid_trade"), (side.isin("buy", "sell"), None), otherwise="unsupported_side")
    booked = F.when(good & side.isin("buy", "sell"), side).otherwise("none")
    t = trades.select(*_key(), "date", F.lit(TRADE).alias("priority"), "id", booked.alias("kind"), _amount("quantity").alias("quantity"), (_amount("quantity") * _amount("price")).alias("gross"), _amount("fee").alias("fee"), _amount("tax").alias("tax"), F.lit(1.0).alias("ratio"), F.lit(0.0).alias("per_share"), problem.alias("problem"))
    what, ratio = F.lower(F.trim("action")), _amount("ratio")
    split, dividend = what == "split_adjustment", what == "cash_dividend"
    kind = ladder((split & (ratio > 0) & (F.abs(ratio - 1) > EPSILON), "split"), (dividend & (_amount("per_share") > 0), "dividend"), otherwise="none")
    problem = ladder((split & (ratio <= 0), "invalid_split"), (split | dividend, None), otherwise="unsupported_action")
    zero = F.lit(0.0)
    a = actions.select(*_key(), "date", F.lit(ACTION).alias("priority"), "id", kind.alias("kind"), zero.alias("quantity"), zero.alias("gross"), zero.alias("fee"), zero.alias("tax"), F.when(kind == "split", ratio).otherwise(1.0).alias("ratio"), F.when(kind == "dividend", _amount("per_share")).otherwise(0.0).alias("per_share"), problem.alias("problem"))
    return t.unionByName(a)


def position_states(events: DataFrame, rows: int = 200_000) -> DataFrame:
    """Each event with `before` and `held`, the quantity before and after it, in units of its day; `bought`
    and `sold`, running sums in units before all splits; and `spent`, the running cost of all purchases. `__last`
    marks the last event of a position in its block.

    A sale of more than is held has the problem oversell. Sums of many rows are allowed a millionth of a
    millionth, beside EPSILON.
    """
    blocks, several = split_blocks(events, KEY, ORDER, rows)
    w = block_window(KEY, ORDER)
    local = blocks.withColumns({"f": F.product("ratio").over(w), "__last": F.lead("priority").over(Window.partitionBy(*KEY, "__block").orderBy(*ORDER)).isNull()})
    buys, sells = c("kind") == "buy", c("kind") == "sell"
    unit = c("quantity") / c("f")
    sums = {"x": F.when(buys, unit).otherwise(0.0), "y": F.when(sells, unit).otherwise(0.0), "k": F.when(buys, c("gross") + c("fee") + c("tax")).otherwise(0.0)}
    local = local.withColumns({name: F.sum(x).over(w) for name, x in sums.items()})
    if several:
        ends = local.where("__last").select(*KEY, "__block", "f", "x", "y", "k")
        heads = before_blocks(
            ends, KEY, {"f0": F.lit(1.0), "x0": F.lit(0.0), "y0": F.lit(0.0), "k0": F.lit(0.0)},
            {"f0": lambda now, b: now["f0"] * b["f"], "x0": lambda now, b: now["x0"] + b["x"] / now["f0"], "y0": lambda now, b: now["y0"] + b["y"] / now["f0"], "k0": lambda now, b: now["k0"] + b["k"]},
        )
        # Fewer than two rows for each block.
        joined = local.join(F.broadcast(heads), [*KEY, "__block"], "left")
    else:
        joined = local.withColumns({x: F.lit(None).cast("double") for x in ("f0", "x0", "y0", "k0")})
    at = lambda name, none: F.coalesce(c(name), F.lit(none))
    out = joined.withColumns({"bought": at("x0", 0.0) + c("x") / at("f0", 1.0), "sold": at("y0", 0.0) + c("y") / at("f0", 1.0), "spent": at("k0", 0.0) + c("k"), "factor": at("f0", 1.0) * c("f")})
    slack = EPSILON + 1e-12 * c("bought") * c("factor")
    raw = (c("bought") - c("sold")) * c("factor")
    out = out.withColumn("raw", raw).withColumn("held", F.when(F.abs("raw") <= slack, 0.0).otherwise(c("raw")))
    before = F.when(buys, c("held") - c("quantity")).when(sells, c("raw") + c("quantity")).otherwise(c("raw") / c("ratio"))
    out = out.withColumn("before", F.when(F.abs(before) <= slack, 0.0).otherwise(before))
    problem = F.when(sells & (c("raw") < -slack), F.lit("oversell"))
    return out.withColumn("problem", F.coalesce("problem", problem)).select(*events.columns, "__block", "before", "held", "bought", "sold", "spent", "factor", "__last")


def fifo_costs(states: DataFrame, rows: int = 200_000) -> DataFrame:
    """`account`, position, `id` and `basis` of each sale, first in first out.

    The cost of the first x units bought is straight between purchases. Purchases and the two ends of each
    sale are put on that scale; the last purchase at or before an end tells the cost there.
    """
    unit = c("quantity") / c("factor")
    lots = states.where("kind = 'buy'").select(*KEY, (c("bought") - unit).alias("place"), F.lit(1).alias("side"), "id", F.lit(0).alias("sign"), F.struct((c("bought") - unit).alias("at"), (c("spent") - c("gross") - c("fee") - c("tax")).alias("cost"), ((c("gross") + c("fee") + c("tax")) / unit).alias("unit")).alias("lot"))
    ends = states.where("kind = 'sell'").select(*KEY, "id", F.explode(F.array(F.struct((c("sold") - unit).alias("place"), F.lit(-1).alias("sign")), F.struct(c("sold").alias("place"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select(*KEY, "e.place", F.lit(0).alias("side"), "id", "e.sign", F.lit(None).cast(lots.schema["lot"].dataType).alias("lot"))
    order = ["place", "side", "id", "sign"]
    blocks, several = split_blocks(lots.unionByName(ends), KEY, order, rows)
    last = F.last("lot", ignorenulls=True).over(block_window(KEY, order))
    local = blocks.withColumn("last", last)
    found = local.where("side = 0")
    if several:
        tails = local.groupBy(*KEY, "__block").agg(F.max_by("lot", F.when(c("lot").isNotNull(), F.struct(*order))).alias("lot"))
        none = F.lit(None).cast(lots.schema["lot"].dataType)
        heads = before_blocks(tails, KEY, {"head": none}, {"head": lambda now, b: F.coalesce(b["lot"], now["head"])})
        found = found.join(F.broadcast(heads), [*KEY, "__block"], "left").withColumn("last", F.coalesce("last", "head"))
    cost = F.coalesce(c("last.cost") + (c("place") - c("last.at")) * c("last.unit"), F.lit(0.0))
    return found.groupBy(*KEY, "id").agg(F.sum(c("sign") * cost).alias("basis"))


def average_costs(states: DataFrame) -> DataFrame:
    """States with `cost_before` and `cost`: what the position cost before and after each event, at average
    cost. A sale takes its share of the cost with it; a position that is sold out costs nothing."""
    sells = c("kind") == "sell"
    keep = F.when(sells & (c("before") > 0), F.greatest(c("held"), F.lit(0.0)) / c("before")).when(sells, 0.0).otherwise(1.0)
    steps = states.withColumns({"__keep": keep, "__spent": F.when(c("kind") == "buy", c("gross") + c("fee") + c("tax")).otherwise(0.0)})
    return affine(steps, KEY, ORDER, "__keep", "__spent", "cost_before", "cost", block="__block").drop("__keep", "__spent")


def replay(trades: DataFrame, actions: DataFrame, cash: DataFrame, method: str = "fifo", as_of: Column | None = None, rows: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Positions, sales, cash and accounts as of a day (of all events, if none is given).

    positions  account, symbol, market, currency, quantity, total_cost, avg_cost: those with anything held
    sales      account, position, id, date, quantity, proceeds, basis, realized, in the trade's currency
    cash       account, currency, balance: deposits, trades with their costs, and dividends on what was held
    accounts   account, status: ok, or the first problem in time; what an account with a problem shows in the
               other tables is not to be relied on
    """
    if method not in ("fifo", "average"):
        raise ValueError(f"unknown cost method {method}")
    upto = (lambda df: df) if as_of is None else (lambda df: df.where(c("date") <= as_of))
    states = position_states(ledger_events(upto(trades), upto(actions)), rows)
    if method == "average":
        states = costs = average_costs(states)  # written on the way
        sales = costs.where("kind = 'sell'").withColumn("basis", F.when(c("before") > 0, c("cost_before") * (c("quantity") / c("before"))).otherwise(0.0))
        left = costs.where("__last").groupBy(*KEY).agg(F.max_by("held", F.struct(*ORDER)).alias("quantity"), F.max_by("cost", F.struct(*ORDER)).alias("total_cost"))
    else:
        states = written(states, "states")
        basis = fifo_costs(states, rows)
        sales = states.where("kind = 'sell'").join(basis, [*KEY, "id"])
        spent = states.where("__last").groupBy(*KEY).agg(F.max_by("held", F.struct(*ORDER)).alias("quantity"), F.max("spent").alias("spent"))
        left = spent.join(basis.groupBy(*KEY).agg(F.sum("basis").alias("gone")), KEY, "left").withColumn("total_cost", c("spent") - F.coalesce("gone", F.lit(0.0)))
    positions = left.where(c("quantity") > EPSILON).select(*KEY, "quantity", "total_cost", (c("total_cost") / c("quantity")).alias("avg_cost"))
    proceeds = c("gross") - c("fee") - c("tax")
    sales = sales.select(*KEY, "id", "date", "quantity", proceeds.alias("proceeds"), "basis", (proceeds - c("basis")).alias("realized"))
    booked = upto(cash).select("account", F.upper(F.coalesce(F.trim(c("currency").cast("string")), F.lit(""))).alias("currency"), "date", F.lit(CASH).alias("priority"), "id", F.lower(F.trim("direction")).alias("direction"), _amount("amount").alias("amount"))
    flow = ladder((c("kind") == "buy", 1), (c("kind") == "sell", 2), (c("kind") == "dividend", 3), otherwise=0)
    moved = F.when(flow == 1, -(c("gross") + c("fee") + c("tax"))).when(flow == 2, proceeds).when(flow == 3, F.when(c("before") > EPSILON, c("before") * c("per_share")).otherwise(0.0)).otherwise(0.0)
    signed = F.when(c("direction") == "in", c("amount")).when(c("direction") == "out", -c("amount")).otherwise(0.0)
    flows = booked.select("account", "currency", "date", signed.alias("amount")).unionByName(states.select("account", "currency", "date", moved.alias("amount")))
    wrong = F.when(~F.coalesce(c("direction").isin("in", "out"), F.lit(False)), F.lit("unsupported_direction"))
    # Events without a problem tell only that there is such an account.
    known = states.select("account").unionByName(booked.select("account")).distinct()
    told = states.select("account", *ORDER, "problem").unionByName(booked.select("account", *ORDER, wrong.alias("problem"))).where("problem IS NOT NULL")
    first = told.groupBy("account").agg(F.min_by("problem", F.struct(*ORDER)).alias("first")).withColumnRenamed("account", "_account")
    accounts = known.join(first, known["account"].eqNullSafe(c("_account")), "left").select("account", F.coalesce("first", F.lit("ok")).alias("status"))
    return positions, sales, flows.groupBy("account", "currency").agg(F.sum("amount").alias("balance")), accounts


def available_quantity(trades: DataFrame, actions: DataFrame, as_of: Column, rows: int = 200_000) -> DataFrame:
    """account, position, quantity and problem on a day: splits and trades only; `problem` is the first."""
    states = position_states(ledger_events(trades.where(c("date") <= as_of), actions.where(c("date") <= as_of)), rows)
    first = F.min_by("problem", F.when(c("problem").isNotNull(), F.struct(*ORDER)))
    return states.groupBy(*KEY).agg(F.max_by("held", F.struct(*ORDER)).alias("quantity"), first.alias("problem"))


def latest(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last day."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "date").alias("v")).select(*keys, *[c(f"v.{x}").alias(x) for x in values])


def converted(rows: DataFrame, rates: DataFrame, amounts: list[str], source: str = "currency", target: str = "base", at: str | None = None) -> DataFrame:
    """Rows with the amounts in the target's currency as `<name>_base`, and `fx_stale`.

    The last rate up to the row's day `at` (or simply the last): the direct one if above zero, else one over
    the inverse, else one to one and stale. Equal currencies need none, and nothing at all is never stale.
    """
    if at is None:
        known = latest(rates.where("rate is not null"), ["source", "target"], ["rate", "stale"])
        direct = known.select(c("source").alias(source), c("target").alias(target), c("rate").alias("__d"), c("stale").alias("__ds"))
        inverse = known.select(c("target").alias(source), c("source").alias(target), c("rate").alias("__i"), c("stale").alias("__is"))
        out = rows.join(direct, [source, target], "left").join(inverse, [source, target], "left")
    else:
        out = _rate_on(_rate_on(rows, rates.select(c("source").alias(source), c("target").alias(target), "date", "rate", "stale"), source, target, at, "d"), rates.select(c("target").alias(source), c("source").alias(target), "date", "rate", "stale"), source, target, at, "i")
    same = c(source) == c(target)
    factor = F.when(same, 1.0).when(c("__d") > 0, c("__d")).when(c("__i") > 0, 1 / c("__i")).otherwise(1.0)
    stale = F.when(same, False).when(c("__d") > 0, F.coalesce("__ds", F.lit(False))).when(c("__i") > 0, F.coalesce("__is", F.lit(False))).otherwise(True)
    nothing = F.greatest(*[F.abs(x) for x in amounts], F.lit(0.0)) <= EPSILON
    return out.withColumns({**{f"{x}_base": F.when(F.abs(x) <= EPSILON, 0.0).otherwise(c(x) * factor) for x in amounts}, "fx_stale": stale & ~nothing}).drop("__d", "__ds", "__i", "__is")


def _rate_on(rows: DataFrame, rates: DataFrame, source: str, target: str, at: str, tag: str) -> DataFrame:
    """The last rate on or before each row's day: rates and rows in one stream of days."""
    days = rows.select(source, target, c(at).alias("date")).distinct().select("*", F.lit(1).alias("__side"), F.lit(None).cast("struct<rate:double,stale:boolean>").alias("__r"))
    told = rates.where("rate is not null").select(source, target, "date", F.lit(0).alias("__side"), F.struct(c("rate").cast("double").alias("rate"), c("stale").cast("boolean").alias("stale")).alias("__r"))
    w = Window.partitionBy(source, target).orderBy("date", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = told.unionByName(days).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    found = found.select(source, target, c("date").alias(at), c("__r.rate").alias(f"__{tag}"), c("__r.stale").alias(f"__{tag}s"))
    return rows.join(found, [source, target, at], "left")


def valued(positions: DataFrame, accounts: DataFrame, prices: DataFrame, rates: DataFrame) -> DataFrame:
    """Positions at their last price, in the account's base currency (`accounts`: account, base).

    price_available says whether there is a price above zero; without one, value, cost and profit count as 0.
    """
    priced = positions.join(latest(prices.where("close > 0"), ["symbol"], ["close", "date"]).select("symbol", c("close").alias("last_price"), c("date").alias("price_date")), "symbol", "left").join(accounts.select("account", "base"), "account")
    known = c("last_price").isNotNull()
    priced = priced.withColumns({"price_available": known, "value": F.when(known, c("quantity") * c("last_price")).otherwise(0.0), "cost": F.when(known, c("total_cost")).otherwise(0.0)})
    out = converted(priced, rates, ["value", "cost"])
    profit = c("value_base") - c("cost_base")
    return out.withColumns({"unrealized_base": profit, "unrealized_pct": F.when(F.abs("cost_base") > EPSILON, profit / c("cost_base") * 100)}).drop("value", "cost")


def account_totals(accounts: DataFrame, positions: DataFrame, sales: DataFrame, cash: DataFrame, trades: DataFrame, rates: DataFrame) -> DataFrame:
    """One row for each account in its base currency: cash, value, equity, realized and unrealized profit,
    fees, taxes, fx_stale. Realized profit, fees and taxes are converted on their day."""
    base = accounts.select("account", "base")
    side = F.lower(F.trim("side"))
    fees = converted(trades.where(side.isin("buy", "sell")).select("account", F.upper(F.trim("currency")).alias("currency"), "date", _amount("fee").alias("fee"), _amount("tax").alias("tax")).join(base, "account"), rates, ["fee", "tax"], at="date")
    gains = converted(sales.join(base, "account"), rates, ["realized"], at="date")
    money = converted(cash.join(base, "account"), rates, ["balance"])
    parts = [
        money.groupBy("account").agg(F.sum("balance_base").alias("cash"), F.max("fx_stale").alias("s1")),
        positions.groupBy("account").agg(F.sum("value_base").alias("market_value"), F.sum("cost_base").alias("cost"), F.max("fx_stale").alias("s2")),
        gains.groupBy("account").agg(F.sum("realized_base").alias("realized"), F.max("fx_stale").alias("s3")),
        fees.groupBy("account").agg(F.sum("fee_base").alias("fees"), F.sum("tax_base").alias("taxes"), F.max("fx_stale").alias("s4")),
    ]
    out = base
    for part in parts:
        out = out.join(part, "account", "left")
    out = out.na.fill(0.0, ["cash", "market_value", "cost", "realized", "fees", "taxes"])
    stale = F.coalesce(F.greatest("s1", "s2", "s3", "s4"), F.lit(False))
    return out.select("account", "base", "cash", "market_value", (c("cash") + c("market_value")).alias("equity"), "realized", (c("market_value") - c("cost")).alias("unrealized"), "fees", "taxes", stale.alias("fx_stale"))


def missing_days(activity: DataFrame, snapshots: DataFrame, as_of: Column, lookback_days: int) -> DataFrame:
    """account and date of every calendar day, from the later of the window's start and the account's first
    activity to `as_of`, that has no snapshot. An account's span is made of its own days, at most the window's."""
    first = activity.where(c("date") <= as_of).groupBy("account").agg(F.min("date").alias("first"))
    days = first.select("account", F.explode(F.sequence(F.greatest("first", F.date_sub(as_of, lookback_days)), as_of)).alias("date"))
    return days.join(snapshots.select("account", "date").distinct(), ["account", "date"], "left_anti")


def daily_equity(days: DataFrame, trades: DataFrame, actions: DataFrame, cash: DataFrame, prices: DataFrame, rows: int = 200_000) -> DataFrame:
    """account, date, currency, cash, market_value and equity at the end of each given day.

    Held quantities and cash are step functions of the day and prices too: each is looked up as of the day,
    in one ordered stream of changes and days for each position, symbol and currency.
    """
    states = written(position_states(ledger_events(trades, actions), rows), "states")
    held = states.groupBy(*KEY, "date").agg(F.max_by("held", F.struct(*ORDER)).alias("held"))
    wanted = states.select(*KEY).distinct().join(days, "account")
    held = _as_of(wanted, held, KEY, "held").where(c("held") > EPSILON)
    priced = _as_of(held, prices.where("close > 0").select("symbol", "date", "close"), ["symbol"], "close")
    value = priced.groupBy("account", "date", "currency").agg(F.sum(c("held") * F.coalesce("close", F.lit(0.0))).alias("market_value"))
    proceeds = c("gross") - c("fee") - c("tax")
    moved = F.when(c("kind") == "buy", -(c("gross") + c("fee") + c("tax"))).when(c("kind") == "sell", proceeds).when((c("kind") == "dividend") & (c("before") > EPSILON), c("before") * c("per_share")).otherwise(0.0)
    signed = F.when(F.lower(F.trim("direction")) == "in", _amount("amount")).otherwise(-_amount("amount"))
    flows = states.select("account", "currency", "date", moved.alias("amount")).unionByName(cash.select("account", F.upper(F.trim("currency")).alias("currency"), "date", signed.alias("amount")))
    daily = flows.groupBy("account", "currency", "date").agg(F.sum("amount").alias("amount"))
    running = daily.withColumn("cash", F.sum("amount").over(Window.partitionBy("account", "currency").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    money = _as_of(running.select("account", "currency").distinct().join(days, "account"), running.select("account", "currency", "date", "cash"), ["account", "currency"], "cash")
    out = money.join(value, ["account", "date", "currency"], "full_outer").na.fill(0.0, ["cash", "market_value"])
    return out.select("account", "date", "currency", "cash", "market_value", (c("cash") + c("market_value")).alias("equity"))


def _as_of(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left rows with the right side's last value on or before their day."""
    kind = right.schema[value].dataType
    both = left.select(*keys, "date", F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(kind).alias("__v"))
    both = right.select(*keys, "date", F.lit(0).alias("__side"), F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), c(value).alias("__v")).unionByName(both)
    w = Window.partitionBy(*keys).orderBy("date", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select("__row.*", c("__v").alias(value))
