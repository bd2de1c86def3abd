"""Ledgers, positions and their risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
EPSILON = 1e-9


def fifo_matches(trades: DataFrame) -> DataFrame:
    """Which quantity of each sale comes from which purchase, first in first out, without a loop.

    Purchases and sales of a position lie on one scale of cumulative quantity; a sale takes from the
    purchases whose interval it overlaps. What is sold beyond all purchases matches nothing.
    """
    w = Window.partitionBy("account", "symbol", "side").orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("upto", F.sum("quantity").over(w)).withColumn("from", c("upto") - c("quantity"))
    b = t.where("side = 'buy'").select("account", "symbol", c("id").alias("buy_id"), c("price").alias("buy_price"), c("from").alias("b0"), c("upto").alias("b1"))
    s = t.where("side = 'sell'").select("account", "symbol", c("id").alias("sell_id"), c("price").alias("sell_price"), c("from").alias("s0"), c("upto").alias("s1"))
    out = b.join(s, ["account", "symbol"]).where((c("b0") < c("s1")) & (c("s0") < c("b1")))
    taken = F.least("b1", "s1") - F.greatest("b0", "s0")
    return out.select("account", "symbol", "sell_id", "buy_id", taken.alias("quantity"), (taken * (c("sell_price") - c("buy_price"))).alias("profit"))


def average_cost(trades: DataFrame) -> DataFrame:
    """Replay per position: a sale leaves the mean cost as it is; what is oversold is cut and counted. A fold over
    the position's trades; ledgers of any length, with splits, are operators.ledger's."""
    rows = trades.groupBy("account", "symbol").agg(F.array_sort(F.collect_list(F.struct("date", "id", "side", c("quantity").cast("double").alias("quantity"), c("price").cast("double").alias("price")))).alias("rows"))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("quantity"), zero.alias("cost"), zero.alias("profit"), zero.alias("oversold"))

    def step(acc: Column, row: Column) -> Column:
        buys = row["side"] == "buy"
        take = F.least(acc["quantity"], row["quantity"])
        mean = F.when(acc["quantity"] > EPSILON, acc["cost"] / acc["quantity"]).otherwise(0.0)
        left = acc["quantity"] - take
        gone = left <= EPSILON
        bought = F.struct((acc["quantity"] + row["quantity"]).alias("quantity"), (acc["cost"] + row["quantity"] * row["price"]).alias("cost"), acc["profit"].alias("profit"), acc["oversold"].alias("oversold"))
        sold = F.struct(F.when(gone, 0.0).otherwise(left).alias("quantity"), F.when(gone, 0.0).otherwise(acc["cost"] - take * mean).alias("cost"), (acc["profit"] + take * (row["price"] - mean)).alias("profit"), (acc["oversold"] + row["quantity"] - take).alias("oversold"))
        return F.when(buys, bought).otherwise(sold)

    return rows.select("account", "symbol", F.aggregate("rows", start, step).alias("s")).select("account", "symbol", "s.*")


def positions(trades: DataFrame) -> DataFrame:
    """Net quantity and cash flow of each account and symbol."""
    sign = F.when(c("side") == "buy", 1).otherwise(-1)
    return trades.groupBy("account", "symbol").agg(F.sum(sign * c("quantity")).alias("quantity"), F.sum(-sign * c("quantity") * c("price")).alias("cash"))


def concentration(exposure: DataFrame, by: str, alert_pct: float = 25.0, top: int = 10) -> DataFrame:
    """Exposure and weight of the largest symbols, and whether a weight calls for an alert."""
    sums = exposure.groupBy(by).agg(F.sum("exposure").alias("exposure"))
    total = sums.agg(F.sum("exposure")).first()[0] or 0.0  # one row
    out = sums.withColumn("weight_pct", F.when(F.lit(total) > 0, c("exposure") / total * 100).otherwise(0.0))
    return out.withColumn("alert", c("weight_pct") >= alert_pct).orderBy(c("weight_pct").desc(), by).limit(top)


def equity_drawdown(equity: DataFrame, by: list[str]) -> DataFrame:
    """Per day, the fall from the running peak in percent; a peak of 0 or less gives none."""
    day = equity.groupBy(*by, "date").agg(F.sum("equity").alias("equity"))
    peak = F.greatest(F.max("equity").over(Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return day.withColumn("peak", peak).withColumn("drawdown_pct", F.when(c("peak") > 0, (c("peak") - c("equity")) / c("peak") * 100).otherwise(0.0))


def convert(amount: Column, direct: Column, inverse: Column) -> tuple[Column, Column]:
    """Amount at the direct rate, else over the inverse one, else one to one and stale."""
    rate = F.coalesce(F.when(direct > 0, direct), F.when(inverse > 0, 1 / inverse))
    return amount * F.coalesce(rate, F.lit(1.0)), rate.isNull()


def trade_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("")) for x in columns]), 256)

