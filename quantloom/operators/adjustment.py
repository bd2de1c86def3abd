"""Price adjustment factors from revised corporate actions.

Inputs:
  closes  entity, date, close: actual closes; an entity's sessions are the days of its closes, or those of a
          calendar (date) if one is given
  events  entity, event_key, group_id, role, revision, state (ACTIVE, CANCELLED), action (DIVIDEND, BONUS,
          SPLIT), quantity, denominator, ex_date, and, if present, available_at, record_date, payment_date
An entity with anything wrong gets no factors at all but the reason: nothing is filled or left out silently.
"""

from __future__ import annotations

import decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import ladder

c = F.col
#: Digits of all divisions and products; places of a factor; the kinds of actions.
DIGITS, PLACES = 38, 18
ACTIONS = ("DIVIDEND", "BONUS", "SPLIT")


def select_revisions(events: DataFrame, base: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """Events with `disposition` and `problem`.

    Of each event the highest revision counts, SUPERSEDED are the others; it is CANCELLED, OUT_OF_RANGE (not
    after the base day or after the anchor), or SELECTED. Problems: revisions that don't run 1, 2, 3, ...;
    a group, role or action that changes; availability that doesn't rise; and of active rows an unknown
    action, a quantity or denominator that isn't above zero, a split that doesn't add shares, a record day not
    before the ex-day, a payment day before it.
    """
    key = ["entity", "event_key"]
    w = Window.partitionBy(*key)
    order = w.orderBy("revision")
    identity = F.concat_ws("\x00", "group_id", "role", "action")
    optional = lambda name, bad: bad if name in events.columns else F.lit(False)
    late = lambda name: optional(name, c(name) <= F.lag(name).over(order))
    active = c("state") == "ACTIVE"
    problem = ladder(
        ((F.count("*").over(w) != F.max("revision").over(w)) | (F.min("revision").over(w) != 1) | (c("revision") == F.lag("revision").over(order)), "revisions_not_consecutive"),
        (F.min(identity).over(w) != F.max(identity).over(w), "identity_changed"),
        (late("available_at"), "availability_not_rising"),
        (~F.coalesce(c("action").isin(*ACTIONS), F.lit(False)), "unsupported_action"),
        (active & ~F.coalesce((c("quantity") > 0) & (c("denominator") > 0), F.lit(False)), "quantity_not_positive"),
        (active & (c("action") == "SPLIT") & (c("quantity") <= c("denominator")), "split_without_new_shares"),
        (optional("record_date", c("record_date") >= c("ex_date")), "record_date_not_before_ex"),
        (optional("payment_date", c("payment_date") < c("ex_date")), "payment_date_before_ex"),
    )
    outside = F.lit(False) if base is None else c("ex_date") <= base
    outside = outside if anchor is None else outside | (c("ex_date") > anchor)
    latest = c("revision") == F.max("revision").over(w)
    disposition = ladder((~latest, "SUPERSEDED"), (c("state") == "CANCELLED", "CANCELLED"), (outside, "OUT_OF_RANGE"), otherwise="SELECTED")
    return events.withColumns({"disposition": disposition, "problem": problem})


def event_ratios(closes: DataFrame, selected: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """One row for each entity and ex-day: group_id, reference_date, reference_price, cash and bonus parts (arrays
    of quantity and denominator), split (the same, or null), problem.

    Cash and bonus shares of one plan are added first and count once, on the close of the session before.
    Problems: two plans on one day, a role twice in a plan, a split beside anything else, an ex-day that is no
    session, a session before it that is missing or has no close above zero.
    """
    pair = F.struct(c("quantity").cast("string").alias("q"), c("denominator").cast("string").alias("d"))
    parts = {x: F.collect_list(F.when(c("action") == kind, pair)) for x, kind in (("cash", "DIVIDEND"), ("bonus", "BONUS"), ("splits", "SPLIT"))}
    days = selected.groupBy("entity", c("ex_date").alias("date")).agg(F.min("group_id").alias("group_id"), F.count_distinct("group_id").alias("plans"), F.count_distinct("role").alias("roles"), F.count("*").alias("n"), *[x.alias(name) for name, x in parts.items()])
    own = Window.partitionBy("entity").orderBy("date")
    if calendar is None:
        sessions = closes.select("entity", "date", F.lag("date").over(own).alias("reference_date"), F.lag("close").over(own).alias("reference_price"))
        days = days.join(sessions.withColumn("session", F.lit(True)), ["entity", "date"], "left")
    else:
        every = calendar.select("date").distinct()
        # A calendar has a row for each day of trade, however many entities there are.
        steps = every.select("date", F.lag("date").over(Window.orderBy("date")).alias("reference_date"), F.lit(True).alias("session"))
        priced = closes.select("entity", c("date").alias("reference_date"), c("close").alias("reference_price"))
        days = days.join(F.broadcast(steps), "date", "left").join(priced, ["entity", "reference_date"], "left")
    problem = ladder(
        (c("plans") > 1, "several_plans_on_one_day"), (c("roles") < c("n"), "role_twice_in_plan"), ((F.size("splits") > 0) & (c("n") > 1), "split_beside_others"),
        (c("session").isNull(), "ex_date_no_session"), (c("reference_date").isNull(), "no_session_before"), (~F.coalesce(c("reference_price") > 0, F.lit(False)), "no_reference_price"),
    )
    return days.select("entity", c("date").alias("ex_date"), "group_id", "reference_date", c("reference_price").cast("string").alias("reference_price"), "cash", "bonus", "splits", problem.alias("problem"))


def _sum(parts) -> decimal.Decimal:
    return sum((decimal.Decimal(x["q"]) / decimal.Decimal(x["d"]) for x in parts), decimal.Decimal(0))


def _products(events: list) -> list[dict]:
    """Of an entity's events in time: q, the product of 1/q up to each, and of q from each on."""
    with decimal.localcontext(decimal.Context(prec=DIGITS)):
        out, total = [], decimal.Decimal(1)
        for e in events:
            price, split = decimal.Decimal(e["reference_price"]), list(e["splits"])
            shares = _sum(split) if split else 1 + _sum(e["bonus"])
            q = (price - _sum(e["cash"])) / shares / price
            if q <= 0:
                return [{"ex_date": e["ex_date"], "problem": "reference_not_positive"}]
            total *= 1 / q
            out.append({"ex_date": e["ex_date"], "q": q, "backward": total})
        total = decimal.Decimal(1)
        for row in reversed(out):
            total *= row["q"]
            row["forward"] = total
        small, large = decimal.Decimal(1).scaleb(-PLACES) / 2, decimal.Decimal(10) ** 20
        bad = [r for r in out if not all(small <= r[x] < large for x in ("backward", "forward"))]
        if bad:
            return [{"ex_date": bad[0]["ex_date"], "problem": "factor_out_of_range"}]
        unit = decimal.Decimal(1).scaleb(-PLACES)
        return [{"ex_date": r["ex_date"], **{x: r[x].quantize(unit) for x in ("q", "backward", "forward")}} for r in out]


def event_factors(ratios: DataFrame) -> DataFrame:
    """entity, ex_date, q, forward (product of q from this event on), backward (product of 1/q up to it), to 18
    places from 38 digits; or the entity's problem alone.

    An entity's actions, a handful a year, are one array. Decimals of 38 digits in divisions are beyond the
    JVM's decimal type, so the arrays, and nothing else, go through Arrow to Python's decimals.
    """
    kind = f"array<struct<ex_date:date,q:decimal(38,{PLACES}),forward:decimal(38,{PLACES}),backward:decimal(38,{PLACES}),problem:string>>"

    @F.pandas_udf(kind)
    def products(events: pd.Series) -> pd.Series:
        empty = {"q": None, "forward": None, "backward": None, "problem": None}
        return events.map(lambda rows: [empty | r for r in _products(list(rows))])

    listed = ratios.groupBy("entity").agg(F.min("problem").alias("problem"), F.array_sort(F.collect_list(F.struct("ex_date", "reference_price", "cash", "bonus", "splits"))).alias("events"))
    wrong = listed.where("problem is not null").select("entity", F.lit(None).cast(kind.removeprefix("array<")[:-1]).alias("f"), "problem")
    right = listed.where("problem is null").select("entity", F.explode(products("events")).alias("f"))
    rows = right.select("entity", "f", c("f.problem").alias("problem")).unionByName(wrong)
    return rows.select("entity", "f.ex_date", "f.q", "f.forward", "f.backward", "problem")


def adjustment_factors(closes: DataFrame, events: DataFrame, base: Column | None = None, anchor: Column | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """entity, date, forward, backward and problem of each close from the base day to the anchor.

    forward leaves prices at the anchor as they are: the product of q of the ex-days after the date.
    backward leaves those at the base: the product of 1/q of the ex-days up to it. Without actions both are 1.
    """
    chosen = select_revisions(events, base, anchor)
    told = chosen.where("problem is not null").groupBy("entity").agg(F.min("problem").alias("problem"))
    found = event_factors(event_ratios(closes, chosen.where("disposition = 'SELECTED'").join(told, "entity", "left_anti"), calendar))
    wrong = told.unionByName(found.where("problem is not null").groupBy("entity").agg(F.min("problem").alias("problem"))).groupBy("entity").agg(F.min("problem").alias("problem"))
    days = closes if base is None else closes.where(c("date") >= base)
    days = days if anchor is None else days.where(c("date") <= anchor)
    both = days.select("entity", "date", F.lit(1).alias("side"), *[F.lit(None).cast(f"decimal(38,{PLACES})").alias(x) for x in ("f", "b")])
    both = both.unionByName(found.where("problem is null").select("entity", c("ex_date").alias("date"), F.lit(0).alias("side"), c("forward").alias("f"), c("backward").alias("b")))
    # Of one day the event comes first: its factor is behind, not ahead of, the day's close.
    order = Window.partitionBy("entity").orderBy("date", "side")
    one = F.lit(1).cast(f"decimal(38,{PLACES})")
    ahead = F.first("f", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    behind = F.last("b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"forward": F.coalesce(ahead, one), "backward": F.coalesce(behind, one)}).where("side = 1").join(wrong, "entity", "left")
    right = c("problem").isNull()
    return both.select("entity", "date", F.when(right, c("forward")).alias("forward"), F.when(right, c("backward")).alias("backward"), "problem")
