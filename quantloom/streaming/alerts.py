"""Alert rules over streams of ticks, with cool-downs, and triggers told once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

c = F.col
#: transformWithState keeps its state in RocksDB.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = 86_400_000


@dataclass(frozen=True)
class LevelRule:
    """Triggers when a price crosses the level: `above` from it or below to above it, `below` the other way."""

    name: str
    level: float
    direction: str = "above"
    severity: str = "warning"
    cooldown_s: int = 3600

    def __post_init__(self):
        if self.direction not in ("above", "below"):
            raise ValueError(f"unknown direction {self.direction}")


class CooldownAlerts(StatefulProcessor):
    """State of a target: ticks that the watermark hasn't reached, and for each rule name and severity the last price
    and the end of the cool-down, with the last tick's time.

    Ticks wait for the watermark and are then taken in order of time, so one that comes late, in a later
    micro-batch, still stands at its place. All rules of a target share its ticks and its timer: they are kept and
    read once, not once for each rule. A timer wakes the target when the watermark reaches its next tick, and
    another a day of event time after its last one, to forget it: a price of more than a day before is none.
    """

    def __init__(self, rules: list[LevelRule]):
        self.groups: dict[tuple[str, str], list[tuple[float, bool, int]]] = {}
        for r in rules:
            self.groups.setdefault((r.name, r.severity), []).append((float(r.level), r.direction == "above", r.cooldown_s))
        for same in self.groups.values():
            same.sort()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, event long, price double")
        self.known = handle.getValueState("known", "price double, seen long, until array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if len(batch):
                self.pending.appendList(list(zip(*(batch[x].tolist() for x in ("at", "event", "price")), strict=True)))
                self.handle.registerTimer(-(-int(batch["at"].min()) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ticks = sorted(self.pending.get()) if self.pending.exists() else []
        due, later = [t for t in ticks if t[0] <= now], [t for t in ticks if t[0] > now]
        price, seen, until = self.known.get() if self.known.exists() else (None, 0, [0] * len(self.groups))
        until = list(until)
        if not ticks and max([seen + DAY_MS * 1000, *until]) < now:
            self.known.clear()
            return
        found = []
        for at, _, x in due:
            if at - seen > DAY_MS * 1000:
                price = None
            for i, ((rule, severity), same) in enumerate(self.groups.items()):
                for level, up, cooldown in same:
                    crossed = price is not None and (price <= level < x if up else price >= level > x)
                    if crossed and at >= until[i]:
                        found.append((rule, key[0], severity, at, x))
                        until[i] = at + cooldown * 1_000_000
            price, seen = x, at
        if due:
            self.known.update((price, seen, until))
            self.pending.clear()
            if later:
                self.pending.put(later)
        self.handle.registerTimer(-(-later[0][0] // 1000) if later else max([seen // 1000 + DAY_MS, *(x // 1000 for x in until)]) + 1)
        if found:
            yield pd.DataFrame(found, columns=["rule", "code", "severity", "at_us", "price"])

    def close(self) -> None:
        pass


def alerts(ticks: DataFrame, rules: list[LevelRule], late: str = "2 hours", key: str = "user_id", at: str = "ts", price: str = "value", event: str = "event_id") -> DataFrame:
    """rule, code, severity, at, price: crossings of each rule's level by each target, at most one in a cool-down of
    its rule, target and severity. Ticks without a price or time are left out; those later than `late` are dropped.

    Give the session STATE_STORE before the stream starts.
    """
    t = ticks.withColumn(at, c(at).cast("timestamp")).where(c(at).isNotNull() & c(price).isNotNull()).withWatermark(at, late)
    rows = t.select(c(key).cast("long").alias("code"), c(at), F.unix_micros(at).alias("at"), c(event).cast("long").alias("event"), c(price).cast("double").alias("price"))
    out = rows.groupBy("code").transformWithStateInPandas(CooldownAlerts(rules), "rule string, code long, severity string, at_us long, price double", "Append", "EventTime")
    return out.select("rule", "code", "severity", F.timestamp_micros("at_us").alias("at"), "price")


def told_once(triggers: DataFrame, keys: list[str], at: str, late: str = "2 hours") -> DataFrame:
    """The first trigger of each key: rows with the same key within `late` of it are dropped, and state goes with the
    watermark. Null is a key like others."""
    return triggers.withColumn(at, c(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
