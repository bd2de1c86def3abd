"""Labels and heat of a mapping merged into a snapshot, column by column, each by its own resolver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.loose import safe_code, safe_int, safe_number, safe_text

c = F.col
#: Separators of labels, what stands for no label, the code of nothing.
LABEL_BREAKS, SUMMARY_BREAKS = "[,，、]", r"[\n|]"
NO_LABEL, NO_CODE = ("", "nan", "none", "<na>"), "000000"
#: Labels a summary keeps, resolvers of the snapshot's columns, the trend of a board.
SUMMARY_LABELS = 8
RESOLVERS = {
    "industry": "fill",
    "concepts": "labels",
    "industry_rank": "least",
    "industry_change_pct": "fill_number",
    "industry_heat_score": "most",
    "concept_heat_score": "most",
    "board_heat_score": "most",
    "board_heat_latest_score": "most",
    "board_heat_trend_score": "farthest",
    "board_heat_persistence_score": "most",
    "board_heat_cooling_score": "most",
    "board_heat_observations": "most",
    "board_heat_state": "fill",
    "board_heat_summary": "summary",
}
WHOLE = ("industry_rank", "board_heat_observations")
TREND = ("board_heat_latest_score", "board_heat_trend_score", "board_heat_persistence_score", "board_heat_cooling_score", "board_heat_observations", "board_heat_state")


def _distinct_labels(texts: Sequence[Column], breaks: str) -> Column:
    parts = F.concat(*[F.split(F.coalesce(x.cast("string"), F.lit("")), breaks) for x in texts])
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda x: ~F.lower(x).isin(*NO_LABEL)))


def label_union(*texts: Column) -> Column:
    """The labels of all texts joined by commas, each where it is first seen; spellings of nothing are none."""
    return F.array_join(_distinct_labels(texts, LABEL_BREAKS), ",")


def summary_union(*texts: Column) -> Column:
    """The same for summaries, whose parts stand between bars or on lines of their own; eight stay."""
    return F.array_join(F.slice(_distinct_labels(texts, SUMMARY_BREAKS), 1, SUMMARY_LABELS), " | ")


def summary_boards(text: Column) -> Column:
    """The boards a summary names: what stands before a colon in each of its parts."""
    parts = F.slice(_distinct_labels([text], SUMMARY_BREAKS), 1, SUMMARY_LABELS)
    boards = F.transform(parts, lambda x: F.regexp_replace(F.substring_index(x, ":", 1), r"(?U)^\s+|\s+$", ""))
    return F.filter(boards, lambda x: x != "")


def _number(wins: Callable[[Column, Column], Column] | None) -> Callable[[Column, Column, bool], tuple[Column, Column]]:
    def resolve(old: Column, new: Column, whole: bool) -> tuple[Column, Column]:
        was, now = safe_number(old), safe_int(new).cast("double") if whole else safe_number(new)
        told = safe_number(new)  # compared before it is made whole
        better = told.isNotNull() & (was.isNull() if wins is None else was.isNull() | wins(told, was))
        return F.when(better, now).otherwise(was), better

    return resolve


def _text(join: Callable[[Column, Column], Column]) -> Callable[[Column, Column, bool], tuple[Column, Column]]:
    def resolve(old: Column, new: Column, whole: bool) -> tuple[Column, Column]:
        was, now = safe_text(old), safe_text(new)
        out = F.when(now == "", was).otherwise(join(was, now))
        return out, out != was

    return resolve


#: A resolver makes, of the column here and the one that comes in, the new value and whether it differs.
RESOLVE = {
    "fill": _text(lambda was, now: F.when(was == "", now).otherwise(was)),
    "labels": _text(label_union),
    "summary": _text(summary_union),
    "fill_number": _number(None),
    "most": _number(lambda now, was: now > was),
    "least": _number(lambda now, was: now < was),
    "farthest": _number(lambda now, was: F.abs(now) > F.abs(was)),
}


def last_of_each(mapping: DataFrame, code: str, order: Sequence[str]) -> DataFrame:
    """A mapping's last row of each stock code, by `order`; rows without a code go."""
    rest, place = [x for x in mapping.columns if x != code], F.struct(*order)
    spelt = mapping.groupBy(code).agg(F.max_by(F.struct(*rest), place).alias("_last"), F.max(place).alias("_place"))
    # A code is put in its form once for each spelling, not for each row.
    keyed = spelt.select(F.inline(F.array(F.struct(safe_code(c(code)).alias(code), "_last", "_place")))).where(~c(code).isin("", NO_CODE))
    return keyed.groupBy(code).agg(F.max_by("_last", "_place").alias("_last")).select(code, "_last.*")


def merge_mapping(snapshot: DataFrame, mapping: DataFrame, code: str = "code", resolvers: dict[str, str] | None = None) -> DataFrame:
    """The snapshot with each resolved column settled, and `changed`, the names of those that are new.

    The mapping has one row per code (see `last_of_each`). Columns the mapping lacks stay as they are;
    those the snapshot lacks come from the mapping alone. Numbers come back as doubles, whole ones as longs.
    A row without a code, or whose code isn't mapped, keeps its values.
    """
    rules = {k: v for k, v in (resolvers or RESOLVERS).items() if k in mapping.columns}
    incoming = mapping.select(c(code).alias("_code"), *[c(k).alias(f"_new_{k}") for k in rules])
    joined = snapshot.withColumn("_code", safe_code(c(code))).join(incoming, "_code", "left")
    values, flags = {}, []
    for name, rule in rules.items():
        old = c(name) if name in snapshot.columns else F.lit(None).cast("string")
        value, changed = RESOLVE[rule](old, c(f"_new_{name}"), name in WHOLE)
        values[name] = value.cast("long") if name in WHOLE else value
        flags.append(F.when(changed, F.lit(name)))
    out = joined.withColumns({**values, "changed": F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")})
    return out.drop("_code", *[f"_new_{k}" for k in rules])


def fan_out(left: DataFrame, members: str, right: DataFrame, on: str) -> DataFrame:
    """Each row of `left` with each row of `right` that its array names, once however often it names it."""
    return left.withColumn(on, F.explode(F.array_distinct(members))).join(right, on)


def best_board_trend(mapping: DataFrame, trends: DataFrame, key: str) -> DataFrame:
    """The mapping with the trend of the best board its summary names: most observations, then the latest
    score, then the size of the trend score, then the board named first. Rows that name no board with a
    trend keep their values. trends has one row per board; key tells the mapping's rows apart.
    """
    named = mapping.select(key, F.posexplode(summary_boards(c("board_heat_summary"))).alias("_at", "board"))
    rank = F.struct(F.coalesce("board_heat_observations", F.lit(0)).cast("long"), F.coalesce("board_heat_latest_score", F.lit(0.0)), F.abs(F.coalesce("board_heat_trend_score", F.lit(0.0))), -c("_at"))
    best = named.join(trends.select("board", *TREND), "board").groupBy(key).agg(F.max_by(F.struct(*TREND), rank).alias("_best"))
    joined = mapping.join(best, key, "left")
    value = lambda x: F.when(c("_best").isNull(), c(x)).otherwise(c(f"_best.{x}")) if x in mapping.columns else c(f"_best.{x}")
    return joined.withColumns({x: value(x) for x in TREND}).drop("_best")
