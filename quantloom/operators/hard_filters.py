"""Hard filters of a screen by their public names, their waterfall, and the split of those that need daily features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.screening import Rule, excludes_names, hard_filters, waterfall

c = F.col


class MissingColumn(ValueError):
    """A filter is set and the frame lacks every column that it could read."""


@dataclass(frozen=True)
class Filter:
    """kind: min and max keep values not below or above (what isn't a number fails), flag keeps what is true, any_of
    what is in a list, compared as text. The first of `columns` that the frame has is read."""

    kind: str
    columns: tuple[str, ...]
    daily: bool = False


def _bounds(name: str, *columns: str, low: bool = True, high: bool = True, daily: bool = False) -> dict[str, Filter]:
    return {f"{name}_{kind}": Filter(kind, columns, daily) for kind, wanted in (("min", low), ("max", high)) if wanted}


#: The filters' names, what they read, and words of names that mark special treatment.
SPECIAL_NAMES, NAME_COLUMNS, CODE_COLUMNS = "ST|退", ("name", "股票名称", "名称"), ("code", "代码", "symbol")
FILTERS: dict[str, Filter] = {
    "exclude_st": Filter("name", NAME_COLUMNS),
    **_bounds("amount", "amount", "成交额", high=False),
    **_bounds("price", "price", "最新价", "现价"),
    **_bounds("market_cap", "total_mv", "总市值"),
    **_bounds("pe_ttm", "pe_ratio", "市盈率"),
    **_bounds("pb", "pb_ratio", "市净率"),
    **_bounds("volume_ratio", "volume_ratio", "量比", high=False),
    **_bounds("turnover_rate", "turnover_rate", "换手率", high=False),
    **_bounds("change_pct", "change_pct", "涨跌幅"),
    **_bounds("change_60d", "change_60d", daily=True),
    "require_ma_bullish": Filter("flag", ("ma_bullish",), True),
    "require_price_above_ma20": Filter("flag", ("price_above_ma20",), True),
    **_bounds("signal_score", "signal_score", high=False, daily=True),
    "macd_status_whitelist": Filter("any_of", ("macd_status",), True),
    "rsi_status_whitelist": Filter("any_of", ("rsi_status",), True),
    **_bounds("breakout_20d_pct", "breakout_20d_pct", daily=True),
    **_bounds("range_20d_pct", "range_20d_pct", low=False, daily=True),
    **_bounds("volume_ratio_20d", "volume_ratio_20d", daily=True),
    **_bounds("body_pct", "body_pct", daily=True),
    **_bounds("pullback_to_ma20_pct", "pullback_to_ma20_pct", daily=True),
    **_bounds("consolidation_days_20d", "consolidation_days_20d", daily=True),
    **_bounds("volatility_20d_pct", "volatility_20d_pct", daily=True),
    **_bounds("max_drawdown_20d_pct", "max_drawdown_20d_pct", daily=True),
    **_bounds("atr_20_pct", "atr_20_pct", daily=True),
}


def _first(df: DataFrame, columns: tuple[str, ...]) -> str | None:
    return next((x for x in columns if x in df.columns), None)


def _number(df: DataFrame, column: str) -> Column:
    """Text that isn't a number, and what isn't one anyway, is null."""
    kind = dict(df.dtypes)[column]
    x = F.trim(column).try_cast("double") if kind == "string" else c(column).cast("double")
    return F.when(~F.isnan(x), x)


def _is_set(name: str, value) -> bool:
    kind = FILTERS[name].kind
    return bool(value) if kind in ("name", "flag", "any_of") else value is not None


def needs_daily(settings: dict) -> bool:
    """Whether any filter that is set reads daily features."""
    return any(FILTERS[name].daily for name, value in settings.items() if _is_set(name, value))


def without_daily(settings: dict) -> dict:
    """The settings that a snapshot alone can answer: applied first, they spare the others' daily features."""
    return {name: value for name, value in settings.items() if not FILTERS[name].daily}


def rules(df: DataFrame, settings: dict) -> list[Rule]:
    """The rules that are set, in the filters' order; null fails each, but for a null name.

    MissingColumn if the frame has no column for one, ValueError for a filter that doesn't exist.
    """
    unknown = sorted(set(settings) - set(FILTERS))
    if unknown:
        raise ValueError(f"unknown filters: {unknown}")
    out = []
    for name, f in FILTERS.items():
        value = settings.get(name)
        if not _is_set(name, value):
            continue
        column = _first(df, f.columns)
        if column is None:
            raise MissingColumn(f"filter {name} needs one of the columns {list(f.columns)}; it is set to {value!r}")
        if f.kind == "name":
            condition = excludes_names(SPECIAL_NAMES, column)
        elif f.kind == "flag":
            condition = c(column).cast("string").try_cast("boolean") == F.lit(True)
        elif f.kind == "any_of":
            condition = c(column).cast("string").isin(*map(str, value))
        else:
            condition = _number(df, column) >= value if f.kind == "min" else _number(df, column) <= value
        out.append(Rule(name, F.coalesce(condition, F.lit(False)) if f.kind != "name" else condition))
    return out


def apply_hard_filters(df: DataFrame, settings: dict) -> DataFrame:
    return hard_filters(df, rules(df, settings))


#: Fixed value: from this share on, a filter's removals call for a look at it.
MOST = 0.9


def filter_waterfall(df: DataFrame, settings: dict, samples: int = 3) -> DataFrame:
    """waterfall() of the filters that are set, with `suggestion` and up to `samples` removed rows (code, name, value)
    of each step, by code. One pass for the counts, one for the samples."""
    chosen = rules(df, settings)
    if not chosen:
        return waterfall(df, [Rule("none", F.lit(True))]).limit(0).withColumns({"suggestion": F.lit(""), "samples": F.array().cast("array<struct<code:string,name:string,value:string>>")})
    out = waterfall(df, chosen)
    share = c("removed") / c("before")
    text = F.when(c("removed") <= 0, "").when(c("after") == 0, "removes all candidates that are left: check the limit and the data").when(share >= MOST, "removes over 90% of the candidates that are left: check the limit").otherwise("")
    code, name = _first(df, CODE_COLUMNS), _first(df, NAME_COLUMNS)
    text_of = lambda x: c(x).cast("string") if x else F.lit(None).cast("string")
    step, value = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, rule in reversed(list(enumerate(chosen, 1))):
        column = _first(df, FILTERS[rule.name].columns)
        step, value = F.when(~rule.condition, F.lit(i)).otherwise(step), F.when(~rule.condition, c(column).cast("string")).otherwise(value)
    gone = df.select(step.alias("step"), F.struct(text_of(code).alias("code"), text_of(name).alias("name"), value.alias("value")).alias("sample")).where("step is not null")
    first = gone.withColumn("n", F.row_number().over(Window.partitionBy("step").orderBy("sample"))).where(c("n") <= samples)
    listed = first.groupBy("step").agg(F.array_sort(F.collect_list("sample")).alias("samples"))  # a few rows for each step
    return out.withColumn("suggestion", text).join(F.broadcast(listed), "step", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<struct<code:string,name:string,value:string>>")))


def rejection_summary(df: DataFrame, settings: dict, most: int = 8) -> DataFrame:
    """The first `most` filters, in order, that remove anything: rule, removed, before, after."""
    return waterfall(df, rules(df, settings)).where("removed > 0").orderBy("step").limit(most).select("step", "rule", "removed", "before", "after")
