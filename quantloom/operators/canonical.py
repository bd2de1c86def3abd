"""Provider rows mapped to a dataset's contract: an ordered list of rules compiled to one projection.

Every row gets its mapped columns and the code of the first rule it breaks, in the order null, enumeration,
unit, identity, type, field by field, then the dataset's own rules, then the key. Rows that break one go to a
second output of the same pass, and a report counts them by reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.sources.scratch import written

c = F.col
#: Contract types and theirs here, texts that stand for yes and no, units of statements.
TYPES = {"string": "string", "date": "date", "timestamptz": "timestamp", "number": "decimal(38,12)", "integer": "bigint", "boolean": "boolean"}
YES, NO = ("true", "1", "yes", "y", "open"), ("false", "0", "no", "n", "closed")
STATEMENT_UNITS = ("CNY", "RMB", "USD", "EUR", "shares", "yuan", "thousand_cny", "million_cny", "billion_cny", "percent", "ratio", "per_share")
PRICES = ("open", "high", "low", "close")
NOT_NEGATIVE = (*PRICES, "prev_close", "price_limit_up", "price_limit_down", "volume_shares", "amount_cny")
#: Each dataset's key, and those whose rows belong to a registered identity.
KEYS = {
    "security_master": ("entity_key",),
    "trading_calendar": ("market", "trade_date"),
    "bar_1d_raw": ("entity_key", "trade_date"),
    "benchmark_index_1d": ("benchmark_id", "trade_date"),
    "instrument_status_daily": ("entity_key", "status_date"),
    "listing_status_history": ("entity_key", "effective_from"),
    "corporate_action": ("corporate_action_id", "revision"),
    "financial_statement": ("entity_key", "report_period", "statement_type", "line_item", "revision"),
}


@dataclass(frozen=True)
class Field:
    """A target field: where it comes from and what it must be. `unit` multiplies numbers; `identity` is
    entity_key or canonical_id if the source names a security to be resolved."""

    target: str
    source: str
    type: str
    required: bool = False
    enum: dict[str, str] | None = None
    unit: str | None = None
    identity: str | None = None


@dataclass(frozen=True)
class Mapping:
    dataset: str
    fields: tuple[Field, ...]
    key: tuple[str, ...] = field(default=())

    def __post_init__(self):
        unknown = [f.type for f in self.fields if f.type not in TYPES]
        if unknown:
            raise ValueError(f"unknown contract types: {unknown}")
        if len({f.target for f in self.fields}) < len(self.fields):
            raise ValueError("a target field is mapped twice")

    @property
    def keys(self) -> tuple[str, ...]:
        return self.key or KEYS.get(self.dataset) or (self.fields[0].target,)


def _typed(value: Column, kind: str) -> tuple[Column, Column]:
    """The value in its contract type, and whether it isn't one. Numbers have at most 26 digits before the
    point and are rounded to 12 behind it; dates take the first ten characters, year first."""
    text = value.cast("string")
    trimmed = F.trim(text)
    if kind == "string":
        out = text
    elif kind == "date":
        out = F.when(F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(text, 1, 10).try_cast("date"))
    elif kind == "timestamptz":
        # An instant needs an offset.
        out = F.when(trimmed.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), trimmed.try_cast("timestamp"))
    elif kind == "boolean":
        out = F.when(F.lower(trimmed).isin(*YES), True).when(F.lower(trimmed).isin(*NO), False)
    else:
        number = trimmed.try_cast("decimal(38,12)")
        whole = F.when(~F.lower(trimmed).isin("true", "false") & (number == F.floor(number)), number.try_cast("bigint"))
        out = number if kind == "number" else whole
    return out, value.isNotNull() & out.isNull()


def _field_rules(f: Field, now: Column | None) -> tuple[Column, list[tuple[Column, str]]]:
    """The field's value and its rules in order: (broken, code)."""
    value, rules = c(f"row.{f.source}"), []
    if f.required:
        rules.append((value.isNull(), "CANONICAL_NULL_FORBIDDEN"))
    if f.enum is not None:
        table = F.create_map(*[F.lit(x) for pair in f.enum.items() for x in pair])
        known = F.element_at(table, value.cast("string"))
        rules.append((value.isNotNull() & known.isNull(), "CANONICAL_ENUM_UNKNOWN"))
        value = known
    if f.unit is not None:
        number = F.trim(value.cast("string")).try_cast("decimal(26,12)")
        rules.append((value.isNotNull() & number.isNull(), "CANONICAL_TYPE_INVALID"))
        value = (number * F.lit(Decimal(f.unit)).cast("decimal(12,6)")).cast("decimal(38,12)")
    if f.identity is not None:
        status = c(f"__id_{f.target}.status")
        found = c(f"__id_{f.target}.{f.identity}")
        rules.append((value.isNotNull() & F.coalesce(status == "AMBIGUOUS", F.lit(False)), "CANONICAL_IDENTITY_AMBIGUOUS"))
        rules.append((value.isNotNull() & (~F.coalesce(status.isin("RESOLVED", "INACTIVE"), F.lit(False)) | found.isNull()), "CANONICAL_IDENTITY_UNRESOLVED"))
        value = found
    value, bad = _typed(value, f.type)
    rules.append((bad, "CANONICAL_TYPE_INVALID"))
    if f.target == "available_at" and now is not None:
        rules.append((value > now, "CANONICAL_AVAILABLE_AT_FUTURE"))
    return value, rules


def _dataset_rules(dataset: str, has: Callable[[str], bool]) -> list[tuple[Column, str]]:
    """Rules over the mapped columns, in order. A column that the mapping lacks counts as null."""
    v = lambda x: c(f"out.{x}") if has(x) else F.lit(None)
    any_of = lambda *xs: [x for x in xs if has(x)]
    rules = [(v("published_at") > v("available_at"), "CANONICAL_DISCLOSURE_AFTER_AVAILABLE")] if has("published_at") and has("available_at") else []
    negative = [v(x) < 0 for x in any_of(*NOT_NEGATIVE)]
    whole = all(map(has, PRICES))
    ordered = (v("high") < F.greatest(v("open"), v("close"))) | (v("low") > F.least(v("open"), v("close")))
    complete = v("open").isNotNull() & v("close").isNotNull() & v("high").isNotNull() & v("low").isNotNull()
    if dataset in ("bar_1d_raw", "benchmark_index_1d"):
        rules += [(x, "CANONICAL_NEGATIVE_VALUE") for x in negative]
        rules += [(complete & ordered, "CANONICAL_OHLC_INVALID")] if whole else []
    elif dataset == "trading_calendar":
        opened, closed = v("session_open_at"), v("session_close_at")
        rules.append((v("is_open") & (opened.isNull() | closed.isNull() | F.coalesce(closed <= opened, F.lit(False))), "CANONICAL_CALENDAR_INVALID"))
        rules.append((~v("is_open") & (opened.isNotNull() | closed.isNotNull()), "CANONICAL_CALENDAR_INVALID"))
    elif dataset == "instrument_status_daily":
        rules.append((v("instrument_status").isin("SUSPENDED", "DELISTED") & v("is_tradable"), "CANONICAL_STATUS_INCONSISTENT"))
    elif dataset == "listing_status_history":
        rules.append((v("effective_to") <= v("effective_from"), "CANONICAL_LISTING_INTERVAL_INVALID"))
    elif dataset == "corporate_action":
        rules += [(v(x) < v("ex_date"), "CANONICAL_ACTION_DATES_INVALID") for x in any_of("record_date", "payment_date")]
        rules += [(v(x) < 0, "CANONICAL_ACTION_AMOUNT_INVALID") for x in any_of("ratio", "cash_amount")]
    elif dataset == "financial_statement":
        rules.append((~F.coalesce(v("unit").isin(*STATEMENT_UNITS), F.lit(False)), "CANONICAL_UNIT_UNKNOWN"))
    if dataset in ("corporate_action", "financial_statement"):
        rules.append((F.coalesce(v("revision"), F.lit(0)) < 1, "CANONICAL_REVISION_INVALID"))
    return rules


def map_rows(rows: DataFrame, mapping: Mapping, ordinal: str, identities: DataFrame | None = None, calendar: DataFrame | None = None, market: str = "CN", now: Column | None = None) -> DataFrame:
    """One row for each row given: `ordinal`, `row` (as it came), `out` (mapped), `code` and `field` of the first
    rule it breaks (null if it keeps all), as a written table: accepted, rejected and the report read one pass.

    ordinal     a column that is unique and gives the order in which rows came: of rows with one key that keep
                all other rules, the first is accepted
    identities  value, status, entity_key, canonical_id: one row for each value of a provider (a missing one
                is unresolved)
    calendar    market, trade_date, is_open: days not in it are unavailable, closed ones no trading days
    """
    needs = [f for f in mapping.fields if f.identity]
    if needs and identities is None:
        raise ValueError("fields with an identity need a table of identities")
    df = rows.select(c(ordinal).alias("ordinal"), F.struct(*rows.columns).alias("row"))
    for f in needs:
        table = identities.select(c("value").alias(f"__v_{f.target}"), F.struct("status", "entity_key", "canonical_id").alias(f"__id_{f.target}"))
        df = df.join(table, c(f"row.{f.source}").cast("string") == c(f"__v_{f.target}"), "left")
    told, values = [], []
    for f in mapping.fields:
        value, rules = _field_rules(f, now)
        values.append(value.cast(TYPES[f.type]).alias(f.target))
        told += [(broken, code, f.target) for broken, code in rules]
    df = df.withColumn("out", F.struct(*values))
    targets = {f.target for f in mapping.fields}
    told += [(broken, code, None) for broken, code in _dataset_rules(mapping.dataset, targets.__contains__)]
    if calendar is not None and "trade_date" in targets:
        days = calendar.where(c("market") == market).select(c("trade_date").alias("__day"), c("is_open").alias("__open")).dropDuplicates(["__day"])
        df = df.join(F.broadcast(days), c("out.trade_date") == c("__day"), "left")  # one row for each day
        told += [(c("__day").isNull(), "CANONICAL_TRADING_CALENDAR_UNAVAILABLE", None), (~c("__open"), "CANONICAL_NON_TRADING_DAY", None)]
    if told:
        first = F.coalesce(*[F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(name).cast("string").alias("field"))) for broken, code, name in told])
    else:
        first = F.lit(None).cast("struct<code:string,field:string>")
    checked = written(df.select("ordinal", "row", "out", first.alias("first")), "mapped")
    keys = [c(f"out.{k}").alias(f"__k{i}") for i, k in enumerate(mapping.keys)]
    # The first row of a key is found by its ordinal alone, so a key of very many rows meets nowhere.
    firsts = checked.where("first is null").select("ordinal", *keys).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min("ordinal").alias("ordinal"))
    tagged = checked.join(firsts.select("ordinal", F.lit(True).alias("__is_first")), "ordinal", "left")
    again = c("first").isNull() & c("__is_first").isNull()
    return written(tagged.select("ordinal", "row", "out", F.when(again, "CANONICAL_DUPLICATE_KEY").otherwise(c("first.code")).alias("code"), c("first.field").alias("field")), "mapped")


def accepted(mapped: DataFrame) -> DataFrame:
    return mapped.where("code is null").select("out.*")


def rejected(mapped: DataFrame) -> DataFrame:
    """The rows as they came, with the rule they break."""
    return mapped.where("code is not null").select("ordinal", "code", "field", "row.*")


def quality_report(mapped: DataFrame, mapping: Mapping) -> DataFrame:
    """One row: quality_status, counts of rows, rejected ones, duplicates, unresolved and ambiguous identities,
    failure_reasons (sorted, each once). Listing intervals of an entity that overlap are a reason too."""
    n = lambda code: F.count_if(F.coalesce(c("code") == code, F.lit(False)))
    report = mapped.agg(
        F.count("*").alias("row_count"), F.count("code").alias("rejected_row_count"), n("CANONICAL_DUPLICATE_KEY").alias("duplicate_key_count"),
        n("CANONICAL_IDENTITY_UNRESOLVED").alias("identity_unresolved_count"), n("CANONICAL_IDENTITY_AMBIGUOUS").alias("identity_ambiguous_count"), F.collect_set("code").alias("reasons"),
    )
    overlaps = F.lit(False)
    if mapping.dataset == "listing_status_history":
        from quantloom.operators.sentiment import overlapping

        spans = accepted(mapped).select("entity_key", c("effective_from").alias("valid_from"), c("effective_to").alias("valid_to"))
        overlaps = F.lit(not overlapping(spans, "entity_key").isEmpty())
    reasons = F.array_sort(F.concat("reasons", F.when(overlaps, F.array(F.lit("CANONICAL_LISTING_INTERVAL_OVERLAP"))).otherwise(F.array().cast("array<string>"))))
    return report.withColumn("failure_reasons", reasons).withColumn("quality_status", F.when(F.size("failure_reasons") == 0, "COMPLETE").otherwise("FAILED")).drop("reasons")


def rejections(mapped: DataFrame) -> DataFrame:
    """Rejected rows by code and field."""
    return mapped.where("code is not null").groupBy("code", "field").agg(F.count("*").alias("n"))
