"""Provider tables and broker files read into the library's columns, with what can't be used told apart."""

from __future__ import annotations

import csv
import datetime as dt
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quantloom.functions.columns import ladder
from quantloom.sources.scratch import written

c = F.col
#: Names a bar's columns go by, in order of preference; columns that are numbers.
BAR_ALIASES = {
    "date": ("date", "trade_date", "datetime", "time", "日期", "交易日期"),
    "open": ("open", "open_price", "开盘", "开盘价"),
    "high": ("high", "high_price", "最高", "最高价"),
    "low": ("low", "low_price", "最低", "最低价"),
    "close": ("close", "close_price", "收盘", "收盘价"),
    "volume": ("volume", "vol", "成交量"),
}
BAR_NUMBERS = ("open", "high", "low", "close", "volume", "amount", "pct_chg")
#: The hour from which today's bar is whole.
CLOSED = dt.time(16, 0)
#: Names a snapshot's columns go by at each provider; columns that are numbers.
_CHINESE = {
    "code": ("代码",),
    "name": ("名称",),
    "price": ("最新价",),
    "change_pct": ("涨跌幅",),
    "amount": ("成交额",),
    "total_mv": ("总市值",),
    "circ_mv": ("流通市值",),
    "pe_ratio": ("市盈率-动态", "市盈率(动)"),
    "pb_ratio": ("市净率",),
    "volume_ratio": ("量比",),
    "turnover_rate": ("换手率",),
    "industry": ("行业", "所属行业", "行业板块"),
    "concepts": ("概念", "概念题材", "题材"),
}
SNAPSHOT_ALIASES = {
    "efinance": _CHINESE | {"code": ("股票代码", "代码"), "name": ("股票名称", "名称"), "pe_ratio": ("动态市盈率", "市盈率(动)")},
    "akshare_em": _CHINESE,
    "sina": {"code": ("code",), "name": ("name",), "price": ("trade",), "change_pct": ("changepercent",), "amount": ("amount",), "total_mv": ("mktcap",), "circ_mv": ("nmc",), "pe_ratio": ("per",), "pb_ratio": ("pb",), "turnover_rate": ("turnoverratio",)},
    "tushare": {"code": ("symbol", "code"), "price": ("close",), "change_pct": ("pct_chg",), "pe_ratio": ("pe",), "pb_ratio": ("pb",)},
}
SNAPSHOT_NUMBERS = ("price", "change_pct", "amount", "total_mv", "circ_mv", "pe_ratio", "pb_ratio", "volume_ratio", "turnover_rate")
#: Names the columns of brokers' files go by, words for the sides, costs that add up.
TRADE_ALIASES = {
    "trade_date": ("成交日期", "发生日期", "日期", "成交时间"),
    "symbol": ("证券代码", "股票代码", "代码"),
    "side": ("买卖标志", "买卖方向", "交易方向", "业务名称", "操作"),
    "quantity": ("成交数量", "数量", "成交股数"),
    "price": ("成交均价", "成交价格", "价格", "成交价", "均价"),
    "trade_uid": ("成交编号", "成交序号", "合同编号", "委托编号", "流水号"),
    "currency": ("币种", "货币"),
}
BROKER_FIRST = {
    "huatai": {},
    "citic": {"trade_date": ("发生日期",), "side": ("买卖方向",), "price": ("成交价格",), "trade_uid": ("合同编号",)},
    "cmb": {"trade_date": ("日期",), "side": ("交易方向", "买卖方向"), "quantity": ("成交股数", "成交数量"), "price": ("成交价", "成交价格"), "trade_uid": ("流水号",)},
}
FEES, TAXES = ("手续费", "佣金", "交易费", "规费", "过户费"), ("印花税", "税费", "其他税费")
BUY, SELL = ("buy", "b", "买", "买入", "证券买入", "普通买入"), ("sell", "s", "卖", "卖出", "证券卖出", "普通卖出")
#: All spellings of nan, so that values need not be put in small letters.
NAN = ("nan", "naN", "nAn", "nAN", "Nan", "NaN", "NAn", "NAN")
#: Fixed value: the encoding of brokers' files that are not UTF-8.
FALLBACK = "gb18030"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DAY = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?$"


def number(x: Column) -> Column:
    """A double out of a plain number, else null; commas, signs of percent and NaN are no numbers."""
    text = F.trim(x.cast("string"))
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def day(x: Column) -> Column:
    """The date of a text in one of the usual forms, with or without a time; else null."""
    text = F.regexp_replace(F.translate(F.trim(x.cast("string")), "/", "-"), r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3")
    return F.when(text.rlike(_DAY), text.try_cast("date"))


def find_column(df: DataFrame, names: Sequence[str], loose: bool = False) -> str | None:
    """The first of the names that the table has; `loose`, whatever the case and blanks around it."""
    have = {(x.strip().lower() if loose else x): x for x in reversed(df.columns)}
    return next((have[x] for x in names if x in have), None)


def _quoted(name: str) -> Column:
    return c("`" + name.replace("`", "``") + "`")


def _once(row: Column) -> Column:
    """The fields of a struct as columns that are computed once a row: a condition on plain columns is moved
    ahead of them, with all of their expressions in place of each mention."""
    return F.inline(F.array(row))


def clean_bars(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with dates and numbers, and the rows that aren't: the original columns and `problem`.

    Problems: date (a text that is none), close, volume (missing or no number). A missing date is kept, as
    null. Other numbers that can't be read are null. Rows come in no order; what needs one sorts by date.
    """
    parsed = {x: number(c(x)) for x in BAR_NUMBERS if x in df.columns}
    parsed |= {"date": day(c("date"))} if "date" in df.columns else {}
    told = df.withColumn("_row", F.struct(*[_quoted(x) for x in df.columns])).withColumns(parsed)
    no_date = c("_row.date").isNotNull() & c("date").isNull() if "date" in df.columns else F.lit(False)
    told = told.withColumn("problem", ladder((no_date, "date"), (c("close").isNull(), "close"), (c("volume").isNull(), "volume")))
    return told.where("problem IS NULL").drop("_row", "problem"), told.where("problem IS NOT NULL").select("_row.*", "problem")


def alert_bars(df: DataFrame, required: Sequence[str], now: dt.datetime, code: str = "code", order: str = "position") -> DataFrame:
    """code, date and the required numbers, found by any of their names; rows that lack one go.

    Before 16:00 of `now` an instrument's last row, by `order` (no two alike), goes if it is of today or has
    no date, for that bar isn't whole yet. Raises where a required column is missing.
    """
    found = {x: find_column(df, BAR_ALIASES[x], loose=True) for x in ("date", *required)}
    missing = [x for x in required if found[x] is None]
    if missing:
        raise ValueError(f"bars lack {', '.join(missing)}")
    date = day(_quoted(found["date"])) if found["date"] else F.lit(None).cast("date")
    bars = df.select(code, order, date.alias("date"), *[number(_quoted(found[x])).alias(x) for x in required]).dropna(subset=list(required))
    if now.time() >= CLOSED:
        return bars
    last = bars.groupBy(code).agg(F.max(F.struct(order, "date")).alias("_last")).select(code, "_last.*")
    unfinished = last.where(c("date").isNull() | (c("date") == F.lit(now.date()))).select(code, order)
    return bars.join(unfinished, [code, order], "left_anti")


def provider_snapshot(df: DataFrame, source: str) -> DataFrame:
    """A provider's snapshot under the library's names; rows without a price above zero go. Columns that
    no name fits stay as they are; a source not known renames nothing."""
    renames = {find_column(df, names): ours for ours, names in SNAPSHOT_ALIASES.get(source, {}).items()}
    renames.pop(None, None)
    columns = [renames.get(x, x) for x in df.columns if x in renames or x not in renames.values()]
    kept = [x for x in df.columns if x in renames or x not in renames.values()]
    out = df.select(*[(number(_quoted(x)) if ours in SNAPSHOT_NUMBERS else _quoted(x)).alias(ours) for x, ours in zip(kept, columns, strict=True)])
    return out.where(c("price") > 0) if "price" in columns else out


def _first_value(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns that says something in this row."""
    text = lambda x: F.trim(_quoted(x).cast("string"))
    values = [F.when(~text(x).isin("", *NAN), text(x)) for x in names if x in df.columns]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def _side(text: Column) -> Column:
    word = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    return ladder((word.isin(*BUY), "buy"), (word.isin(*SELL), "sell"), (word.contains("买入") | word.startswith("买"), "buy"), (word.contains("卖出") | word.startswith("卖"), "sell"))


def broker_trades(df: DataFrame, broker: str, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """Trades out of a broker's rows, and the rows that are none: the original columns and `problem`.

    Each column takes the first of its names that has a value in the row, the broker's own names first.
    Problems: trade_date, symbol, side, quantity or price (not above zero). Fees and taxes add up. Of rows
    of one file that are alike in all that is kept, `copy` numbers them, and dedup_hash covers it: importing
    a file again gives the same hashes, and fills that happen to be equal stay apart.
    """
    names = {x: (*BROKER_FIRST[broker].get(x, ()), *rest) for x, rest in TRADE_ALIASES.items()}
    value = {x: _first_value(df, names[x]) for x in names}
    amount = lambda x: number(F.replace(x, F.lit(","), F.lit("")))
    total = lambda columns: sum((F.coalesce(amount(_first_value(df, [x])), F.lit(0.0)) for x in columns), F.lit(0.0))
    texts = [x.alias(name) for name, x in value.items()]
    told = df.select(F.struct(*[_quoted(x).alias(f"_{i}") for i, x in enumerate(df.columns)]).alias("_row"), (c(file) if file in df.columns else F.lit("")).alias("_file"), *texts, total(FEES).alias("fee"), total(TAXES).alias("tax"))
    told = told.select("_row", "_file", day(c("trade_date")).alias("trade_date"), F.upper("symbol").alias("symbol"), _side(c("side")).alias("side"), amount(c("quantity")).alias("quantity"), amount(c("price")).alias("price"), "fee", "tax", "trade_uid", F.upper("currency").alias("currency"))
    lacks = [(c(x).isNull(), x) for x in ("trade_date", "symbol", "side")] + [(~F.coalesce(c(x) > 0, F.lit(False)), x) for x in ("quantity", "price")]
    told = told.withColumn("problem", ladder(*lacks))
    # Both results come from one reading, which is written with the original columns of the bad rows alone.
    told = written(told.withColumn("_row", F.when(c("problem").isNotNull(), c("_row"))), "trades")
    kept = ["trade_date", "symbol", "side", "quantity", "price", "fee", "tax", "trade_uid", "currency"]
    good = told.where("problem IS NULL").groupBy("_file", *kept).agg(F.count(F.lit(1)).alias("_n"))
    good = good.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    money = [F.format_string("%.8f", c(x)) for x in ("quantity", "price", "fee", "tax")]
    payload = F.concat_ws("|", c("trade_date").cast("string"), "symbol", "side", *money, F.coalesce("trade_uid", F.lit("")), F.coalesce("currency", F.lit("")), c("copy").cast("string"))
    return good.select(*kept, c("_file").alias("file"), "copy", F.sha2(payload, 256).alias("dedup_hash")), told.where("problem IS NOT NULL").select(*[c(f"_row._{i}").alias(x) for i, x in enumerate(df.columns)], "problem")


@F.pandas_udf(StringType())
def _decoded(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else bytes(x).decode(FALLBACK, "replace"))


def read_broker_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of brokers' files of one layout as text, with `file`; a file that isn't UTF-8 throughout is read
    as GB18030, which covers the older national encodings.

    Lines are told apart as bytes, so large files are split; a value can't hold a line break. The first line
    of a file names the columns, the same in all files. Where a name is used twice or is empty, a number
    follows it. Without any line the table is empty and has `file` alone.
    """
    lines = spark.read.text(path).select(c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("at"), c("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("valid"))
    top = lines.where(c("at") == 0).first()
    if top is None:
        return lines.select("file")
    head = bytes(top.line).decode("utf-8-sig" if top.valid else FALLBACK)
    names: list[str] = []
    for name in next(csv.reader([head])):
        names.append(name.strip() if name.strip() and name.strip() not in names else f"{name.strip()}_{len(names)}")
    utf = F.regexp_replace(c("line").cast("string"), "^\ufeff", "")
    rows = lines.select("file", utf.alias("text"))
    commas = F.octet_length("line") - F.octet_length(F.replace(c("line").cast("string"), F.lit(","), F.lit("")))
    files = written(lines.groupBy("file").agg(F.min("valid").alias("whole"), F.max(commas).alias("commas")), "files")
    widest = files.agg(F.max("commas")).first()[0]
    foreign = files.where(~c("whole")).select("file")
    if not foreign.isEmpty():  # lines are decoded after the join alone
        other = lines.join(F.broadcast(foreign), "file", "left_semi").select("file", _once(F.struct(_decoded("line").alias("text"))))
        rows = lines.join(F.broadcast(foreign), "file", "left_anti").select("file", utf.alias("text")).unionByName(other)
    body = rows.where((c("text") != head) & (F.trim("text") != ""))
    # A parser sets up room for all columns at each line, so it is told how many there can be.
    options = {"escape": '"', "maxColumns": str(max(widest, len(names)) + 2)}
    return body.select("file", _once(F.from_csv("text", ", ".join(f"`{x}` STRING" for x in names), options))).select(*[_quoted(x) for x in names], "file")
