"""Columns from loose provider values: text, codes, numbers and flags, where what can't be read is empty or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of nothing, dashes that stand for no number, words for yes.
NOTHING = ("", "nan", "none", "<na>", "na", "null")
DASHES, YES = ("-", "--"), ("1", "true", "yes", "on")
TICKER = r"^(?=.*[A-Za-z])[A-Za-z0-9][A-Za-z0-9.\-]{0,19}$"


def safe_text(x: Column, longest: int | None = None) -> Column:
    """Trimmed text; null and spellings of nothing are empty."""
    text = F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    out = F.when(F.lower(text).isin(*NOTHING), "").otherwise(text)
    return out if longest is None else F.substring(out, 1, longest)


def safe_code(x: Column, width: int = 6, tickers: bool = False) -> Column:
    """A stock code: digits filled up with zeros (or their last `width`), else six digits that stand alone, else, with
    `tickers`, a ticker in capitals, else whatever digits there are; empty without any."""
    text = safe_text(x, 80)
    text = F.when(text.rlike(r"^\d+\.0$"), F.regexp_extract(text, r"^(\d+)\.0$", 1)).otherwise(text)
    filled = lambda digits: F.when(F.length(digits) >= width, F.substring(digits, -width, width)).otherwise(F.lpad(digits, width, "0"))
    alone, digits = F.regexp_extract(text, r"(?<!\d)(\d{6})(?!\d)", 1), F.regexp_replace(text, r"\D", "")
    out = F.when(text == "", "").when(text.rlike(r"^\d+$"), filled(text)).when(alone != "", alone)
    if tickers:
        out = out.when(text.rlike(TICKER), F.upper(text))
    return out.when(digits != "", filled(digits)).otherwise("")


def safe_number(x: Column) -> Column:
    """A number out of text with percent signs and thousands' commas; null for dashes and what is no number."""
    text = safe_text(x)
    number = F.regexp_replace(text, "[%,]", "").try_cast("double")
    return F.when(~text.isin("", *DASHES) & ~F.isnan(number), number)


def safe_int(x: Column) -> Column:
    """The whole part of a number, towards zero; null where it has none."""
    number = safe_number(x)
    return F.when(F.abs(number) < 9.2e18, number.cast("long"))


def safe_bool(x: Column) -> Column:
    """True for words for yes, false for other text, null for nothing."""
    text = safe_text(x)
    return F.when(text != "", F.lower(text).isin(*YES))
