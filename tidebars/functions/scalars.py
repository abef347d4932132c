"""Scalar expressions: fees, contract keys, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fee(value: Column, bps: Column | float) -> Column:
    return value * (bps if isinstance(bps, Column) else F.lit(float(bps))) / 10000


def contract_month(day: Column) -> Column:
    """Month of the near contract: from day 25 on the next one."""
    first = F.trunc(day, "MM")
    return F.when(F.dayofmonth(day) >= 25, F.add_months(first, 1)).otherwise(first)


def contract_key(symbol: Column, month: Column) -> Column:
    """``MCX_FO|`` + symbol + two-digit year without padding + month name + ``FUT``."""
    year = F.pmod(F.year(month), F.lit(100)).cast("string")
    return F.concat(F.lit("MCX_FO|"), F.upper(symbol), year, F.upper(F.date_format(month, "MMM")), F.lit("FUT"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def short_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.md5(c), 1, length)


def truncated(c: Column) -> Column:
    """Toward zero."""
    return c.cast("bigint")
