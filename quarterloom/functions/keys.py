"""Canonical spellings of keys and of the time axis, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = "2099-01-01"


def cik_key(c: Column | str) -> Column:
    """Ten digits: the first run of digits without leading zeros, padded. NULL if there is no digit."""
    digits = F.regexp_extract(F.col(c) if isinstance(c, str) else c, "0*([0-9]+)", 1)
    return F.when(digits != "", F.lpad(digits, 10, "0"))


def cusip_key(c: Column | str) -> Column:
    """Nine characters, upper case, zeros in front. NULL if nothing but separators is there."""
    bare = F.upper(F.translate(F.col(c) if isinstance(c, str) else c, " \t\r\n-. ", ""))
    return F.when(bare != "", F.lpad(bare, 9, "0"))


def accession_key(c: Column | str) -> Column:
    """Eighteen digits written 10-2-6. NULL if the digits are not eighteen."""
    d = F.translate(F.col(c) if isinstance(c, str) else c, " \t\r\n- ", "")
    return F.when(F.length(d) == 18, F.concat_ws("-", F.substring(d, 1, 10), F.substring(d, 11, 2), F.substring(d, 13, 6)))


def ticker_key(c: Column | str) -> Column:
    """Upper case, without blanks and without an exchange suffix (``.US`` and the like). NULL if empty."""
    bare = F.upper(F.translate(F.col(c) if isinstance(c, str) else c, " \t\r\n ", ""))
    bare = F.substring_index(F.substring_index(bare, ".", 1), ":", -1)
    return F.when(bare != "", bare)


def issuer_key(c: Column | str) -> Column:
    """Upper case with single blanks and without a closing full stop."""
    return F.rtrim(F.upper(F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))), F.lit("."))


def period(year: Column | str = "year", quarter: Column | str = "quarter") -> Column:
    """The integer quarter axis ``year * 4 + quarter - 1``."""
    y, q = (F.col(x) if isinstance(x, str) else x for x in (year, quarter))
    return (y * 4 + q - 1).cast("int")


def period_year(p: Column) -> Column:
    return F.floor(p / 4).cast("int")


def period_quarter(p: Column) -> Column:
    return (F.pmod(p, F.lit(4)) + 1).cast("int")


def quarter_end(year: Column | str = "year", quarter: Column | str = "quarter") -> Column:
    y, q = (F.col(x) if isinstance(x, str) else x for x in (year, quarter))
    return F.last_day(F.make_date(y, q * 3, F.lit(1)))


def finite(c: Column) -> Column:
    """The value, or NULL for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
