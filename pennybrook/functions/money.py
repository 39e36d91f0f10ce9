"""Money as integer minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_SAFE_MINOR
from .text import let, nfkc, text, trim_all


def parse_minor(c: Column, scale: int = 2, fold=nfkc) -> Column:
    """An amount as written in a statement, in minor units; null where it can't be read.

    Parentheses negate; separators, white space and currency marks go; one '+' and then one '-' may lead; the first
    dropped digit rounds half up; over 2^53 - 1 is null.  Everything is decided on the digits as text.
    """
    return let(trim_all(fold(text(c))), lambda s: _minor(s, scale))


def _minor(s: Column, scale: int) -> Column:
    bracketed = s.rlike(r"^\(.*\)$")
    inner = F.when(bracketed, F.regexp_extract(s, r"^\((.*)\)$", 1)).otherwise(s)
    signed = F.regexp_replace(F.regexp_replace(inner, r"[^0-9.+\-]", ""), r"^\+", "")

    def read(x: Column) -> Column:
        minus = x.startswith("-")
        whole = F.coalesce(F.nullif(F.regexp_extract(x, r"^-?(\d*)", 1), F.lit("")), F.lit("0"))
        frac = F.rpad(F.regexp_extract(x, r"\.(\d*)$", 1), scale + 1, "0")
        value = F.regexp_replace(F.concat(whole, F.substring(frac, 1, scale)), "^0+(?=.)", "")
        bump = F.when(F.substring(frac, scale + 1, 1) >= "5", 1).otherwise(0)
        number = F.when(F.length(value) <= 17, value.try_cast("long") + bump)
        fine = x.rlike(r"^-?(\d+\.?\d*|\.\d+)$")
        return let(F.when(fine, number), lambda n: F.when(n <= MAX_SAFE_MINOR, n * F.when(bracketed != minus, -1).otherwise(1)))

    return F.when(~s.isin("", "-", "/", "—"), let(signed, read))


def format_minor(c: Column, currency: Column | None = None) -> Column:
    """¥1,234.50, or 'USD 1,234.50' for other currencies."""
    symbol = F.lit("¥") if currency is None else F.when(currency == "CNY", F.lit("¥")).otherwise(F.concat(currency, F.lit(" ")))
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    cents = F.abs(c) % 100
    return F.concat(sign, symbol, F.format_number(((F.abs(c) - cents) / 100).cast("long"), 0), F.lit("."), F.lpad(cents.cast("string"), 2, "0"))


def decimal_string(c: Column, scale: int = 2) -> Column:
    """1890 -> '18.90'."""
    s = F.abs(c).cast("string")
    s = F.when(F.length(s) <= scale, F.lpad(s, scale + 1, "0")).otherwise(s)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, s.substr(F.lit(1), F.length(s) - scale), F.lit("."), s.substr(F.length(s) - scale + 1, F.lit(scale)))


def sum_minor(c: Column | str) -> Column:
    """Exact integer sum; 0 over no rows."""
    return F.coalesce(F.sum(c), F.lit(0).cast("long"))
