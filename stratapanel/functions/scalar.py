"""Element-wise operators.  Missing is NULL; NaN and infinities never leave these functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_log(x: Column) -> Column:
    """ln(max(x, 1e-9)), NULL for NULL."""
    return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(TINY))))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where |b| <= 1e-9."""
    return F.when(F.abs(b) > TINY, F.try_divide(a, b))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as SQL on doubles has it: infinite, or NaN, over zero.  For figures that are shown or ranked; sums want :func:`safe_div`."""
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def lower_of(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def higher_of(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def shown(x: Column, digits: int = 6) -> Column:
    """A figure as reports show it: rounded half to even, NULL where it is not finite."""
    return F.bround(finite(x.cast("double")), digits)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounding for comparisons between engines, without a negative zero.  The step lies a little off one half, so that exact
    halves, which quotients of cents and counts often are, don't depend on the last bit; :func:`shown` is true rounding.  From 2**52 on
    doubles have no fraction, and a long would overflow; they pass as they are."""
    scale = float(10**digits)
    moved = x.cast("double") * scale + 0.5003
    return F.when(F.abs(moved) < float(1 << 52), F.floor(moved).cast("double")).otherwise(moved) / scale


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


# Identifiers, dates and quarters of market data files.


def exchange_code(code: Column) -> Column:
    """Six digits with the exchange of their first digit: 6 and 9 Shanghai, 0, 2 and 3 Shenzhen, 4 and 8 Beijing."""
    digits = F.lpad(F.regexp_replace(code, "[^0-9]", ""), 6, "0")
    first = F.substring(digits, 1, 1)
    suffix = F.when(first.isin("6", "9"), ".XSHG").when(first.isin("0", "2", "3"), ".XSHE").when(first.isin("4", "8"), ".XBSE")
    return F.when(F.length(F.regexp_replace(code, "[^0-9]", "")) > 0, F.concat(digits, suffix))


def from_short_suffix(code: Column) -> Column:
    """NNNNNN.SZ, .SH or .BJ with the long exchange suffix."""
    tail = F.upper(F.substring_index(code, ".", -1))
    long = F.when(tail == "SZ", "XSHE").when(tail == "SH", "XSHG").when(tail == "BJ", "XBSE")
    return F.concat(F.substring_index(code, ".", 1), F.lit("."), long)


def date_key(text: Column) -> Column:
    """YYYYMMDD as an int from 20200131, 2020-01-31 or 2020/1/31; NULL for anything else, also for the date of zeros."""
    packed = F.when(text.rlike("^[0-9]{8}$"), text)
    y, m, d = (F.regexp_extract(text, r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", i) for i in (1, 2, 3))
    split = F.when(y != "", F.concat(y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    key = F.coalesce(packed, split).try_cast("int")
    return F.when(key > 0, key)


def quarter_key(quarter: Column) -> Column:
    """4 * year + quarter - 1 from '2020q3'."""
    return (F.substring(quarter, 1, 4).try_cast("int") * 4 + F.substring(quarter, 6, 1).try_cast("int") - 1).cast("int")


def identifiers(text: Column) -> Column:
    """The names in an expression or a sentence, in order: a letter or underscore, then letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def json_object(text: Column) -> Column:
    """The outermost {...} of free text, if it is JSON; NULL otherwise."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull(), found) if hasattr(F, "try_parse_json") else F.when(
        F.get_json_object(found, "$").isNotNull(), found,
    )


def date_key_or(text: Column, default: int) -> Column:
    """:func:`date_key`, with a default where there is no date (such as never listed or never delisted)."""
    return F.coalesce(date_key(text), F.lit(default))


def skeleton_text(expr: Column) -> Column:
    """An expression without the digits of its windows."""
    return F.regexp_replace(expr, "[0-9]+", "")
