"""Column functions: all built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0 or null."""
    return a.cast("double") / F.nullif(b, F.lit(0))


def moneyness(strike: Column, spot: Column) -> Column:
    """strike / spot - 1; null unless the spot is above 0."""
    return F.when(spot > 0, strike / spot - 1)


def band(m: Column, width: float) -> Column:
    """Within ``width`` of the spot, both ends in; null where moneyness is."""
    return F.abs(m) <= width


def above(m: Column) -> Column:
    return m > 0


def below(m: Column) -> Column:
    return m < 0


def dte_bucket(dte: Column, lo: int, hi: int) -> Column:
    return dte.between(lo, hi)


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def parse_ymd(c: Column) -> Column:
    """A date from ``YYYY-MM-DD...``, ``YYYYMMDD`` or the same as a number; else null."""
    s = c.cast("string")
    dashed = (F.length(s) >= 10) & (F.substring(s, 5, 1) == "-")
    packed = F.when(F.trim(s).rlike(r"^\d{8}$"), F.trim(s))
    return F.when(dashed, F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")).otherwise(F.try_to_date(packed, "yyyyMMdd"))


def normalise_right(c: Column) -> Column:
    """C or P from c, call, p, put in any case; else null."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("c", "call"), F.lit("C")).when(s.isin("p", "put"), F.lit("P"))


def norm_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def third_friday(c: Column) -> Column:
    """The third Friday of the date's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(c, "MM"), 1), "FRI"), 14)


def days_to_expiry(expiration: Column, trade_date: Column) -> Column:
    return F.datediff(expiration, trade_date)


def log_return(close: Column, previous: Column) -> Column:
    return F.ln(F.nullif(close, F.lit(0)) / F.nullif(previous, F.lit(0)))


def by_day() -> Window:
    """A ticker's rows in date order: lags count rows, not calendar days."""
    return Window.partitionBy("ticker").orderBy("trade_date")


def trailing(n: int) -> Window:
    """The current row and the n - 1 before it."""
    return by_day().rowsBetween(1 - n, 0)


def change(c: str | Column, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c - F.lag(c, n).over(by_day())


def gated_zscore(c: str, n: int = 60) -> Column:
    """(x - mean) / sample deviation over n rows; null until n of them are known, or without spread."""
    w, x = trailing(n), F.col(c)
    return F.when(F.count(x).over(w) >= n, (x - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)))
