"""Trading days and monthly expirations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import third_friday

#: Calendar days that a daily refresh looks back: prices, interest, features; and the feature buffer.
LOOK_BACK = {"ohlc": 10, "chain": 10, "features": 45}
BUFFER_DAYS = 130


def trading_days(spark: SparkSession, start: date | str, end: date | str, holidays: DataFrame) -> DataFrame:
    """Weekdays of the inclusive range that are no holiday (a table with one column, ``date``)."""
    span = spark.sql("SELECT explode(sequence(to_date(:a), to_date(:b))) AS trade_date", args={"a": str(start), "b": str(end)})
    span = span if str(start) <= str(end) else span.limit(0)
    return span.filter(F.weekday("trade_date") < 5).join(holidays.select(F.col("date").alias("trade_date")), "trade_date", "left_anti")


def last_trading_day(dates: DataFrame, calendar: DataFrame, by: str = "trade_date", look_back: int = 10) -> DataFrame:
    """``dates`` with ``last_trading_day``: the latest calendar day on or before, within the look-back, else the date itself.

    An equi-join of each date's ``look_back`` + 1 candidate days with the calendar.
    """
    wanted = dates.select(by).distinct()
    candidates = wanted.withColumn("_day", F.explode(F.sequence(F.date_sub(by, look_back), F.col(by))))
    found = candidates.join(calendar.select(F.col("trade_date").alias("_day")).distinct(), "_day").groupBy(by).agg(F.max("_day").alias("_last"))
    return dates.join(found, by, "left").withColumn("last_trading_day", F.coalesce("_last", F.col(by))).drop("_last")


def next_monthly(days: DataFrame, listed: DataFrame) -> DataFrame:
    """``days`` (ticker, trade_date, ...) with ``next_monthly``.

    The candidate is the first third Friday on or after the day.  It holds if listed; else
    the Thursday before, if listed; else it holds anyway.  So on an unlisted third Friday
    with a listed Thursday the result is the day before.
    """
    here = third_friday(F.col("trade_date"))
    friday = F.when(here >= F.col("trade_date"), here).otherwise(third_friday(F.add_months(F.trunc("trade_date", "MM"), 1)))
    exp, third = F.col("expiration"), third_friday(F.col("expiration"))
    known = listed.groupBy("ticker").agg(  # at most one entry for each month of a ticker
        F.collect_set(F.when(exp == third, exp)).alias("_fridays"),
        F.collect_set(F.when(exp == F.date_sub(third, 1), third)).alias("_thursdays"),
    )
    out = days.withColumn("_fri", friday).join(known, "ticker", "left")
    early = ~F.array_contains("_fridays", F.col("_fri")) & F.array_contains("_thursdays", F.col("_fri"))
    return out.withColumn("next_monthly", F.when(early, F.date_sub("_fri", 1)).otherwise(F.col("_fri"))).select(*days.columns, "next_monthly")


def refresh_window(as_of: date) -> dict[str, tuple[date, date]]:
    """The date ranges of a daily refresh, and the range that features are computed over."""
    out = {k: (as_of - timedelta(days=n), as_of) for k, n in LOOK_BACK.items()}
    return out | {"buffer": (out["features"][0] - timedelta(days=BUFFER_DAYS), as_of)}
