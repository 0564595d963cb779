"""As-of and same-day spots, at day grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _timeline(dates: DataFrame, series: DataFrame, values: list[str], by: str, on: str) -> DataFrame:
    """The wanted dates and the series' rows one after the other, with the series' values in ``_row``."""
    points = series.select(by, on, F.struct(*values).alias("_row"), F.lit(False).alias("_wanted"))
    return dates.select(by, on).distinct().select(by, on, F.lit(None).cast(points.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_wanted")).unionByName(points)


def _before(value: str, by: str, on: str) -> Column:
    """The value at the latest series row of an earlier day; it travels in a struct, so a null value is a value."""
    strictly = Window.partitionBy(by).orderBy(F.unix_date(on)).rangeBetween(Window.unboundedPreceding, -1)
    point = F.when(F.col("_row").isNotNull(), F.struct(F.col(on), F.struct(F.col(f"_row.{value}").alias("v")).alias("x")))
    return F.max(point).over(strictly)["x"]["v"]


def as_of_prior(dates: DataFrame, series: DataFrame, value: str, name: str | None = None, by: str = "ticker", on: str = "trade_date") -> DataFrame:
    """``dates`` (by, on) with the series' value at its latest row strictly before.

    Dates and series are united and one window per ``by`` looks back from each date.  A
    matched row with a null value gives null instead of an older one.
    """
    return _timeline(dates, series, [value], by, on).withColumn(name or value, _before(value, by, on)).filter("_wanted").select(by, on, name or value)


def spot_same_day(dates: DataFrame, ohlc: DataFrame) -> DataFrame:
    """``dates`` with ``spot_co``: the open of the same day, null where there is none."""
    opens = ohlc.groupBy("ticker", "trade_date").agg(F.max("open").alias("spot_co"))
    return dates.join(opens, ["ticker", "trade_date"], "left")


def spots(dates: DataFrame, ohlc: DataFrame, gate: bool = False) -> DataFrame:
    """(ticker, trade_date, spot_pc, spot_co): both spots from one exchange by ticker; ``gate`` drops tickers without any price."""
    line = _timeline(dates, ohlc, ["open", "close"], "ticker", "trade_date")
    found = line.withColumns(
        {
            "spot_pc": _before("close", "ticker", "trade_date"),
            "spot_co": F.max("_row.open").over(Window.partitionBy("ticker", "trade_date")),
            "_priced": F.count("_row").over(Window.partitionBy("ticker")) > 0,
        }
    )
    return found.filter("_wanted AND _priced" if gate else "_wanted").select("ticker", "trade_date", "spot_pc", "spot_co")


def ticker_gate(chain: DataFrame, ohlc: DataFrame) -> DataFrame:
    """The chain rows of tickers that have prices too."""
    return chain.join(ohlc.select("ticker").distinct(), "ticker", "left_semi")
