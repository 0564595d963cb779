"""Features of the price series alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import by_day, log_return, safe_div, trailing

HORIZONS = (1, 3, 5, 7, 10, 20)


def log_returns(ohlc: DataFrame) -> DataFrame:
    return ohlc.withColumn("log_ret", log_return(F.col("close"), F.lag("close").over(by_day())))


def realised_vol(returns: DataFrame, ns: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Yearly deviation of the last n log returns; any two known returns give a value."""
    return returns.withColumns({f"rv_{n}d": F.stddev_samp("log_ret").over(trailing(n)) * F.sqrt(F.lit(252.0)) for n in ns})


def forward_returns(ohlc: DataFrame, ns: tuple[int, ...] = HORIZONS) -> DataFrame:
    """From the row's open to the close n - 1 rows later."""
    return ohlc.withColumns({f"ret_{n}d_fwd_oc": safe_div(F.lead("close", n - 1).over(by_day()), F.col("open")) - 1 for n in ns})


def ohlc_features(ohlc: DataFrame) -> DataFrame:
    out = forward_returns(realised_vol(log_returns(ohlc.select("ticker", "trade_date", "open", "close"))))
    return out.select("ticker", "trade_date", "rv_5d", "rv_20d", *[f"ret_{n}d_fwd_oc" for n in HORIZONS])
