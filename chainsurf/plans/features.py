"""The combined feature table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calendar import BUFFER_DAYS
from ..operators.day_features import day_rows, over_days
from ..operators.ohlc_features import ohlc_features
from ..operators.quality import align_schema
from ..schemas import DAY_KEY, FEATURES
from ..sources.store import filter_range


def slice_range(df: DataFrame, start) -> DataFrame:
    """Rows from ``start`` on; to be used after the windows."""
    return df if start is None else df.filter(F.col("trade_date") >= F.lit(str(start)).cast("date"))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def daily_features(chain: DataFrame, ohlc: DataFrame, start=None, end=None, listed: DataFrame | None = None) -> DataFrame:
    """One row of all features per (ticker, trade_date) of the chain.

    With ``start``, only [start, end] comes back, computed from ``BUFFER_DAYS`` earlier on;
    prices are cut at ``end`` too, so forward returns near it may be null.  Expirations
    count as listed over the full history, which ``listed`` (ticker, expiration) may give
    in place of the chain.  Tickers need both chain and price rows.
    """
    listed = chain if listed is None else listed
    if start is not None:
        start = date.fromisoformat(str(start)[:10])
        end = date.fromisoformat(str(end)[:10]) if end is not None else date.today()
        chain, ohlc = (filter_range(x, start - timedelta(days=BUFFER_DAYS), end) for x in (chain, ohlc))
    # prices join the day rows while these are still dealt by day; the windows by ticker come last
    days = day_rows(chain, ohlc, listed, gate=True).join(ohlc_features(ohlc), DAY_KEY, "left")
    return align_schema(nan_to_null(slice_range(over_days(days), start)), FEATURES)
