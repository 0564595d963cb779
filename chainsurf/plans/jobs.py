"""Jobs over stores: full and range rebuild, daily refresh."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import BUFFER_DAYS, refresh_window
from ..operators.merge import replace_features, upsert_chain, upsert_ohlc
from ..sources import versions
from ..sources.payloads import ingest_history, ingest_snapshot, normalise_ohlc
from ..sources.store import read_chain, read_expirations, read_ohlc
from .features import daily_features


def range_features(spark: SparkSession, root: str, start=None, end=None, tickers: list[str] | None = None) -> DataFrame:
    """The features of the stores below ``root``, all or those of a range.

    A range opens the chain and price partitions of its years and its buffer's only; what
    was ever listed comes from the table that the chain store keeps.
    """
    since = None if start is None else date.fromisoformat(str(start)[:10]) - timedelta(days=BUFFER_DAYS)
    chain, ohlc, listed = read_chain(spark, f"{root}/chain", since, end), read_ohlc(spark, f"{root}/ohlc", since, end), read_expirations(spark, f"{root}/chain")
    if tickers is not None:
        names = [t.upper() for t in tickers]
        chain, ohlc, listed = (x.filter(F.col("ticker").isin(names)) for x in (chain, ohlc, listed))
    return daily_features(chain, ohlc, start, end, listed)


def rebuild(spark: SparkSession, root: str, start=None, end=None, tickers: list[str] | None = None) -> None:
    """Compute and store features from ``root``/chain and ``root``/ohlc, all tickers in one job."""
    if start is not None and end is None:
        end = date.today()
    replace_features(range_features(spark, root, start, end, tickers), f"{root}/features", start, end)


def daily_refresh(spark: SparkSession, root: str, as_of: date, prices: DataFrame, history: DataFrame, snapshot: DataFrame, calendar: DataFrame, keep: int | None = None) -> None:
    """Merge prices, then history, then the snapshot (which so wins), then rebuild the last days.

    The next day's history overwrites today's snapshot of the same contracts.  With
    ``keep``, only so many versions of each store stay readable; without, all do.
    """
    upsert_ohlc(normalise_ohlc(prices), f"{root}/ohlc")
    upsert_chain(ingest_history(history), f"{root}/chain")
    upsert_chain(ingest_snapshot(snapshot, calendar), f"{root}/chain")
    start, end = refresh_window(as_of)["features"]
    rebuild(spark, root, start, end)
    if keep is not None:
        for name in ("ohlc", "chain", "features"):
            versions.vacuum(spark, f"{root}/{name}", keep)
