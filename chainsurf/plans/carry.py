"""Features of new days, continued from the stored rows of the days before.

Lags and z-scores look back over day rows, and what they need of a day stands in the
feature store already: its totals and ratios.  So a new day needs the chain of that day
alone, the stored rows of the buffer, and prices; the chain of the buffer isn't opened.
The stored rows stand in for those that a range rebuild would compute again from the
chain; for a ticker with 65 day rows in the buffer the result is that of a full rebuild.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import BUFFER_DAYS, refresh_window
from ..operators.day_features import day_rows, with_lags, with_ratios, with_zscores
from ..operators.merge import replace_features
from ..operators.ohlc_features import ohlc_features
from ..operators.quality import align_schema
from ..schemas import DAY_KEY, FEATURES
from ..sources.store import filter_range, read_chain, read_expirations, read_features, read_ohlc
from .features import nan_to_null

#: What lags and z-scores take from a stored day.
CARRIED = ["total_oi", "put_call_oi_ratio"] + [f"{c}_{s}" for c in ("oi_weighted_all_div_spot", "oi_above_below_ratio") for s in ("pc", "co")]
PRICE_FEATURES = [f.name for f in FEATURES if f.name.startswith(("rv_", "ret_"))]


def continued_features(chain: DataFrame, ohlc: DataFrame, stored: DataFrame, listed: DataFrame, start: date, end: date) -> DataFrame:
    """The features of [start, end] from the chain of these days and the stored features before them."""
    since = start - timedelta(days=BUFFER_DAYS)
    prices = filter_range(ohlc, since, end)
    fresh = with_ratios(day_rows(filter_range(chain, start, end), prices, listed, gate=True)).withColumn("_new", F.lit(True))
    before = filter_range(stored, since, start - timedelta(days=1)).select(*DAY_KEY, *CARRIED, F.lit(False).alias("_new"))
    days = with_zscores(with_lags(fresh.unionByName(before, allowMissingColumns=True))).filter("_new")
    return align_schema(nan_to_null(days.join(ohlc_features(prices), DAY_KEY, "left")), FEATURES)


def with_new_returns(stored: DataFrame, ohlc: DataFrame, start: date, end: date) -> DataFrame:
    """Stored features of a range, with volatility and returns of the prices up to ``end``."""
    prices = ohlc_features(filter_range(ohlc, start - timedelta(days=BUFFER_DAYS), end))
    return align_schema(nan_to_null(stored.drop(*PRICE_FEATURES).join(prices, DAY_KEY, "left")), FEATURES)


def added_days(spark: SparkSession, root: str, since: date, as_of: date) -> DataFrame:
    """The rows that a refresh of [since, as_of] replaces: the new days, and the returns of the days before them."""
    first = min(since, refresh_window(as_of)["features"][0])
    buffer = since - timedelta(days=BUFFER_DAYS)
    chain, ohlc, listed = read_chain(spark, f"{root}/chain", since, as_of), read_ohlc(spark, f"{root}/ohlc", first - timedelta(days=BUFFER_DAYS), as_of), read_expirations(spark, f"{root}/chain")
    stored = read_features(spark, f"{root}/features", min(buffer, first), since - timedelta(days=1))
    out = continued_features(chain, ohlc, stored, listed, since, as_of)
    return out.unionByName(with_new_returns(filter_range(stored, first, since - timedelta(days=1)), ohlc, first, as_of))


def add_days(spark: SparkSession, root: str, since: date, as_of: date) -> None:
    """Bring the feature store up to ``as_of``, where chain rows have changed from ``since`` on only."""
    first = min(since, refresh_window(as_of)["features"][0])
    replace_features(added_days(spark, root, since, as_of), f"{root}/features", first, as_of)
