"""The surface and the saved analytical views over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moneyness, safe_div
from ..schemas import CONTRACT_KEY, DAY_KEY, OI
from .day_features import with_dte

#: Fixes the order of equal interest.
TIE_BREAK = ["expiration", "strike", "option_type"]


def build_surface(chain: DataFrame, ohlc: DataFrame, min_oi: int | None = None, max_dte: int | None = None, max_abs_moneyness: float | None = None) -> DataFrame:
    """The chain with dte, same-day close and moneyness; filters are off unless given."""
    closes = ohlc.groupBy(*DAY_KEY).agg(F.max("close").alias("spot_close"))
    out = with_dte(chain.select(*CONTRACT_KEY, OI)).join(closes, DAY_KEY, "left")
    out = out.withColumn("dte", F.col("dte").cast("smallint")).withColumn("moneyness", moneyness(F.col("strike"), F.col("spot_close")))
    if min_oi is not None:
        out = out.filter(F.col(OI) >= min_oi)
    if max_dte is not None:
        out = out.filter(F.col("dte") <= max_dte)
    return out if max_abs_moneyness is None else out.filter(F.abs("moneyness") <= max_abs_moneyness)


def latest_rows(df: DataFrame, by: str = "ticker") -> DataFrame:
    """The rows of each ticker's latest day: a semi-join with the small table of maxima, no shuffle of a ticker into one task."""
    last = df.groupBy(by).agg(F.max("trade_date").alias("trade_date"))
    return df.join(last, [by, "trade_date"], "left_semi")


def surface_latest(surface: DataFrame) -> DataFrame:
    return latest_rows(surface)


def top_nodes_latest(surface: DataFrame, n: int = 25) -> DataFrame:
    """The n contracts with the most interest on each ticker's latest day, with ``oi_rank``."""
    order = Window.partitionBy("ticker").orderBy(F.desc(OI), *TIE_BREAK)
    return latest_rows(surface).withColumn("oi_rank", F.row_number().over(order)).filter(F.col("oi_rank") <= n)


def oi_changes_daily(surface: DataFrame) -> DataFrame:
    """Each contract's interest against its previous available day."""
    contract = Window.partitionBy("ticker", "expiration", "strike", "option_type").orderBy("trade_date")
    out = surface.withColumnRenamed(OI, "oi_today").withColumn("oi_prev", F.lag("oi_today").over(contract))
    out = out.withColumn("oi_change", F.col("oi_today") - F.col("oi_prev"))
    out = out.withColumn("oi_pct_change", F.when(F.col("oi_prev") > 0, F.col("oi_change").cast("double") / F.col("oi_prev")))
    return out.select(*DAY_KEY, "expiration", "dte", "strike", "option_type", "oi_today", "oi_prev", "oi_change", "oi_pct_change", "spot_close", "moneyness")


def oi_concentration(surface: DataFrame) -> DataFrame:
    """Totals per expiration; n_strikes counts rows, so a strike's call and put count twice."""
    oi = F.col(OI)
    side = lambda s: F.sum(F.when(F.col("option_type") == s, oi).otherwise(F.lit(0)))
    return surface.groupBy(*DAY_KEY, "expiration", "dte").agg(
        F.sum(oi).alias("total_oi"),
        side("C").alias("call_oi"),
        side("P").alias("put_oi"),
        F.count(F.lit(1)).alias("n_strikes"),
        F.min("strike").alias("min_strike"),
        F.max("strike").alias("max_strike"),
        F.avg("spot_close").alias("spot_close"),
        safe_div(F.sum(F.col("strike") * oi), F.sum(oi)).alias("oi_weighted_strike"),
    )


def features_with_returns(features: DataFrame, ohlc: DataFrame) -> DataFrame:
    closes = ohlc.select(*DAY_KEY, F.col("close").alias("close_today"), F.col("adj_close").alias("adj_close_today"))
    return features.join(closes, DAY_KEY, "left")


def front_rows(surface: DataFrame) -> DataFrame:
    """The rows of each day's nearest live expiration."""
    nearest = F.min(F.when(F.col("dte") >= 0, F.col("expiration"))).over(Window.partitionBy(*DAY_KEY))
    return surface.withColumn("_front", nearest).filter("expiration = _front").drop("_front")


def pin_candidates(surface: DataFrame, width: float = 0.05) -> DataFrame:
    """Front-expiry contracts near the spot, ranked; the front is found before the band is applied."""
    order = Window.partitionBy(*DAY_KEY).orderBy(F.desc(OI), *TIE_BREAK)
    near = front_rows(surface).filter(F.abs("moneyness") <= width)
    return near.withColumn("rank_in_front", F.row_number().over(order))


def register_views(surface: DataFrame, features: DataFrame, ohlc: DataFrame, prefix: str = "v_") -> list[str]:
    """Create or replace a temporary view for each of the above."""
    views = {
        "oi_surface_latest": surface_latest(surface),
        "oi_top_nodes_latest": top_nodes_latest(surface),
        "oi_changes_daily": oi_changes_daily(surface),
        "oi_concentration": oi_concentration(surface),
        "features_with_returns": features_with_returns(features, ohlc),
        "pin_candidates": pin_candidates(surface),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + v for v in views]
