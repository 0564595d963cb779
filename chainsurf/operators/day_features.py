"""Open-interest features: chain -> strikes -> days.

The chain meets the day dimension once.  Everything up to the day row is keyed by
(ticker, trade_date), so one shuffle of the chain serves the join, the front-expiry
window, the strike sums, the strike ranks and the day sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import above, band, below, change, days_to_expiry, dte_bucket, gated_zscore, moneyness, safe_div
from ..schemas import DAY_KEY, OI, SPOTS
from .asof import spots
from .calendar import next_monthly

BUCKETS = {"0_30": (0, 30), "31_90": (31, 90), "91_365": (91, 365)}
SIDES = {"all": None, "call": "C", "put": "P"}
BANDS = {"within_5pct": lambda m: band(m, 0.05), "within_10pct": lambda m: band(m, 0.10), "above_spot": above, "below_spot": below}


def day_dim(chain: DataFrame, ohlc: DataFrame, listed: DataFrame | None = None, gate: bool = False) -> DataFrame:
    """(ticker, trade_date, spot_pc, spot_co, next_monthly) of every chain day; ``gate`` drops tickers without prices."""
    return next_monthly(spots(chain.select(*DAY_KEY), ohlc, gate), listed if listed is not None else chain)


def with_dte(chain: DataFrame) -> DataFrame:
    return chain.withColumn("dte", days_to_expiry(F.col("expiration"), F.col("trade_date")))


def joined(chain: DataFrame, days: DataFrame) -> DataFrame:
    """The chain with dte, spots, next_monthly and front (is this the day's nearest live expiry?)."""
    rows = with_dte(chain.select(*DAY_KEY, "expiration", "strike", "option_type", OI))
    rows = rows.join(days.hint("merge"), DAY_KEY)  # files of a chain are small for their rows: broadcast, it would leave all rows to the few tasks of the days
    nearest = F.min(F.when(F.col("dte") >= 0, F.col("expiration"))).over(Window.partitionBy(*DAY_KEY))
    return rows.withColumn("front", F.coalesce(F.col("expiration") == nearest, F.lit(False)))


def _where(side: str | None, lo_hi: tuple[int, int] | None = None) -> Column:
    cond = F.lit(True) if side is None else F.col("option_type") == side
    return cond if lo_hi is None else cond & dte_bucket(F.col("dte"), *lo_hi)


def strike_level(rows: DataFrame) -> DataFrame:
    """One row per day and strike; a sum is null where no row of its kind stands at the strike."""
    oi = F.col(OI)
    sums = {f"{n}_oi": F.sum(F.when(_where(s), oi)) for n, s in SIDES.items()}
    sums |= {f"{n}_oi_{b}": F.sum(F.when(_where(s, r), oi)) for b, r in BUCKETS.items() for n, s in SIDES.items()}
    sums |= {"dte_oi": F.sum(F.col("dte") * oi), "front_oi": F.sum(F.when(F.col("front"), oi)), "nm_oi": F.sum(F.when(F.col("expiration") == F.col("next_monthly"), oi))}
    return rows.groupBy(*DAY_KEY, "spot_pc", "spot_co", "strike").agg(*[v.alias(k) for k, v in sums.items()])


def rank_strikes(strikes: DataFrame) -> DataFrame:
    """``strikes`` with ``rk``: place by interest within the day; equal sums rank in any order."""
    return strikes.withColumn("rk", F.row_number().over(Window.partitionBy(*DAY_KEY).orderBy(F.desc("all_oi"))))


def _biggest(side: str) -> Column:
    """The strike with the most interest on a side; ties go to the lowest strike."""
    oi = F.col(f"{side}_oi")
    return F.max_by("strike", F.when(oi.isNotNull(), F.struct(oi, -F.col("strike"))))


def per_day(strikes: DataFrame) -> DataFrame:
    """One row per day from (ranked) strikes: totals, bands, buckets, weighted strikes, tops."""
    k, zero = F.col("strike"), F.lit(0).cast("bigint")
    out = {"total_oi": F.sum("all_oi")}
    for n in ("call", "put"):
        out[f"{n}_oi"] = F.coalesce(F.sum(f"{n}_oi"), zero)
        out[f"max_oi_strike_{n}"] = _biggest(n)
    for s in SPOTS:
        m = moneyness(k, F.col(f"spot_{s}"))
        out |= {f"oi_{b}_{s}": F.sum(F.when(hit(m), F.col("all_oi")).when(m.isNotNull(), zero)) for b, hit in BANDS.items()}
    for n in SIDES:
        out[f"oi_weighted_{n}"] = safe_div(F.sum(k * F.col(f"{n}_oi")), F.sum(f"{n}_oi"))
        out |= {f"oi_weighted_{n}_{b}d": safe_div(F.sum(k * F.col(f"{n}_oi_{b}")), F.sum(f"{n}_oi_{b}")) for b in BUCKETS}
    out |= {f"oi_{b}": F.coalesce(F.sum(f"all_oi_{b}"), zero) for b in BUCKETS}
    out |= {"weighted_avg_dte": safe_div(F.sum("dte_oi"), F.sum("all_oi")), "front_oi": F.sum("front_oi"), "nm_oi": F.sum("nm_oi"), "nm_strike_oi": F.sum(k * F.col("nm_oi"))}
    if "rk" in strikes.columns:
        out |= {f"top{n}_oi": F.sum(F.when(F.col("rk") <= n, F.col("all_oi")).otherwise(zero)) for n in (5, 10)}
    return strikes.groupBy(*DAY_KEY, "spot_pc", "spot_co").agg(*[v.alias(c) for c, v in out.items()])


def day_rows(chain: DataFrame, ohlc: DataFrame, listed: DataFrame | None = None, gate: bool = False) -> DataFrame:
    return per_day(rank_strikes(strike_level(joined(chain, day_dim(chain, ohlc, listed, gate)))))


def with_ratios(days: DataFrame) -> DataFrame:
    """Ratios and shares within the day."""
    total = F.col("total_oi")
    new = {"put_call_oi_ratio": safe_div(F.col("put_oi"), F.col("call_oi")), "pct_oi_in_front_expiry": safe_div(F.col("front_oi"), total), "pct_oi_next_monthly": safe_div(F.col("nm_oi"), total)}
    new |= {f"top{n}_strikes_pct_total_oi": safe_div(F.col(f"top{n}_oi"), total) for n in (5, 10)}
    new |= {f"pct_oi_{b}d": safe_div(F.col(f"oi_{b}"), total) for b in BUCKETS}
    weighted = [f"oi_weighted_{n}{t}" for t in ("", "_0_30d", "_31_90d") for n in SIDES]
    for s in SPOTS:
        spot = F.col(f"spot_{s}")
        new |= {f"{c}_div_spot_{s}": safe_div(F.col(c), spot) for c in weighted}
        new |= {f"oi_weighted_{n}_minus_spot_{s}": F.col(f"oi_weighted_{n}") - spot for n in SIDES}
        new |= {f"pct_oi_{b}_{s}": safe_div(F.col(f"oi_{b}_{s}"), total) for b in BANDS}
        new[f"oi_above_below_ratio_{s}"] = safe_div(F.col(f"oi_above_spot_{s}"), F.col(f"oi_below_spot_{s}"))
        new[f"oi_weighted_next_monthly_div_spot_{s}"] = safe_div(safe_div(F.col("nm_strike_oi"), F.col("nm_oi")), spot)
    return days.withColumns(new)


def with_lags(days: DataFrame) -> DataFrame:
    """Changes against 1, 5 and 20 rows earlier of the same ticker."""
    new = {f"d{n}_total_oi_change": change("total_oi", n) for n in (1, 5, 20)}
    for n in (1, 5):
        new[f"d{n}_total_oi_pct_change"] = safe_div(change("total_oi", n), F.col("total_oi") - change("total_oi", n))
        new[f"d{n}_put_call_oi_ratio_change"] = change("put_call_oi_ratio", n)
        new |= {f"d{n}_oi_weighted_all_div_spot_change_{s}": change(f"oi_weighted_all_div_spot_{s}", n) for s in SPOTS}
    out = days.withColumns(new)
    return out.withColumn("d1_d5_ratio_total_oi_pct_change", safe_div(F.col("d1_total_oi_pct_change"), F.col("d5_total_oi_pct_change")))


ZSCORES = {
    "zscore_d1_oi_change_3m": "d1_total_oi_change",
    "zscore_d5_oi_change_3m": "d5_total_oi_change",
    "zscore_put_call_oi_ratio_3m": "put_call_oi_ratio",
} | {f"zscore_{c}_3m_{s}": f"{c}_{s}" for c in ("oi_weighted_all_div_spot", "oi_above_below_ratio") for s in SPOTS}


def with_zscores(days: DataFrame, n: int = 60) -> DataFrame:
    """Gated z-scores over n rows of the ticker, the current one included."""
    return days.withColumns({z: gated_zscore(c, n) for z, c in ZSCORES.items()})


def over_days(days: DataFrame) -> DataFrame:
    """Day rows with their ratios, changes and z-scores."""
    return with_zscores(with_lags(with_ratios(days)))


def oi_features(chain: DataFrame, ohlc: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """All features that come from open interest, one row per (ticker, trade_date)."""
    return over_days(day_rows(chain, ohlc, listed))
