"""Canonical schemas and keys."""

from __future__ import annotations

from pyspark.sql.types import DateType, DoubleType, LongType, ShortType, StringType, StructField, StructType

#: The column of a contract's interest in all tables, and (a fixed value) its field in landed payloads.
OI = "oi"
OI_FIELD = "open_interest"
CONTRACT_KEY = ["ticker", "trade_date", "expiration", "strike", "option_type"]
DAY_KEY = ["ticker", "trade_date"]


def _struct(**kinds) -> StructType:
    return StructType([StructField(k, v()) for k, v in kinds.items()])


CHAIN = _struct(ticker=StringType, trade_date=DateType, expiration=DateType, strike=DoubleType, option_type=StringType, **{OI: LongType})
OHLC = _struct(ticker=StringType, trade_date=DateType, open=DoubleType, high=DoubleType, low=DoubleType, close=DoubleType, adj_close=DoubleType, volume=LongType, dividends=DoubleType, splits=DoubleType)
SURFACE = StructType([*CHAIN.fields, *_struct(dte=ShortType, spot_close=DoubleType, moneyness=DoubleType).fields])

SPOTS = ("pc", "co")


#: The feature columns in their order.
FEATURE_COLUMNS = """
ticker trade_date spot_pc spot_co total_oi call_oi put_oi put_call_oi_ratio max_oi_strike_call max_oi_strike_put oi_weighted_call oi_weighted_put
oi_weighted_all oi_weighted_call_minus_spot_pc oi_weighted_call_minus_spot_co oi_weighted_put_minus_spot_pc oi_weighted_put_minus_spot_co
oi_weighted_all_minus_spot_pc oi_weighted_all_minus_spot_co oi_weighted_call_div_spot_pc oi_weighted_call_div_spot_co oi_weighted_put_div_spot_pc
oi_weighted_put_div_spot_co oi_weighted_all_div_spot_pc oi_weighted_all_div_spot_co oi_within_5pct_pc oi_within_5pct_co oi_within_10pct_pc
oi_within_10pct_co pct_oi_in_front_expiry oi_above_spot_pc oi_above_spot_co oi_below_spot_pc oi_below_spot_co oi_above_below_ratio_pc
oi_above_below_ratio_co oi_weighted_all_0_30d oi_weighted_call_0_30d oi_weighted_put_0_30d oi_weighted_all_0_30d_div_spot_pc
oi_weighted_all_0_30d_div_spot_co oi_weighted_call_0_30d_div_spot_pc oi_weighted_call_0_30d_div_spot_co oi_weighted_put_0_30d_div_spot_pc
oi_weighted_put_0_30d_div_spot_co oi_weighted_all_31_90d oi_weighted_call_31_90d oi_weighted_put_31_90d oi_weighted_all_31_90d_div_spot_pc
oi_weighted_all_31_90d_div_spot_co oi_weighted_call_31_90d_div_spot_pc oi_weighted_call_31_90d_div_spot_co oi_weighted_put_31_90d_div_spot_pc
oi_weighted_put_31_90d_div_spot_co d1_total_oi_change d5_total_oi_change d20_total_oi_change rv_5d rv_20d ret_1d_fwd_oc ret_3d_fwd_oc ret_5d_fwd_oc
ret_7d_fwd_oc ret_10d_fwd_oc ret_20d_fwd_oc pct_oi_within_5pct_pc pct_oi_within_5pct_co pct_oi_within_10pct_pc pct_oi_within_10pct_co
pct_oi_above_spot_pc pct_oi_above_spot_co pct_oi_below_spot_pc pct_oi_below_spot_co top5_strikes_pct_total_oi top10_strikes_pct_total_oi
weighted_avg_dte pct_oi_0_30d pct_oi_31_90d pct_oi_91_365d pct_oi_next_monthly oi_weighted_next_monthly_div_spot_pc
oi_weighted_next_monthly_div_spot_co d1_total_oi_pct_change d5_total_oi_pct_change d1_d5_ratio_total_oi_pct_change
d1_oi_weighted_all_div_spot_change_pc d1_oi_weighted_all_div_spot_change_co d5_oi_weighted_all_div_spot_change_pc
d5_oi_weighted_all_div_spot_change_co d1_put_call_oi_ratio_change d5_put_call_oi_ratio_change zscore_d1_oi_change_3m zscore_d5_oi_change_3m
zscore_oi_weighted_all_div_spot_3m_pc zscore_oi_weighted_all_div_spot_3m_co zscore_put_call_oi_ratio_3m zscore_oi_above_below_ratio_3m_pc
zscore_oi_above_below_ratio_3m_co
""".split()
_LONGS = set("total_oi call_oi put_oi oi_within_5pct_pc oi_within_5pct_co oi_within_10pct_pc oi_within_10pct_co oi_above_spot_pc oi_above_spot_co oi_below_spot_pc oi_below_spot_co d1_total_oi_change d5_total_oi_change d20_total_oi_change".split())
FEATURES = StructType([StructField(c, StringType() if c == "ticker" else DateType() if c == "trade_date" else LongType() if c in _LONGS else DoubleType()) for c in FEATURE_COLUMNS])
