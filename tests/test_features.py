import math
import statistics
from datetime import date, timedelta

from chainsurf.operators import day_features, ohlc_features
from chainsurf.plans.features import daily_features
from chainsurf.schemas import FEATURE_COLUMNS, FEATURES, OI

D0 = date(2024, 1, 1)
CHAIN = "ticker string, trade_date date, expiration date, strike double, option_type string, " + OI + " bigint"
OHLC = "ticker string, trade_date date, open double, high double, low double, close double, adj_close double, volume bigint, dividends double, splits double"


def day(n):
    return D0 + timedelta(days=n)


def chain(spark, rows):
    """rows: (day, days to expiry, strike, type, interest[, ticker])"""
    return spark.createDataFrame([((r[5] if len(r) > 5 else "A"), day(r[0]), day(r[0] + r[1]), float(r[2]), r[3], r[4]) for r in rows], CHAIN)


def prices(spark, rows, ticker="A"):
    """rows: (day, open, close)"""
    return spark.createDataFrame([(ticker, day(n), o, o, o, c, c, 1, 0.0, 0.0) for n, o, c in rows], OHLC)


def by_day(df):
    return {(x.trade_date - D0).days: x for x in df.collect()}


def test_columns():
    assert len(FEATURE_COLUMNS) == 98 == len(set(FEATURE_COLUMNS))
    kinds = [f.dataType.typeName() for f in FEATURES.fields]
    assert (kinds.count("string"), kinds.count("date"), kinds.count("long"), kinds.count("double")) == (1, 1, 14, 82)


def test_one_day(spark):
    rows = [(1, 5, 90, "C", 10), (1, 5, 95, "P", 20), (1, 40, 105, "C", 30), (1, 100, 110, "P", 40), (1, -3, 100, "C", 5), (1, 400, 100, "P", 7)]
    x = by_day(daily_features(chain(spark, rows), prices(spark, [(0, 99.0, 100.0), (1, 120.0, 121.0)])))[1]
    assert (x.spot_pc, x.spot_co, x.total_oi, x.call_oi, x.put_oi) == (100.0, 120.0, 112, 45, 67)
    assert (x.oi_within_5pct_pc, x.oi_within_10pct_pc, x.oi_above_spot_pc, x.oi_below_spot_pc) == (12, 72, 70, 30)
    assert (x.oi_within_5pct_co, x.oi_above_spot_co, x.oi_above_below_ratio_co) == (0, 0, 0.0)
    assert (x.max_oi_strike_call, x.max_oi_strike_put) == (105.0, 110.0)
    assert x.pct_oi_in_front_expiry == 30 / 112 and x.pct_oi_0_30d == 30 / 112 and x.pct_oi_91_365d == 40 / 112
    assert x.weighted_avg_dte == (50 + 100 + 1200 + 4000 - 15 + 2800) / 112
    assert x.oi_weighted_call_0_30d == 90.0 and x.oi_weighted_put_31_90d is None
    assert x.top5_strikes_pct_total_oi == 1.0 and x.d1_total_oi_change is None


def test_unknown_spots(spark):
    rows = [(0, 5, 100, "C", 10), (1, 5, 100, "C", 10), (2, 5, 100, "P", 10)]
    got = by_day(daily_features(chain(spark, rows), prices(spark, [(0, 100.0, -1.0), (1, 0.0, None)])))
    assert got[0].spot_pc is None and got[0].oi_within_5pct_pc is None and got[0].oi_above_spot_co == 0
    assert got[1].spot_pc == -1.0 and got[1].oi_within_5pct_pc is None and got[1].oi_weighted_all_div_spot_pc == -100.0
    assert got[1].spot_co == 0.0 and got[1].oi_weighted_all_div_spot_co is None and got[1].put_call_oi_ratio == 0.0
    assert got[2].spot_pc is None and got[2].spot_co is None and got[2].put_call_oi_ratio is None


def test_ties_tops_and_dead_expiries(spark):
    rows = [(0, -1, k, "C", 10) for k in (90, 80, 100, 110, 120, 130)] + [(0, -1, 200, "C", 1)]
    x = by_day(daily_features(chain(spark, rows), prices(spark, [(0, 1.0, 1.0)])))[0]
    assert x.max_oi_strike_call == 80.0 and x.max_oi_strike_put is None
    assert x.top5_strikes_pct_total_oi == 50 / 61 and x.top10_strikes_pct_total_oi == 1.0
    assert x.pct_oi_in_front_expiry is None and x.pct_oi_next_monthly is None


def test_zscore_gate(spark):
    oi = [100 + (n * 37) % 23 + n for n in range(130)]
    rows = [(n, 10, 100, "C", oi[n]) for n in range(130)] + [(n, 10, 90, "P", 1 + n % 5) for n in range(130) if n != 30]
    rows = [r for r in rows if not (r[0] == 30 and r[3] == "C")] + [(30, 10, 90, "P", 3)]
    got = by_day(day_features.oi_features(chain(spark, rows), prices(spark, [(0, 1.0, 1.0)])))
    assert got[59].zscore_d1_oi_change_3m is None and got[60].zscore_d1_oi_change_3m is not None
    assert got[63].zscore_d5_oi_change_3m is None and got[64].zscore_d5_oi_change_3m is not None
    # the ratio is null on day 30 (no calls), so it first has 60 values on day 90
    assert got[89].zscore_put_call_oi_ratio_3m is None and got[90].zscore_put_call_oi_ratio_3m is not None
    totals = {n: x.total_oi for n, x in got.items()}
    d1 = [totals[n] - totals[n - 1] for n in range(41, 101)]
    assert math.isclose(got[100].zscore_d1_oi_change_3m, (d1[-1] - statistics.mean(d1)) / statistics.stdev(d1), rel_tol=1e-9)


def test_price_features(spark):
    closes = [100.0, 110.0, 99.0, 101.0, 103.0, 102.0, 104.0]
    got = by_day(ohlc_features.ohlc_features(prices(spark, [(n * 3, 100.0, c) for n, c in enumerate(closes)])))
    logs = [math.log(b / a) for a, b in zip(closes, closes[1:])]
    assert got[0].rv_5d is None and got[3].rv_5d is None
    assert math.isclose(got[6].rv_5d, statistics.stdev(logs[:2]) * math.sqrt(252), rel_tol=1e-9)
    assert got[0].ret_1d_fwd_oc == 0.0 and got[0].ret_3d_fwd_oc == 99.0 / 100 - 1 and got[12].ret_5d_fwd_oc is None


def test_range_equals_slice_of_full(spark):
    rows = [(n, 10 + n % 50, 80 + 5 * (n % 9), "CP"[n % 2 if n % 7 else 0], 50 + (n * 31) % 17, t) for n in range(260) for t in ("A", "B")]
    rows += [(n, 20, 100, "P", 9 + n % 4, t) for n in range(260) for t in ("A", "B")]
    series = prices(spark, [(n, 95.0 + n % 11, 96.0 + n % 7) for n in range(260)]).unionByName(prices(spark, [(n, 90.0 + n % 3, 91.0) for n in range(260)], "B"))
    table = chain(spark, rows).repartition(3)
    start, end = day(230), day(259)
    full = {(x.ticker, x.trade_date): x for x in daily_features(table, series).collect()}
    part = {(x.ticker, x.trade_date): x for x in daily_features(table, series, start, end).collect()}
    assert set(part) == {k for k in full if k[1] >= start} and len(full) == 520
    for k, x in part.items():
        for c in FEATURE_COLUMNS:
            a, b = x[c], full[k][c]
            assert a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (k, c)
    alone = {x.trade_date: x for x in daily_features(table.filter("ticker = 'B'"), series).collect()}
    assert all(alone[k[1]].total_oi == x.total_oi and alone[k[1]].spot_pc == x.spot_pc for k, x in full.items() if k[0] == "B")
    for x in full.values():
        assert x.call_oi + x.put_oi == x.total_oi
        assert x.oi_above_spot_pc is None or x.oi_above_spot_pc + x.oi_below_spot_pc <= x.total_oi


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exchanges(spark):
    """Eight exchanges in all, and one of the whole chain: from the joined rows to the day rows there is none."""
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    try:
        table = chain(spark, [(n, 10, 100, "C", 5) for n in range(5)])
        series = prices(spark, [(0, 1.0, 1.0)])
        plan = plan_of(daily_features(table, series))
        assert plan.count("Exchange hashpartitioning") <= 8
        rows = day_features.per_day(day_features.rank_strikes(day_features.strike_level(day_features.joined(table, day_features.day_dim(table, series)))))
        plan = plan_of(rows)
        assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(k)


def test_the_chain_is_dealt_by_day_however_small_its_files(spark):
    table, series = chain(spark, [(n, 10, 100, "C", 5) for n in range(5)]), prices(spark, [(0, 1.0, 1.0)])
    rows = day_features.joined(table, day_features.day_dim(table, series))
    rows.collect()
    plan = plan_of(rows)
    assert "SortMergeJoin [ticker" in plan and "BuildLeft" not in plan
