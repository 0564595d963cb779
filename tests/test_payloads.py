import json
from datetime import date

from chainsurf.schemas import OI_FIELD
from chainsurf.sources import payloads

DAY = date(2024, 3, 1)
HEADER = {
    "header": {"format": ["expiration", "strike", "right", OI_FIELD]},
    "response": [["2024-03-15", 100.0, "C", 7], [], ["2024-02-30", 100.0, "C", 7], ["2024-03-15", "n/a", "C", 7], ["2024-03-15", 100.0, "X", 7], ["2024-03-15", 100.0, "C", 0], ["2024-03-15", 100.0, "C", 5], ["2024-03-15", 105.0, "put", None], ["2024-03-15", 105.0, "put"]],
}
COLUMNAR = {"expiration": ["20240315", "20240419", "abc"], "strike": [100.0, 105.0, 1.0], "right": ["call", "put", "C"], OI_FIELD: [7, 9], "date": "20240229"}
RECORDS = [{"expiration": 20240315, "strike": "100.0", "right": " Put ", OI_FIELD: 7}, 3, "x", None, [1], {"expiration": 20240315, "strike": 90, "right": "c", OI_FIELD: -4}]


def landed(spark, *items):
    rows = [("spy", DAY, x if isinstance(x, str) or x is None else json.dumps(x)) for x in items]
    return spark.createDataFrame(rows, "ticker string, requested_date date, payload string")


def keys(df):
    return sorted((x.ticker, x.trade_date, x.expiration, x.strike, x.option_type, x.oi) for x in df.collect())


def test_three_shapes(spark):
    f, a = date(2024, 3, 15), date(2024, 4, 19)
    assert keys(payloads.ingest_history(landed(spark, HEADER))) == [("SPY", DAY, f, 100.0, "C", 12)]
    assert keys(payloads.ingest_history(landed(spark, COLUMNAR))) == [("SPY", DAY, f, 100.0, "C", 7), ("SPY", DAY, a, 105.0, "P", 9)]
    assert keys(payloads.ingest_history(landed(spark, RECORDS))) == [("SPY", DAY, f, 90.0, "C", -4), ("SPY", DAY, f, 100.0, "P", 7)]


def test_repeated_and_missing_names(spark):
    """A name may stand twice (the last place within the row counts), be null or unknown; the payload and its neighbours stay."""
    twice = {"header": {"format": ["strike", "right", None, "strike", "expiration", OI_FIELD, "x"]}, "response": [[1.0, "C", 9, 100.0, "2024-03-15", 7, 0], [50.0, "P", 9], ["2", "C", None, 105.0, 20240419, 3]]}
    got = payloads.normalise_payload(landed(spark, twice, HEADER)).filter("strike IS NOT NULL").select("expiration", "strike", "right", "oi").collect()
    assert [tuple(x) for x in got[:3]] == [("2024-03-15", "100.0", "C", "7"), (None, "50.0", "P", None), ("20240419", "105.0", "C", "3")]
    f, a = date(2024, 3, 15), date(2024, 4, 19)
    assert keys(payloads.ingest_history(landed(spark, twice, HEADER))) == [("SPY", DAY, f, 100.0, "C", 19), ("SPY", DAY, a, 105.0, "C", 3)]


def test_nothing_comes_of_other_payloads(spark):
    junk = [None, "", "{}", "[]", "null", "3", '"text"', "{broken", {"a": 1}, {"header": {}, "response": []}, {"header": {"format": ["strike"]}, "response": None}, [1, 2]]
    assert payloads.ingest_history(landed(spark, *junk)).count() == 0


def test_dates(spark):
    rows = payloads.stamp_trade_date(payloads.columnar(landed(spark, COLUMNAR)), "requested_date").collect()
    assert {x.trade_date for x in rows} == {DAY} and {x.payload_date for x in rows} == {date(2024, 2, 29)}


def test_snapshot_takes_the_last_trading_day(spark):
    taken = landed(spark, HEADER).withColumnRenamed("requested_date", "taken_on")
    calendar = spark.createDataFrame([(date(2024, 2, 27),), (date(2024, 3, 4),)], "trade_date date")
    assert keys(payloads.ingest_snapshot(taken, calendar))[0][1] == date(2024, 2, 27)


def test_dup_report(spark):
    rows = payloads.clean_chain(payloads.header_rows(landed(spark, HEADER)))
    report = payloads.dup_report(payloads.stamp_trade_date(rows, "requested_date")).first()
    assert (report.n_raw, report.n_distinct, report.n_dropped) == (2, 1, 1)


def test_ohlc(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([("spy", "2024-03-01 00:00:00", 1.0, nan, inf, 2.0, 2.0, nan, 0.0, 0.0), ("spy", "2024-03-02 00:00:00", 1.0, 1.0, 1.0, 1.0, 1.0, 7.0, 0.0, 0.0)], "ticker string, trade_date string, open double, high double, low double, close double, adj_close double, volume double, dividends double, splits double")
    got = sorted(payloads.normalise_ohlc(rows).collect())
    assert tuple(got[0]) == ("SPY", date(2024, 3, 1), 1.0, None, None, 2.0, 2.0, None, 0.0, 0.0) and got[1].volume == 7
