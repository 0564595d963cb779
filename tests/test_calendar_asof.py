from datetime import date, timedelta

from chainsurf.operators import asof, calendar


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def d(text):
    return date.fromisoformat(text)


def test_trading_days(spark):
    holidays = frame(spark, [(d("2024-01-01"),)], "date date")
    got = sorted(x.trade_date for x in calendar.trading_days(spark, "2023-12-29", "2024-01-08", holidays).collect())
    assert got == [d(x) for x in ("2023-12-29", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08")]
    assert calendar.trading_days(spark, "2024-01-05", "2024-01-02", holidays).count() == 0


def test_last_trading_day(spark):
    cal = frame(spark, [(d("2024-01-05"),), (d("2024-01-02"),)], "trade_date date")
    days = frame(spark, [(d("2024-01-07"),), (d("2024-01-05"),), (d("2024-01-15"),), (d("2024-01-16"),), (d("2023-12-01"),)], "trade_date date")
    got = {x.trade_date: x.last_trading_day for x in calendar.last_trading_day(days, cal).collect()}
    assert got == {d("2024-01-07"): d("2024-01-05"), d("2024-01-05"): d("2024-01-05"), d("2024-01-15"): d("2024-01-05"), d("2024-01-16"): d("2024-01-16"), d("2023-12-01"): d("2023-12-01")}


def test_next_monthly(spark):
    listed = frame(spark, [("A", d("2024-03-15")), ("A", d("2024-04-18")), ("A", d("2024-06-20")), ("B", d("2024-05-17"))], "ticker string, expiration date")
    days = [("A", "2024-03-01"), ("A", "2024-03-15"), ("A", "2024-03-16"), ("A", "2024-05-01"), ("B", "2024-05-01"), ("A", "2024-06-21"), ("A", "2024-12-31")]
    got = {(x.ticker, str(x.trade_date)): str(x.next_monthly) for x in calendar.next_monthly(frame(spark, [(t, d(x)) for t, x in days], "ticker string, trade_date date"), listed).collect()}
    assert got == {
        ("A", "2024-03-01"): "2024-03-15",  # listed Friday
        ("A", "2024-03-15"): "2024-03-15",  # the Friday itself
        ("A", "2024-03-16"): "2024-04-18",  # Thursday before
        ("A", "2024-05-01"): "2024-05-17",  # neither is listed: Friday anyway
        ("B", "2024-05-01"): "2024-05-17",
        ("A", "2024-06-21"): "2024-06-20",  # unlisted Friday with a listed Thursday: a day back
        ("A", "2024-12-31"): "2025-01-17",
    }


def test_refresh_window():
    got = calendar.refresh_window(d("2024-05-01"))
    assert got["chain"] == (d("2024-04-21"), d("2024-05-01"))
    assert got["buffer"][0] == d("2024-05-01") - timedelta(days=175)


def test_as_of(spark):
    ohlc = frame(spark, [("A", d("2024-01-02"), 10.0), ("A", d("2024-01-03"), None), ("A", d("2024-01-05"), 12.0), ("A", d("2024-01-05"), 11.0), ("B", d("2024-01-01"), 5.0)], "ticker string, trade_date date, close double")
    days = frame(spark, [(t, d(x)) for t, x in [("A", "2024-01-02"), ("A", "2024-01-03"), ("A", "2024-01-04"), ("A", "2024-01-05"), ("A", "2024-01-09"), ("B", "2024-02-01"), ("C", "2024-01-05")]], "ticker string, trade_date date")
    got = {(x.ticker, str(x.trade_date)): x.spot_pc for x in asof.as_of_prior(days, ohlc, "close", "spot_pc").collect()}
    assert got == {("A", "2024-01-02"): None, ("A", "2024-01-03"): 10.0, ("A", "2024-01-04"): None, ("A", "2024-01-05"): None, ("A", "2024-01-09"): 12.0, ("B", "2024-02-01"): 5.0, ("C", "2024-01-05"): None}


def test_ticker_gate(spark):
    chain = frame(spark, [("A", 1), ("B", 2)], "ticker string, x int")
    assert [x.x for x in asof.ticker_gate(chain, frame(spark, [("B",), ("C",)], "ticker string")).collect()] == [2]
