from datetime import date

import pytest
from pyspark.sql import functions as F

from chainsurf import functions as fn


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_bands_keep_the_floating_edges(spark):
    rows = spark.createDataFrame([(90.0,), (95.0,), (105.0,), (110.0,), (100.0,)], "k double")
    m = fn.moneyness(F.col("k"), F.lit(100.0))
    got = {x.k: tuple(x)[1:] for x in rows.select("k", fn.band(m, 0.05), fn.band(m, 0.10), fn.above(m), fn.below(m)).collect()}
    assert got == {90.0: (False, True, False, True), 95.0: (False, True, False, True), 105.0: (False, True, True, False), 110.0: (False, False, True, False), 100.0: (True, True, False, False)}


@pytest.mark.parametrize("spot", [None, 0.0, -5.0])
def test_moneyness_needs_a_positive_spot(spark, spot):
    assert one(spark, fn.moneyness(F.lit(100.0), F.lit(spot).cast("double"))) is None


def test_safe_div(spark):
    assert one(spark, fn.safe_div(F.lit(1), F.lit(0))) is None
    assert one(spark, fn.safe_div(F.lit(1), F.lit(4))) == 0.25


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-01-02", date(2024, 1, 2)), ("2024-01-02T00:00:00", date(2024, 1, 2)), ("20240102", date(2024, 1, 2)), ("2024-02-30", None), ("20240230", None), ("abc", None), ("", None), (None, None), ("2024-1-2", None), ("202401", None), ("2024010203", None)],
)
def test_parse_ymd(spark, text, want):
    assert one(spark, fn.parse_ymd(F.lit(text).cast("string"))) == want


def test_parse_ymd_of_numbers(spark):
    assert one(spark, fn.parse_ymd(F.lit(20240102))) == date(2024, 1, 2)


@pytest.mark.parametrize(("text", "want"), [(" Call ", "C"), ("p", "P"), ("PUT", "P"), ("X", None), ("", None), (None, None)])
def test_right(spark, text, want):
    assert one(spark, fn.normalise_right(F.lit(text).cast("string"))) == want


def test_finite(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1.5, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [x.v for x in rows.select(fn.finite_or_null(F.col("v")).alias("v")).collect()] == [None, None, None, 1.5, None]


def test_third_friday_of_all_months(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2000-01-01', DATE '2040-12-01', INTERVAL 1 MONTH)) AS d")
    for x in days.select("d", fn.third_friday(F.col("d")).alias("f")).collect():
        assert x.f.weekday() == 4 and 15 <= x.f.day <= 21 and (x.f.year, x.f.month) == (x.d.year, x.d.month)
