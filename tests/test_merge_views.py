import json
from datetime import date

import pytest
from pyspark.errors import PySparkException

from chainsurf.operators import merge, quality, views
from chainsurf.plans import jobs
from chainsurf.schemas import CHAIN, FEATURES, OHLC, OI_FIELD
from chainsurf.sources import store
from chainsurf.streaming import merge_landing, read_landing


def d(text):
    return date.fromisoformat(text)


def contracts(spark, rows):
    return spark.createDataFrame([(t, d(day), d(e), float(k), o, oi) for t, day, e, k, o, oi in rows], CHAIN)


A1 = ("A", "2023-12-29", "2024-01-19", 100, "C", 5)
A2 = ("A", "2024-01-02", "2024-01-19", 100, "C", 6)
B1 = ("B", "2024-01-02", "2024-01-19", 50, "P", 7)


def held(spark, root):
    return sorted(tuple(x) for x in store.read_chain(spark, root).collect())


def test_keep_last_follows_the_order_of_batches(spark):
    first, second, third = (contracts(spark, [(*A1[:5], n)]) for n in (1, 2, 3))
    assert merge.merge_keep_last(merge.in_order(first, third, second), merge.CONTRACT_KEY).first().oi == 2


def test_within_a_batch_the_last_row_wins(spark):
    rows = contracts(spark, [(*A1[:5], n) for n in (3, 1, 4, 1, 5)]).coalesce(1)
    assert merge.merge_keep_last(merge.in_order(contracts(spark, [A1]), rows), merge.CONTRACT_KEY).collect()[0][5] == 5


def test_a_batch_is_evaluated_once(spark, tmp_path):
    root, seen = str(tmp_path / "chain"), spark.sparkContext.accumulator(0)

    def count(rows):
        for x in rows:
            seen.add(len(x))
            yield x

    batch = contracts(spark, [A1, A2, B1])
    for _ in range(2):
        seen.value = 0
        assert merge.upsert_chain(batch.mapInPandas(count, batch.schema), root).count() == 3
        assert seen.value == 3
    assert not list((tmp_path / "chain" / "_staged").iterdir())


def test_upsert_chain(spark, tmp_path):
    root = str(tmp_path / "chain")
    counts = {(x.ticker, x.year): x.n for x in merge.upsert_chain(contracts(spark, [A1, A2, B1]), root).collect()}
    assert counts == {("A", 2023): 1, ("A", 2024): 1, ("B", 2024): 1}
    new = ("A", "2024-01-03", "2024-01-19", 100, "C", 8)
    counts = {(x.ticker, x.year): x.n for x in merge.upsert_chain(contracts(spark, [(*A2[:5], 60), new]), root).collect()}
    assert counts == {("A", 2024): 2}
    rows = {(x[0], str(x[1])): x[5] for x in held(spark, root)}
    assert rows == {("A", "2023-12-29"): 5, ("A", "2024-01-02"): 60, ("A", "2024-01-03"): 8, ("B", "2024-01-02"): 7}
    before = held(spark, root)
    merge.upsert_chain(contracts(spark, [(*A2[:5], 60), new]), root)
    assert held(spark, root) == before
    chain = store.read_chain(spark, root)
    assert [x.ticker for x in store.list_tickers(chain).orderBy("ticker").collect()] == ["A", "B"]
    assert [x.year for x in store.list_years(chain, "a").orderBy("year").collect()] == [2023, 2024]
    assert store.read_year(chain, "a", 2023).count() == 1 and store.read_year(chain, "Z", 1999).count() == 0
    found = store.read_range(chain, "A", "2024-01-01", "2024-01-02")
    assert found.count() == 1 and "PartitionFilters: [isnotnull" in found._jdf.queryExecution().toString()


def test_tickers_stay_text(spark, tmp_path):
    root = str(tmp_path / "chain")
    merge.upsert_chain(contracts(spark, [("007", *A1[1:])]), root)
    assert store.read_chain(spark, root).first().ticker == "007"


def test_older_layout(spark, tmp_path):
    rows = contracts(spark, [A2]).drop("ticker").toPandas()
    for name in ("spy/2024.parquet", "spy/notes.parquet"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        rows.to_parquet(tmp_path / name)
    got = store.read_chain_files(spark, str(tmp_path)).collect()
    assert [(x.ticker, x.year, x.oi) for x in got] == [("SPY", 2024, 6)]


def test_coerce(spark):
    loose = spark.createDataFrame([("A", "2024-01-02", "2024-01-19", "n/a", "C", 1)], "ticker string, trade_date string, expiration string, strike string, option_type string, oi int")
    row = merge.coerce_chain(loose).first()
    assert row.strike is None and row.trade_date == d("2024-01-02")
    with pytest.raises(PySparkException):
        merge.coerce_chain(contracts(spark, [(*A1[:5], None)])).collect()


def prices(spark, rows):
    return spark.createDataFrame([(t, d(day), o, o, o, c, c, 1, 0.0, 0.0) for t, day, o, c in rows], OHLC)


def test_upsert_ohlc(spark, tmp_path):
    root = str(tmp_path / "ohlc")
    merge.upsert_ohlc(prices(spark, [("A", "2024-01-02", 1.0, 2.0), ("B", "2024-01-02", 1.0, 2.0)]), root)
    merge.upsert_ohlc(prices(spark, [("A", "2024-01-02", 3.0, 4.0), ("A", "2024-01-03", 5.0, 6.0)]), root)
    got = sorted((x.ticker, str(x.trade_date), x.close) for x in store.read_ohlc(spark, root).collect())
    assert got == [("A", "2024-01-02", 4.0), ("A", "2024-01-03", 6.0), ("B", "2024-01-02", 2.0)]


def features(spark, rows):
    return quality.align_schema(spark.createDataFrame([(t, d(x), n) for t, x, n in rows], "ticker string, trade_date date, total_oi bigint"), FEATURES)


def test_replace_features(spark, tmp_path):
    root = str(tmp_path / "features")
    read = lambda: sorted((x.ticker, str(x.trade_date), x.total_oi) for x in store.read_features(spark, root).collect())
    merge.replace_features(features(spark, [("A", "2024-01-02", 1), ("A", "2024-01-03", 2), ("A", "2024-01-09", 3), ("B", "2024-01-03", 4)]), root)
    merge.replace_features(features(spark, [("A", "2024-01-04", 9)]), root, "2024-01-03", "2024-01-05")
    assert read() == [("A", "2024-01-02", 1), ("A", "2024-01-04", 9), ("A", "2024-01-09", 3), ("B", "2024-01-03", 4)]
    before = read()
    merge.replace_features(features(spark, []), root, "2024-01-01", "2024-01-31")
    assert read() == before  # an empty slice leaves old rows
    merge.replace_features(features(spark, [("B", "2024-01-04", 5)]), root)
    assert read() == [x for x in before if x[0] == "A"] + [("B", "2024-01-04", 5)]


def test_daily_refresh_and_late_correction(spark, tmp_path):
    root = str(tmp_path)
    schema = "ticker string, {} date, payload string"
    body = lambda oi: json.dumps([{"expiration": "2024-02-16", "strike": 100, "right": "C", OI_FIELD: oi}])
    calendar = spark.createDataFrame([(d(f"2024-01-{n:02}"),) for n in (2, 3, 4)], "trade_date date")
    ohlc = prices(spark, [("A", "2024-01-02", 99.0, 100.0), ("A", "2024-01-03", 101.0, 102.0)])
    history = spark.createDataFrame([("A", d("2024-01-02"), body(10))], schema.format("requested_date"))
    snapshot = spark.createDataFrame([("A", d("2024-01-03"), body(20))], schema.format("taken_on"))
    jobs.daily_refresh(spark, root, d("2024-01-03"), ohlc, history, snapshot, calendar)
    read = lambda: {str(x.trade_date): (x.total_oi, x.spot_pc) for x in store.read_features(spark, root + "/features").collect()}
    assert read() == {"2024-01-02": (10, None), "2024-01-03": (20, 100.0)}
    late = spark.createDataFrame([("A", d("2024-01-03"), body(21))], schema.format("requested_date"))
    newer = spark.createDataFrame([("A", d("2024-01-04"), body(30))], schema.format("taken_on"))
    jobs.daily_refresh(spark, root, d("2024-01-04"), ohlc, late, newer, calendar, keep=2)
    assert all(len([f for f in (tmp_path / t / "_log").iterdir() if f.name.isdigit()]) == 2 for t in ("chain", "ohlc", "features"))
    assert read() == {"2024-01-02": (10, None), "2024-01-03": (21, 100.0), "2024-01-04": (30, 102.0)}
    jobs.rebuild(spark, root)
    assert read() == {"2024-01-02": (10, None), "2024-01-03": (21, 100.0), "2024-01-04": (30, 102.0)}


def test_file_stream(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "chain")
    body = json.dumps([{"expiration": "2024-02-16", "strike": 100, "right": "C", OI_FIELD: 10}])
    rows = spark.createDataFrame([("A", d("2024-01-02"), body)], "ticker string, requested_date date, payload string")
    rows.write.json(str(landing))
    merge_landing(read_landing(spark, str(landing)), root, str(tmp_path / "cp")).awaitTermination()
    assert store.read_chain(spark, root).count() == 1


def test_export_and_reconcile(spark, tmp_path):
    rows = contracts(spark, [A1, A2, B1])
    merge.export_by_year(rows, str(tmp_path / "c"))
    got = quality.reconcile_counts(rows.unionByName(contracts(spark, [("C", *A1[1:])])), store.read_chain(spark, str(tmp_path / "c"))).collect()
    assert {(x.ticker, x.year): x.matches for x in got} == {("A", 2023): True, ("A", 2024): True, ("B", 2024): True, ("C", 2023): False}


def test_checks(spark):
    rows = contracts(spark, [A1, A1, (*B1[:4], "X", None)])
    assert quality.check_unique(rows, merge.CONTRACT_KEY).first().n == 2
    assert {x.column: x.n_null for x in quality.check_not_null(rows, ["ticker", "oi"]).collect()} == {"ticker": 0, "oi": 1}
    assert tuple(quality.check_domain(rows, "option_type", ["C", "P"]).first()) == ("X", 1)


def surface(spark, rows):
    return views.build_surface(contracts(spark, rows), prices(spark, [("A", "2024-01-02", 100.0, 100.0), ("A", "2024-01-03", 100.0, 0.0)]))


def test_views(spark):
    rows = [("A", "2024-01-02", "2024-01-05", k, "C", 5) for k in (80, 100, 104)] + [("A", "2024-01-02", "2024-01-05", 104, "P", 5), ("A", "2024-01-02", "2024-01-01", 100, "P", 50), ("A", "2024-01-03", "2024-01-05", 100, "C", 0), ("A", "2024-01-04", "2024-01-05", 100, "C", 9)]
    s = surface(spark, rows).cache()
    assert {x.moneyness for x in s.filter("trade_date = '2024-01-03'").collect()} == {None}
    top = [(x.strike, x.option_type, x.oi_rank) for x in views.top_nodes_latest(s.filter("trade_date = '2024-01-02' AND dte >= 0"), 2).orderBy("oi_rank").collect()]
    assert top == [(80.0, "C", 1), (100.0, "C", 2)]
    pins = [(str(x.trade_date), x.strike, x.option_type, x.rank_in_front) for x in views.pin_candidates(s).orderBy("rank_in_front").collect()]
    assert pins == [("2024-01-02", 100.0, "C", 1), ("2024-01-02", 104.0, "C", 2), ("2024-01-02", 104.0, "P", 3)]
    moves = {str(x.trade_date): (x.oi_prev, x.oi_change, x.oi_pct_change) for x in views.oi_changes_daily(s).filter("strike = 100 AND option_type = 'C'").collect()}
    assert moves == {"2024-01-02": (None, None, None), "2024-01-03": (5, -5, -1.0), "2024-01-04": (0, 9, None)}
    assert {x.n_strikes for x in views.oi_concentration(s).filter("trade_date = '2024-01-02' AND dte = 3").collect()} == {4}
    assert views.surface_latest(s).count() == 1
    names = views.register_views(s, features(spark, [("A", "2024-01-02", 1)]), prices(spark, [("A", "2024-01-02", 1.0, 2.0)]))
    assert len(names) == 6 and spark.table("v_features_with_returns").first().close_today == 2.0
    assert views.register_views(s, features(spark, []), prices(spark, [])) == names
