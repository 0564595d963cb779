import itertools
import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from chainsurf.operators import merge
from chainsurf.plans import carry, jobs
from chainsurf.plans.features import daily_features
from chainsurf.schemas import CHAIN, FEATURES, OHLC, OI, OI_FIELD
from chainsurf.sources import store, versions
from chainsurf.streaming import ARRIVALS, merge_arrivals, ranked_rows, read_landing

KV = StructType([StructField("k", StringType()), StructField("v", LongType()), StructField("p", StringType())])


def kv(spark, *rows):
    return spark.createDataFrame(list(rows), KV)


def held(spark, root, at=None, schema=KV):
    return sorted(tuple(x) for x in versions.read(spark, root, schema, ["p"], at=at).collect())


def d(text):
    return date.fromisoformat(text)


def contracts(spark, rows):
    return spark.createDataFrame([(t, d(day), d(e), float(k), o, oi) for t, day, e, k, o, oi in rows], CHAIN)


def test_commit_replaces_partitions_only(spark, tmp_path):
    root = str(tmp_path / "t")
    assert not versions.is_versioned(spark, root) and held(spark, root) == []
    first = versions.commit(kv(spark, ("a", 1, "x"), ("b", 2, "y y/é"), ("c", 3, None)), root, ["p"], ["k"])
    second = versions.commit(kv(spark, ("d", 4, "y y/é")), root, ["p"], ["k"])
    assert set(second.live) == {("x",), ("y y/é",), (None,)}
    assert second.live[("x",)] == first.live[("x",)] and second.live[("y y/é",)] != first.live[("y y/é",)]
    assert held(spark, root, schema=KV)[:2] == [("a", 1, "x"), ("c", 3, None)] or len(held(spark, root)) == 3
    assert [x[0] for x in held(spark, root, first)] == ["a", "b", "c"]  # the version before stays readable
    third = versions.commit(kv(spark), root, ["p"], ["k"], gone=[("x",), (None,)])
    assert [x[0] for x in held(spark, root)] == ["d"] and third.number == 3
    versions.vacuum(spark, root, keep=1)
    assert [x[0] for x in held(spark, root)] == ["d"] and len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("c=")]) == 1


def test_a_commit_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    versions.commit(kv(spark, ("a", 1, "x"), ("b", 2, "y")), root, ["p"], ["k"])
    before = held(spark, root)

    def dies(*_):
        raise KeyboardInterrupt  # as a killed driver: nothing is cleaned up behind it

    for step in ("_folders", "_log"):
        with monkeypatch.context() as m:
            m.setattr(versions, step, dies)
            with pytest.raises(KeyboardInterrupt):
                versions.commit(kv(spark, ("a", 9, "x")), root, ["p"], ["k"])
        assert held(spark, root) == before
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("c=")]) == 3
    versions.commit(kv(spark, ("a", 9, "x")), root, ["p"], ["k"])
    assert held(spark, root) == [("a", 9, "x"), ("b", 2, "y")]
    versions.vacuum(spark, root)  # and what the dead runs have left goes
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("c=")]) == 2


def test_the_second_of_two_commits_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    base = versions.commit(kv(spark, ("a", 1, "x")), root, ["p"], ["k"])
    versions.commit(kv(spark, ("b", 2, "x")), root, ["p"], ["k"], onto=base)
    with pytest.raises(versions.Conflict):
        versions.commit(kv(spark, ("c", 3, "x")), root, ["p"], ["k"], onto=base)
    assert held(spark, root) == [("b", 2, "x")]
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("c=")]) == 2


def test_columns_come_and_go(spark, tmp_path):
    root, w = str(tmp_path / "t"), StructField("w", StringType())
    wide = StructType([*KV.fields, w])
    versions.commit(kv(spark, ("a", 1, "x")), root, ["p"], ["k"])
    versions.evolve(spark, root, add=[w], drop=["v"])
    assert held(spark, root, schema=wide) == [("a", None, "x", None)]
    with pytest.raises(ValueError):
        versions.commit(kv(spark, ("b", 2, "y")), root, ["p"], ["k"])
    versions.commit(spark.createDataFrame([("b", "w2", "y")], "k string, w string, p string"), root, ["p"], ["k"])
    versions.evolve(spark, root, add=[StructField("v", LongType()), w])  # w is there already
    versions.commit(spark.createDataFrame([("c", 3, "w3", "z")], "k string, v long, w string, p string"), root, ["p"], ["k"])
    assert held(spark, root, schema=wide) == [("a", None, "x", None), ("b", None, "y", "w2"), ("c", 3, "z", "w3")]
    versions.evolve(spark, root, drop=["w"])
    assert [x[3] for x in held(spark, root, schema=wide)] == [None] * 3
    with pytest.raises(ValueError):
        versions.evolve(spark, root, drop=["no such"])


def test_a_plain_store_is_adopted(spark, tmp_path):
    root = str(tmp_path / "chain")
    old = [("A", "2023-12-29", "2024-01-19", 1, "C", 1), ("A", "2024-01-02", "2024-02-16", 1, "C", 1), ("0 7", "2024-01-02", "2024-03-15", 1, "C", 1)]
    contracts(spark, old).withColumn("year", F.year("trade_date")).write.partitionBy("ticker", "year").parquet(root)
    later = contracts(spark, [("A", "2024-01-02", "2024-02-16", 1, "C", 9), ("B", "2024-01-02", "2024-01-19", 1, "C", 2)])
    with pytest.raises(ValueError, match="adopt"):
        merge.upsert_chain(later, root)
    assert store.read_chain(spark, root).count() == 3
    versions.adopt(spark, root, merge.STORED_CHAIN, store.BY_TICKER_YEAR)
    merge.upsert_chain(later, root)
    assert sorted((x.ticker, x.year, x[OI]) for x in store.read_chain(spark, root).collect()) == [("0 7", 2024, 1), ("A", 2023, 1), ("A", 2024, 9), ("B", 2024, 2)]
    assert {(x.ticker, str(x.expiration)) for x in store.read_expirations(spark, root).collect()} == {("A", "2024-01-19"), ("A", "2024-02-16"), ("0 7", "2024-03-15"), ("B", "2024-01-19")}


# ---- order within a batch ------------------------------------------------------------------


def test_the_last_row_wins_through_the_store(spark, tmp_path):
    """Two partitions, the later far larger: read back, the larger file comes first."""
    one = lambda n: [("A", "2024-01-02", "2024-01-19", 100, "C", n)]
    fill = [("A", "2024-01-02", "2024-02-16", k, "C", 5) for k in range(5000)]
    for small_first in (True, False):
        parts = [one(1), fill + one(2)] if small_first else [fill + one(1), one(2)]
        batch = contracts(spark, parts[0]).coalesce(1).union(contracts(spark, parts[1]).coalesce(1))
        root = str(tmp_path / f"chain-{small_first}")
        merge.upsert_chain(batch, root)
        assert store.read_chain(spark, root).filter("expiration = '2024-01-19'").first()[OI] == 2


@pytest.mark.parametrize("sizes", [(3000, 300, 1), (1, 300, 3000), (300, 3000, 1)])
def test_files_are_read_in_the_order_of_their_names(spark, tmp_path, sizes):
    for i, n in enumerate(sizes):
        contracts(spark, [("A", "2024-01-02", "2024-01-19", k, "C", 10 * i + (k == 0)) for k in range(n)]).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    rows = merge.read_in_order(spark, *[str(tmp_path / f"in/{i}") for i in range(3)], schema=CHAIN)
    merge.upsert_chain(rows, str(tmp_path / "chain"))
    got = {x.strike: x[OI] for x in store.read_chain(spark, str(tmp_path / "chain")).collect()}
    want = {float(k): 10 * i + (k == 0) for i, n in enumerate(sizes) for k in range(n)}
    assert got == want


def counted(spark, df):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for x in frames:
            seen.add(len(x))
            yield x

    return df.mapInPandas(count, df.schema), seen


def prices(spark, rows):
    return spark.createDataFrame([(t, d(day), o, o, o, c, c, 1, 0.0, 0.0) for t, day, o, c in rows], OHLC)


def test_every_sink_evaluates_its_batch_once(spark, tmp_path):
    rows = [("A", "2023-12-29", 1.0, 2.0), ("A", "2024-01-02", 1.0, 2.0), ("B", "2024-01-02", 1.0, 2.0)]
    for again in range(2):
        batch, seen = counted(spark, prices(spark, rows))
        merge.upsert_ohlc(batch, str(tmp_path / "ohlc"))
        assert seen.value == 3 and store.read_ohlc(spark, str(tmp_path / "ohlc")).count() == 3
    slice_ = prices(spark, rows).select("ticker", "trade_date", F.lit(1).cast("bigint").alias("total_oi"))
    for range_ in ((), ("2024-01-01", "2024-01-31")):
        batch, seen = counted(spark, slice_ if not range_ else slice_.filter("trade_date >= '2024-01-01'"))
        merge.replace_features(batch, str(tmp_path / "features"), *range_)
        assert seen.value == (2 if range_ else 3)
    assert store.read_features(spark, str(tmp_path / "features")).count() == 3
    assert not any((tmp_path / t / "_staged").iterdir().__next__().exists() for t in ("ohlc", "features") if list((tmp_path / t / "_staged").iterdir()))


def test_a_failing_batch_leaves_no_files(spark, tmp_path):
    root = str(tmp_path / "chain")
    merge.upsert_chain(contracts(spark, [("A", "2024-01-02", "2024-01-19", 100, "C", 1)]), root)
    with pytest.raises(Exception, match="null"):
        merge.upsert_chain(contracts(spark, [("A", "2024-01-02", "2024-01-19", 100, "C", None)]), root)
    assert store.read_chain(spark, root).count() == 1 and not list((tmp_path / "chain" / "_staged").iterdir())


# ---- ranges cost what they touch -----------------------------------------------------------


def ten_years(spark, root, last=date(2024, 6, 28)):
    """A store of ten years, three contracts a week, and its features."""
    days = [last - timedelta(days=7 * i) for i in range(520)]
    rows = [(t, str(x), str(x + timedelta(days=20 + 7 * j)), 100 + j, "CP"[j % 2], 5 + j) for x in days for t in ("A", "B") for j in range(3)]
    merge.upsert_chain(contracts(spark, rows), f"{root}/chain")
    merge.upsert_ohlc(prices(spark, [(t, str(x), 100.0, 101.0) for x in days for t in ("A", "B")]), f"{root}/ohlc")
    jobs.rebuild(spark, root)
    return days


def years_of(files):
    return {int(f.split("year=")[1].split("/")[0]) for f in files if "year=" in f}


def test_a_refresh_reads_its_buffer_and_writes_its_years(spark, tmp_path, monkeypatch):
    root, last = str(tmp_path), date(2024, 6, 28)
    ten_years(spark, root)
    before = versions.version(spark, f"{root}/features")
    assert {k[1] for k in before.live} == {str(y) for y in range(2014, 2025)}
    start, end = last - timedelta(days=45), last
    opened = jobs.range_features(spark, root, start, end).inputFiles()
    assert years_of(f for f in opened if "/chain/c=" in f) == years_of(f for f in opened if "/ohlc/" in f) == {2024}
    assert {f.split("/chain/")[1].partition("=")[0] for f in opened if "/chain/" in f} == {"c", "x"}
    jobs.rebuild(spark, root, start, end)
    after = versions.version(spark, f"{root}/features")
    assert {k for k in after.live if after.live[k] != before.live[k]} == {("A", "2024"), ("B", "2024")}
    assert sorted(after.wrote.values()) == [2, 22] and store.read_features(spark, f"{root}/features").count() == 1040
    paths = []
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, f=type(spark.read).parquet: (paths.append(p), f(self, *p))[1])
    assert versions.read(spark, f"{root}/chain", store.PARTITIONED, store.BY_TICKER_YEAR).count() == 3120 and len(paths[0]) == 1  # one commit, wanted whole
    late = date(2024, 1, 20)  # across a year's end: two years
    opened = jobs.range_features(spark, root, late - timedelta(days=45), late).inputFiles()
    assert years_of(f for f in opened if "/chain/c=" in f) == {2023, 2024}
    assert {f for f in carry.added_days(spark, root, last, last).inputFiles() if "/chain/c=" in f} == {f for f in store.read_chain(spark, f"{root}/chain", last, last).inputFiles()}


def test_kept_expirations_follow_the_chain(spark, tmp_path):
    root, e = str(tmp_path / "chain"), lambda: {(x.ticker, str(x.expiration)) for x in store.read_expirations(spark, str(tmp_path / "chain")).collect()}
    merge.upsert_chain(contracts(spark, [("A", "2023-12-29", "2024-01-19", 1, "C", 1), ("A", "2024-01-02", "2024-02-16", 1, "C", 1), ("007", "2024-01-02", "2024-01-19", 1, "C", 1)]), root)
    assert e() == {("A", "2024-01-19"), ("A", "2024-02-16"), ("007", "2024-01-19")}
    merge.upsert_chain(contracts(spark, [("A", "2024-01-03", "2024-03-15", 1, "C", 1)]), root)
    assert e() == {("A", "2024-01-19"), ("A", "2024-02-16"), ("A", "2024-03-15"), ("007", "2024-01-19")}
    now = versions.version(spark, root)
    kept = store.read_chain(spark, root).filter("ticker = 'A' AND year = 2024 AND expiration = '2024-03-15'")
    versions.commit(kept, root, store.BY_TICKER_YEAR, ["trade_date"], gone=[("A", "2024")], onto=now, beside=merge.listed_by_year)
    assert e() == {("A", "2024-01-19"), ("A", "2024-03-15"), ("007", "2024-01-19")}


# ---- carried state ---------------------------------------------------------------------------


def test_added_days_equal_a_full_rebuild(spark, tmp_path):
    r, root, first = random.Random(2), str(tmp_path), date(2023, 1, 2)
    days = [x for x in (first + timedelta(days=i) for i in range(200)) if x.weekday() < 5]
    chain = contracts(spark, [("A", str(x), str(x + timedelta(days=r.choice((3, 18, 40, 120)))), 90 + 5 * k, "CP"[k % 2], r.randrange(1, 50)) for x in days for k in range(4)]).dropDuplicates(["trade_date", "expiration", "strike"])
    chain = spark.createDataFrame(chain.collect(), CHAIN)
    ohlc = prices(spark, [("A", str(x), 95 + r.random() * 10, 95 + r.random() * 10) for x in days])
    until, last = days[-4], days[-1]
    upto = lambda df, a, b: store.filter_range(df, a, b)
    merge.upsert_chain(upto(chain, None, until), f"{root}/chain")
    merge.upsert_ohlc(upto(ohlc, None, until), f"{root}/ohlc")
    jobs.rebuild(spark, root)
    for x in days[-3:]:  # a day at a time
        merge.upsert_chain(upto(chain, x, x), f"{root}/chain")
        merge.upsert_ohlc(upto(ohlc, x, x), f"{root}/ohlc")
        carry.add_days(spark, root, x, x)
    got = {x.trade_date: x for x in store.read_features(spark, f"{root}/features").collect()}
    want = {x.trade_date: x for x in daily_features(chain, ohlc).collect()}
    assert set(got) == set(want)
    since = last - timedelta(days=45)
    for day, w in want.items():
        for c in FEATURES.names:
            if day < since and c.startswith("ret_"):
                continue  # returns older than the look-back are those of their own time
            assert got[day][c] == pytest.approx(w[c], rel=1e-9, abs=1e-9) if isinstance(w[c], float) else got[day][c] == w[c], (day, c)
    assert got[last].zscore_d5_oi_change_3m is not None


# ---- ranks -------------------------------------------------------------------------------------


def test_ranked_batches_in_any_order(spark, tmp_path):
    row = ("A", d("2024-01-02"), d("2024-01-19"), 100.0, "C")
    batches = [[(*row, 5, 10)], [(*row, 7, 11), (*row[:3], 105.0, "C", 1, 3)], [(*row, 6, 11)]]
    schema = StructType([*CHAIN.fields, StructField("rank", LongType())])
    for i, order in enumerate([*itertools.permutations(range(3))][::2] + [(2, 1, 0, 1, 2)]):
        root = str(tmp_path / f"chain-{i}")
        merge.upsert_chain(contracts(spark, [("A", "2024-01-02", "2024-01-19", 100, "C", 99)]), root)  # without a rank, below all
        for b in order:
            merge.upsert_ranked(spark.createDataFrame(batches[b], schema), root)
        assert sorted((x.strike, x[OI]) for x in store.read_chain(spark, root).collect()) == [(100.0, 7), (105.0, 1)]


def test_arrivals(spark, tmp_path):
    body = lambda *oi: json.dumps([{"expiration": "2024-02-16", "strike": 100, "right": "C", OI_FIELD: n} for n in oi])
    monday, tuesday = d("2024-01-08"), d("2024-01-09")
    rows = [
        ("a", monday, "snapshot", monday, body(20)),
        ("a", monday, "history", tuesday, body(21, 1)),  # the next day's history wins over the snapshot; its rows are summed
        ("a", monday, "history", tuesday, body(21, 1)),  # landed twice
        ("a", tuesday, "history", tuesday, body(30)),
        ("a", tuesday, "snapshot", tuesday, body(31)),  # a run's snapshot wins over its history
        ("a", d("2024-01-13"), "snapshot", d("2024-01-13"), body(40)),  # a Saturday's, for the last trading day
        ("a", None, "history", tuesday, None),
    ]
    calendar = spark.createDataFrame([(d(f"2024-01-{n:02}"),) for n in (8, 9, 10, 11, 12)], "trade_date date")
    want = {"2024-01-08": 22, "2024-01-09": 31, "2024-01-12": 40}
    assert ranked_rows(spark.createDataFrame(rows, ARRIVALS), calendar).count() == 5
    landing = str(tmp_path / "landing")
    for row in reversed(rows):
        spark.createDataFrame([row], ARRIVALS).coalesce(1).write.mode("append").json(landing)
    for again in range(2):
        merge_arrivals(read_landing(spark, landing, 3, ARRIVALS), str(tmp_path / "chain"), calendar, str(tmp_path / f"cp{again}")).awaitTermination()
        assert {str(x.trade_date): x[OI] for x in store.read_chain(spark, str(tmp_path / "chain")).collect()} == want


# ---- other sources -----------------------------------------------------------------------------


def test_relational_source(spark, tmp_path):
    """An embedded database of the JVM: every row once, each range a task, filters at the source."""
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    link = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = link.createStatement()
    run.execute("CREATE TABLE raw (ticker VARCHAR(9), trade_date DATE, expiration DATE, strike DOUBLE, option_type CHAR(1), oi BIGINT)")
    days = [date(2022, 11, 1) + timedelta(days=31 * i) for i in range(20)]
    for i, x in enumerate(days):
        run.execute(f"INSERT INTO raw VALUES ('A', DATE('{x}'), DATE('{x + timedelta(days=9)}'), 100, 'C', {i})")
    run.execute("INSERT INTO raw VALUES ('A', NULL, DATE('2024-01-19'), 100, 'C', 99)")
    rows = store.read_jdbc(spark, url, "raw", parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert rows.rdd.getNumPartitions() == 4
    assert sorted(x.OI for x in rows.collect()) == [*range(20), 99]
    some = rows.filter(F.col("TRADE_DATE") >= F.lit(days[15])).select("OI")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual" in plan.replace("*", "") or ">=" in plan
    assert sorted(x.OI for x in some.collect()) == [15, 16, 17, 18, 19]
    bounds = [(date(y, 1, 1), date(y + 1, 1, 1)) for y in (2022, 2023, 2024)]
    years = store.read_jdbc(spark, url, "raw", year_bounds=bounds, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert years.rdd.getNumPartitions() == 3 and years.count() == 21
    counts = merge.export_by_year(years.toDF("ticker", "trade_date", "expiration", "strike", "option_type", OI).filter("trade_date IS NOT NULL"), str(tmp_path / "chain"))
    assert {(x.year, x.n) for x in counts.collect()} == {(2022, 2), (2023, 12), (2024, 6)}
    run.execute("CREATE TABLE nothing (trade_date DATE)")
    assert store.read_jdbc(spark, url, "nothing", parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver").count() == 0
    link.close()


def test_date_ranges_hold_each_day_once():
    for n, parts in itertools.product((1, 2, 10, 400), (1, 3, 7)):
        first = date(2024, 2, 27)
        ranges = store.date_ranges(first, first + timedelta(days=n - 1), parts)
        assert all(sum(a <= x < b for a, b in ranges) == 1 for x in (first + timedelta(days=i) for i in range(n)))
        assert len(ranges) == min(n, parts)


def test_older_layout_opens_only_what_is_asked_for(spark, tmp_path):
    for t, y in itertools.product(("spy", "q q", "x+%"), (2022, 2023, "notes")):
        (tmp_path / t).mkdir(exist_ok=True)
        contracts(spark, [(t, "2023-01-02", "2023-02-17", 100, "C", 6)]).drop("ticker").toPandas().to_parquet(tmp_path / t / f"{y}.parquet")
    root = str(tmp_path)
    one = store.read_chain_files(spark, root, tickers=["SPY"], years=[2023])
    assert len(one.inputFiles()) == 1 and [(x.ticker, x.year) for x in one.collect()] == [("SPY", 2023)]
    assert sorted({x.ticker for x in store.read_chain_files(spark, root).collect()}) == ["Q Q", "SPY", "X+%"]
    assert store.read_chain_files(spark, root, years=[1999]).count() == 0
    assert {x[1] for x in store.older_files(spark, root)} == {2022, 2023}
