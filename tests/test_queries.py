"""Every query against its SQL twin on the smallest tables, and the entry module."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from chainsurf import queries
from chainsurf.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return v.isoformat()[:10] if hasattr(v, "isoformat") else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert len(__spark_entry__.entry(spark).columns) == 98


def test_no_task_lands_a_whole_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "new_root", lambda spark, what: f"file://{tmp_path}/{what}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = QUERIES["upsert_chain_in_order"](spark, DATA).count()
        sizes = [r["count"] for r in spark.read.parquet(f"file://{tmp_path}/landed/0").groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and len(sizes) > 1 and max(sizes) < n / 2


def test_a_refresh_takes_its_calendar_from_a_table_of_days(spark, monkeypatch):
    calendars = []
    monkeypatch.setattr(queries.jobs, "daily_refresh", lambda *a, **k: calendars.append(a[6]))
    tables = queries.adapter.chain(spark, DATA), queries.adapter.ohlc(spark, DATA)
    queries._refreshed(*tables)
    assert len(calendars) == 2 and calendars[0].count() == tables[0].select("trade_date").distinct().count()
    assert all(files and all("/calendar/" in f for f in files) for files in (c.inputFiles() for c in calendars))
