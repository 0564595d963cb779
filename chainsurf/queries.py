"""Every operator as a query over the adapter's tables, with its SQL twin."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

from . import adapter, streaming
from .adapter import CHAIN_SQL, CLEAN_SQL, OHLC_SQL
from .functions import days_to_expiry, finite_or_null, moneyness, parse_ymd, third_friday
from .operators import asof, calendar, day_features, merge, ohlc_features, quality, views
from .plans import carry, jobs
from .plans.features import daily_features
from .schemas import CHAIN, DAY_KEY, FEATURE_COLUMNS, FEATURES, OI, SPOTS
from .sources import payloads, store, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FROM, TO = "1998-03-01", "1998-06-30"


def query(sql: str, needs: str = "co"):
    """Register a function of (chain, ohlc) under its name, with SQL over the same two tables; interest is called oi in both."""

    def add(f):
        QUERIES[f.__name__.rstrip("_")] = lambda spark, d: f(adapter.chain(spark, d), adapter.ohlc(spark, d)).withColumnRenamed(OI, "oi")
        ORACLES[f.__name__.rstrip("_")] = f"WITH {CHAIN_SQL}, {OHLC_SQL}" + ("" if sql.lstrip().startswith(",") else "\n") + sql
        return f

    return add


def rounded(df: DataFrame, *prefixes: str) -> DataFrame:
    """Columns whose last digits depend on the order of summing, to six digits."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if c.startswith(prefixes) else F.col(c) for c in df.columns])


def new_root(spark: SparkSession, what: str) -> str:
    """A fresh path for a store, in the folder that the cluster shares; a local one only where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


# ---- sources -----------------------------------------------------------------------------


@query(f"SELECT * FROM chain WHERE trade_date BETWEEN DATE '{FROM}' AND DATE '{TO}'")
def chain_scan_range(chain, ohlc):
    return store.filter_range(chain, FROM, TO)


@query("SELECT DISTINCT ticker FROM chain")
def list_tickers(chain, ohlc):
    return store.list_tickers(chain)


@query("SELECT DISTINCT ticker, CAST(year(trade_date) AS INTEGER) AS year FROM chain")
def list_years(chain, ohlc):
    return store.list_years(chain)


@query("SELECT * FROM chain WHERE ticker = 'N' AND year(trade_date) = 1997")
def read_year(chain, ohlc):
    return store.read_year(chain.withColumn("year", F.year("trade_date")), "n", 1997).drop("year")


@query("SELECT DISTINCT ticker, expiration FROM chain")
def listed_expirations(chain, ohlc):
    return store.listed_expirations(chain)


@query(f"SELECT ticker, trade_date FROM chain WHERE trade_date BETWEEN DATE '{FROM}' AND DATE '{TO}' UNION SELECT ticker, trade_date FROM ohlc WHERE trade_date BETWEEN DATE '{FROM}' AND DATE '{TO}'")
def feature_dates(chain, ohlc):
    return store.feature_dates(chain, ohlc, FROM, TO)


@query("SELECT ticker, expiration, expiration AS dashed, expiration AS packed, CAST(NULL AS DATE) AS wrong FROM chain GROUP BY ALL")
def parse_ymd_(chain, ohlc):
    days = chain.select("ticker", "expiration").distinct()
    return days.select(
        "ticker",
        "expiration",
        parse_ymd(F.concat(F.date_format("expiration", "yyyy-MM-dd"), F.lit("T00:00:00"))).alias("dashed"),
        parse_ymd(F.date_format("expiration", "yyyyMMdd").cast("int")).alias("packed"),
        parse_ymd(F.concat(F.date_format("expiration", "yyyy-"), F.lit("02-30"))).alias("wrong"),
    )


def _texts(parsed: DataFrame) -> DataFrame:
    """Clean rows of one shape, with the requested date."""
    return payloads.dedupe_sum(payloads.stamp_trade_date(payloads.clean_chain(parsed), "requested_date"))


@query(CLEAN_SQL)
def payload_header_rows(chain, ohlc):
    return _texts(payloads.header_rows(adapter.payloads(chain, "header")))


@query(CLEAN_SQL)
def payload_columnar(chain, ohlc):
    return _texts(payloads.columnar(adapter.payloads(chain, "columnar")))


@query(CLEAN_SQL)
def payload_records(chain, ohlc):
    return _texts(payloads.records(adapter.payloads(chain, "records")))


def _landed(chain: DataFrame) -> DataFrame:
    """Each ticker's payloads in a shape of its own."""
    out = None
    for ticker, shape in zip(adapter.TICKERS, ("header", "columnar", "records"), strict=True):
        part = adapter.payloads(chain.filter(F.col("ticker") == ticker), shape)
        out = part if out is None else out.unionByName(part)
    return out


@query(CLEAN_SQL)
def ingest_history(chain, ohlc):
    return payloads.ingest_history(_landed(chain))


@query(
    """, cal AS (SELECT DISTINCT trade_date AS day FROM ohlc WHERE isodow(trade_date) < 6), clean AS (""" + CLEAN_SQL + """),
last AS (SELECT d.trade_date, coalesce(max(day), d.trade_date) AS on_day FROM (SELECT DISTINCT trade_date FROM clean) d LEFT JOIN cal ON day BETWEEN d.trade_date - 10 AND d.trade_date GROUP BY d.trade_date)
SELECT ticker, on_day AS trade_date, expiration, strike, option_type, CAST(sum(oi) AS BIGINT) AS oi FROM clean JOIN last USING (trade_date) GROUP BY ALL"""
)
def ingest_snapshot(chain, ohlc):
    days = ohlc.select("trade_date").distinct().filter(F.weekday("trade_date") < 5)
    return payloads.ingest_snapshot(_landed(chain).withColumnRenamed("requested_date", "taken_on"), days)


@query("SELECT ticker, trade_date, expiration, strike, option_type, CAST(3 * oi AS BIGINT) AS oi FROM chain")
def dedupe_sum(chain, ohlc):
    return payloads.dedupe_sum(chain.unionByName(chain.withColumn(OI, F.col(OI) * 2)))


@query("SELECT ticker, trade_date, count(*) + count(*) FILTER (WHERE option_type = 'C') AS n_raw, count(*) AS n_distinct, count(*) FILTER (WHERE option_type = 'C') AS n_dropped FROM chain GROUP BY ALL")
def dup_report(chain, ohlc):
    return payloads.dup_report(chain.unionByName(chain.filter("option_type = 'C'")))


@query(
    """SELECT ticker, trade_date, CASE WHEN volume % 3 = 0 THEN NULL ELSE open END AS open, high, low, CASE WHEN volume % 5 = 0 THEN NULL ELSE close END AS close, adj_close,
    CASE WHEN volume % 7 = 0 THEN NULL ELSE volume END AS volume, dividends, splits FROM ohlc"""
)
def normalise_ohlc(chain, ohlc):
    dirty = ohlc.withColumn("open", F.when(F.col("volume") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("open")))
    dirty = dirty.withColumn("close", F.when(F.col("volume") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("close")))
    dirty = dirty.withColumn("volume", F.when(F.col("volume") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("volume").cast("double")))
    return payloads.normalise_ohlc(dirty.withColumn("ticker", F.lower("ticker")).withColumn("trade_date", F.col("trade_date").cast("timestamp")))


@query("SELECT ticker, trade_date, CASE WHEN close >= 100 THEN close END AS close FROM ohlc")
def finite_or_null_(chain, ohlc):
    bad = F.when(F.col("close") < 97, F.lit(float("nan"))).when(F.col("close") < 100, F.lit(float("-inf"))).otherwise(F.col("close"))
    return ohlc.select(*DAY_KEY, finite_or_null(bad).alias("close"))


@query("SELECT ticker, CAST(year(trade_date) AS INTEGER) AS year, trade_date, expiration, strike, option_type, oi FROM chain WHERE ticker = 'R' AND trade_date >= DATE '1997-06-01'")
def read_range(chain, ohlc):
    return store.read_range(chain.withColumn("year", F.year("trade_date")), "r", "1997-06-01", None)


# ---- merges ------------------------------------------------------------------------------


@query("SELECT ticker, trade_date, expiration, strike, option_type, CASE WHEN option_type = 'P' THEN oi * 100 WHEN strike > 100 THEN oi * 10 ELSE oi END AS oi FROM chain")
def merge_keep_last(chain, ohlc):
    first = chain.filter("strike > 100").withColumn(OI, F.col(OI) * 10)
    second = chain.filter("option_type = 'P'").withColumn(OI, F.col(OI) * 100)
    return merge.merge_keep_last(merge.in_order(chain, first, second), merge.CONTRACT_KEY)


@query("SELECT * REPLACE (CASE WHEN strike > 100 THEN NULL ELSE strike END AS strike) FROM chain")
def coerce_chain(chain, ohlc):
    loose = chain.withColumn("strike", F.when(F.col("strike") > 100, "n/a").otherwise(F.col("strike").cast("string")))
    return merge.coerce_chain(loose.withColumn("trade_date", F.col("trade_date").cast("string")).withColumn("extra", F.lit(1)))


@query("SELECT * REPLACE (CASE WHEN volume > 1 THEN close + 1 ELSE close END AS close) FROM ohlc")
def upsert_ohlc(chain, ohlc):
    later = ohlc.filter("volume > 1").withColumn("close", F.col("close") + 1)
    return merge.merge_keep_last(merge.in_order(ohlc, later), DAY_KEY)


@query(
    f"""SELECT ticker, trade_date, volume * 2 AS volume FROM ohlc WHERE ticker <> 'R' AND trade_date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND volume > 1
UNION ALL SELECT ticker, trade_date, volume FROM ohlc WHERE ticker = 'R' OR NOT trade_date BETWEEN DATE '{FROM}' AND DATE '{TO}'"""
)
def range_replace(chain, ohlc):
    old = ohlc.select(*DAY_KEY, "volume")
    new = store.filter_range(old, FROM, TO).filter("ticker <> 'R' AND volume > 1").withColumn("volume", F.col("volume") * 2)
    return merge.range_replaced(old, new, FROM, TO)


@query("SELECT ticker, trade_date, expiration, strike, option_type, CASE WHEN strike > 100 THEN oi * 2 ELSE oi END AS oi FROM chain WHERE option_type = 'C' OR strike > 100")
def upsert_chain(chain, ohlc):
    """Two batches through the partitioned store."""
    spark = chain.sparkSession
    root = new_root(spark, "chain")
    merge.upsert_chain(chain.filter("option_type = 'C'"), root)
    merge.upsert_chain(chain.filter("strike > 100").withColumn(OI, F.col(OI) * 2), root)
    return store.read_chain(spark, root).drop("year")


@query("SELECT * REPLACE (CAST(CASE WHEN option_type = 'C' AND strike > 110 THEN oi * 40 WHEN strike > 100 THEN oi * 30 WHEN option_type = 'C' THEN oi * 20 ELSE oi * 10 END AS BIGINT) AS oi) FROM chain")
def upsert_chain_in_order(chain, ohlc):
    """One batch of several folders of files, of falling and then rising size, that repeat keys: the row of the last folder wins."""
    spark = chain.sparkSession
    root, landed = new_root(spark, "chain"), new_root(spark, "landed")
    few = chain.filter("option_type = 'C' AND strike > 110")
    for i, part in enumerate((chain, chain.filter("option_type = 'C'"), few, chain.filter("strike > 100"), few)):
        part.withColumn(OI, F.col(OI) * (10, 20, 1, 30, 40)[i]).write.parquet(f"{landed}/{i}")
    merge.upsert_chain(chain.withColumn(OI, F.lit(0).cast("bigint")), root)
    merge.upsert_chain(merge.read_in_order(spark, *[f"{landed}/{i}" for i in range(5)], schema=CHAIN), root)
    return store.read_chain(spark, root).drop("year")


@query(
    """SELECT ticker, trade_date, close, CASE WHEN year(trade_date) >= 1997 THEN adj_close END AS adj_close, CASE WHEN year(trade_date) IN (1995, 1996) THEN high - low END AS spread,
CASE WHEN year(trade_date) >= 1995 THEN 'v' || CASE WHEN year(trade_date) < 1997 THEN 2 ELSE 3 END END AS source FROM ohlc"""
)
def schema_versions(chain, ohlc):
    """Three versions of a price table read as one: a column that was dropped and added again is null where it is older, and so is one that came later."""
    spark = chain.sparkSession
    root, year = new_root(spark, "evolved"), F.year("trade_date")
    prices = ohlc.select(*DAY_KEY, "close", "adj_close", year.alias("year"), (F.col("high") - F.col("low")).alias("spread"))
    versions.commit(prices.filter("year < 1995").drop("spread"), root, ["year"], DAY_KEY)
    field = lambda name, kind: StructField(name, kind())
    versions.evolve(spark, root, add=[field("spread", DoubleType), field("source", StringType)], drop=["adj_close"])
    versions.commit(prices.filter("year BETWEEN 1995 AND 1996").drop("adj_close").withColumn("source", F.lit("v2")), root, ["year"], DAY_KEY)
    versions.evolve(spark, root, add=[field("adj_close", DoubleType)])
    versions.commit(prices.filter("year >= 1997").drop("spread").withColumn("source", F.lit("v3")), root, ["year"], DAY_KEY)
    schema = StructType([field("ticker", StringType), field("trade_date", DateType), field("close", DoubleType), field("adj_close", DoubleType), field("spread", DoubleType), field("source", StringType), field("year", IntegerType)])
    return versions.read(spark, root, schema, ["year"]).drop("year")


@query("SELECT ticker, expiration FROM chain WHERE year(trade_date) <> 1997 OR option_type = 'C' GROUP BY ALL")
def kept_expirations(chain, ohlc):
    """What was ever listed, as the store keeps it: merges add expirations, and those that a replaced year has lost are gone."""
    spark = chain.sparkSession
    root = new_root(spark, "chain")
    merge.upsert_chain(chain.filter("year(trade_date) < 1997"), root)
    merge.upsert_chain(chain.filter("year(trade_date) >= 1997"), root)
    now = versions.version(spark, root)
    calls = store.read_chain(spark, root).filter("year = 1997 AND option_type = 'C'")
    versions.commit(calls, root, store.BY_TICKER_YEAR, ["trade_date"], gone=[k for k in now.live if k[1] == "1997"], beside=merge.listed_by_year)
    return store.read_expirations(spark, root)


@query(ORACLES["upsert_ohlc"].split("\n")[-1])
def upsert_ohlc_sink(chain, ohlc):
    """Two batches through the partitioned price store."""
    spark = chain.sparkSession
    root = new_root(spark, "ohlc")
    merge.upsert_ohlc(ohlc, root)
    merge.upsert_ohlc(ohlc.filter("volume > 1").withColumn("close", F.col("close") + 1), root)
    return store.read_ohlc(spark, root)


@query(f"SELECT *, CAST(year(trade_date) AS INTEGER) AS year FROM chain WHERE ticker = 'R' AND trade_date BETWEEN DATE '{FROM}' AND DATE '{TO}'")
def store_read_range(chain, ohlc):
    """A range of one ticker from the partitioned store; both ends count, other partitions are skipped."""
    root = new_root(chain.sparkSession, "chain")
    merge.upsert_chain(chain, root)
    return store.read_range(store.read_chain(chain.sparkSession, root), "r", FROM, TO)


@query("SELECT *, CAST(year(trade_date) AS INTEGER) AS year FROM chain WHERE ticker = 'N' AND year(trade_date) IN (SELECT max(year(trade_date)) FROM chain WHERE ticker = 'N')")
def store_read_last_year(chain, ohlc):
    """The last year that the store lists for a ticker."""
    root = new_root(chain.sparkSession, "chain")
    merge.upsert_chain(chain, root)
    held = store.read_chain(chain.sparkSession, root)
    return store.read_year(held, "n", store.list_years(held, "n").agg(F.max("year")).first()[0])


@query("SELECT *, CAST(year(trade_date) AS INTEGER) AS year FROM chain WHERE ticker = 'N' AND year(trade_date) IN (1996, 1997)")
def read_chain_files(chain, ohlc):
    """Two years of one ticker from the older layout, a file for each: other files stay shut."""
    spark = chain.sparkSession
    hive, root = new_root(spark, "hive"), new_root(spark, "older")
    chain.withColumn("year", F.year("trade_date")).repartition("ticker", "year").write.partitionBy("ticker", "year").parquet(hive)
    pattern, files = versions.file_at(spark, f"{hive}/*/*/*.parquet")
    for s in files.globStatus(pattern):
        ticker, year = (p.split("=")[1] for p in s.getPath().toString().split("/")[-3:-1])
        files.mkdirs(versions.file_at(spark, f"{root}/{ticker.lower()}")[0])
        files.rename(s.getPath(), versions.file_at(spark, f"{root}/{ticker.lower()}/{year}.parquet")[0])
    return store.read_chain_files(spark, root, tickers=["n"], years=[1996, 1997])


@query("SELECT ticker, CAST(year(trade_date) AS INTEGER) AS year, count(*) AS n_source, count(*) AS n_stored, true AS matches FROM chain GROUP BY ALL")
def export_by_year(chain, ohlc):
    """A raw table moved into the store, then both counted."""
    root = new_root(chain.sparkSession, "export")
    merge.export_by_year(chain, root)
    return quality.reconcile_counts(chain, store.read_chain(chain.sparkSession, root))


@query("SELECT ticker, CAST(year(trade_date) AS INTEGER) AS year, count(*) AS n FROM chain GROUP BY ALL")
def year_counts(chain, ohlc):
    return quality.year_counts(chain)


@query("SELECT ticker, CAST(year(trade_date) AS INTEGER) AS year, count(*) AS n_source, count(*) FILTER (WHERE ticker <> 'N' OR strike < 118) AS n_stored, count(*) = count(*) FILTER (WHERE ticker <> 'N' OR strike < 118) AS matches FROM chain GROUP BY ALL")
def reconcile_counts(chain, ohlc):
    return quality.reconcile_counts(chain, chain.filter("ticker <> 'N' OR strike < 118"))


# ---- calendar ----------------------------------------------------------------------------

HOLIDAYS = "SELECT DISTINCT trade_date FROM ohlc WHERE ticker = 'A' AND volume % 4 = 0"


@query(f", hol AS ({HOLIDAYS}) SELECT CAST(d AS DATE) AS trade_date FROM (SELECT unnest(generate_series(CAST(min(trade_date) AS TIMESTAMP), CAST(max(trade_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM chain) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT trade_date FROM hol)")
def trading_days(chain, ohlc):
    holidays = ohlc.filter("ticker = 'A' AND volume % 4 = 0").select(F.col("trade_date").alias("date")).distinct()
    start, end = chain.agg(F.min("trade_date"), F.max("trade_date")).first()
    return calendar.trading_days(ohlc.sparkSession, start, end, holidays)


@query(", cal AS (SELECT DISTINCT trade_date AS day FROM ohlc WHERE volume > 1), d AS (SELECT DISTINCT trade_date FROM chain) SELECT trade_date, coalesce(max(day), trade_date) AS last_trading_day FROM d LEFT JOIN cal ON day BETWEEN trade_date - 10 AND trade_date GROUP BY trade_date")
def last_trading_day(chain, ohlc):
    return calendar.last_trading_day(chain.select("trade_date").distinct(), ohlc.filter("volume > 1").select("trade_date").distinct())


@query(", d AS (SELECT DISTINCT trade_date, CAST(date_trunc('month', trade_date) AS DATE) AS m FROM chain) SELECT trade_date, m + CAST((12 - isodow(m)) % 7 + 14 AS INTEGER) AS third_friday FROM d")
def third_friday_(chain, ohlc):
    return chain.select("trade_date").distinct().withColumn("third_friday", third_friday(F.col("trade_date")))


#: Walks the third Fridays of eight months for each day and takes the first that is not past.
MONTHLY_SQL = """, days AS (SELECT DISTINCT ticker, trade_date FROM chain), listed AS (SELECT DISTINCT ticker, expiration FROM chain),
firsts AS (SELECT CAST(m AS DATE) AS m FROM generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2006-12-01', INTERVAL 1 MONTH) AS t(m)),
fridays AS (SELECT m + CAST((12 - isodow(m)) % 7 + 14 AS INTEGER) AS fri FROM firsts),
ahead AS (SELECT ticker, trade_date, min(fri) AS fri FROM days JOIN fridays ON fri BETWEEN trade_date AND trade_date + 62 GROUP BY ALL),
monthly AS (SELECT a.ticker, a.trade_date, CASE
    WHEN EXISTS (SELECT 1 FROM listed l WHERE l.ticker = a.ticker AND l.expiration = fri) THEN fri
    WHEN EXISTS (SELECT 1 FROM listed l WHERE l.ticker = a.ticker AND l.expiration = fri - 1) THEN fri - 1 ELSE fri END AS next_monthly FROM ahead a)"""


@query(MONTHLY_SQL + " SELECT * FROM monthly")
def next_monthly(chain, ohlc):
    return calendar.next_monthly(chain.select(*DAY_KEY).distinct(), chain)


@query(
    """, m AS (SELECT max(trade_date) AS d FROM chain), w(part, lo, hi) AS (SELECT 'ohlc', d - 10, d FROM m UNION ALL SELECT 'chain', d - 10, d FROM m UNION ALL SELECT 'features', d - 45, d FROM m UNION ALL SELECT 'buffer', d - 175, d FROM m)
SELECT part, count(*) AS n, min(trade_date) AS first_day FROM chain JOIN w ON trade_date BETWEEN lo AND hi GROUP BY part"""
)
def refresh_window(chain, ohlc):
    """The chain rows of each range of a daily refresh on the last chain day."""
    out = None
    for part, (start, end) in calendar.refresh_window(chain.agg(F.max("trade_date")).first()[0]).items():
        rows = store.filter_range(chain, start, end).groupBy(F.lit(part).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_day"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT ticker, trade_date, expiration, CAST(expiration - trade_date AS INTEGER) AS dte FROM chain GROUP BY ALL")
def dte(chain, ohlc):
    return chain.select(*DAY_KEY, "expiration").distinct().withColumn("dte", days_to_expiry(F.col("expiration"), F.col("trade_date")))


# ---- spots -------------------------------------------------------------------------------

SPOT_SQL = MONTHLY_SQL + """, prior AS (SELECT d.ticker, d.trade_date, p.close AS spot_pc FROM days d ASOF LEFT JOIN ohlc p ON d.ticker = p.ticker AND d.trade_date > p.trade_date),
dim AS (SELECT r.ticker, r.trade_date, spot_pc, o.open AS spot_co, next_monthly FROM prior r LEFT JOIN ohlc o ON o.ticker = r.ticker AND o.trade_date = r.trade_date JOIN monthly m ON m.ticker = r.ticker AND m.trade_date = r.trade_date)"""


@query(SPOT_SQL + " SELECT ticker, trade_date, spot_pc FROM prior")
def spot_asof(chain, ohlc):
    return asof.as_of_prior(chain.select(*DAY_KEY), ohlc, "close", "spot_pc")


@query(SPOT_SQL + " SELECT ticker, trade_date, spot_co FROM dim")
def spot_same_day(chain, ohlc):
    return asof.spot_same_day(chain.select(*DAY_KEY).distinct(), ohlc)


@query(SPOT_SQL + " SELECT * FROM dim")
def day_dim(chain, ohlc):
    return day_features.day_dim(chain, ohlc)


@query(SPOT_SQL + " SELECT DISTINCT c.ticker, c.trade_date, strike, CASE WHEN spot_pc > 0 THEN strike / spot_pc - 1 END AS m_pc, CASE WHEN spot_co > 0 THEN strike / spot_co - 1 END AS m_co FROM chain c JOIN dim USING (ticker, trade_date)")
def moneyness_(chain, ohlc):
    rows = chain.join(day_features.day_dim(chain, ohlc), DAY_KEY)
    return rows.select(*DAY_KEY, "strike", *[moneyness(F.col("strike"), F.col(f"spot_{s}")).alias(f"m_{s}") for s in SPOTS]).distinct()


@query("SELECT * FROM chain WHERE ticker IN (SELECT ticker FROM ohlc WHERE ticker <> 'R')")
def ticker_gate(chain, ohlc):
    return asof.ticker_gate(chain, ohlc.filter("ticker <> 'R'"))


# ---- day features ------------------------------------------------------------------------


def _feature_sql() -> str:
    """CTEs from the chain to all open-interest features, one day row per ticker."""
    sides = {"all": "true", "call": "option_type = 'C'", "put": "option_type = 'P'"}
    spans = {"0_30": "dte BETWEEN 0 AND 30", "31_90": "dte BETWEEN 31 AND 90", "91_365": "dte BETWEEN 91 AND 365"}
    bands = {"within_5pct": "abs(m_{s}) <= 0.05", "within_10pct": "abs(m_{s}) <= 0.10", "above_spot": "m_{s} > 0", "below_spot": "m_{s} < 0"}
    oi = "CAST(coalesce(sum(oi) FILTER (WHERE {c}), 0) AS BIGINT)"
    mean = "sum(strike * oi) FILTER (WHERE {c}) / nullif(sum(oi) FILTER (WHERE {c}), 0)"
    day = ["CAST(sum(oi) AS BIGINT) AS total_oi"]
    day += [f"{oi.format(c=sides[n])} AS {n}_oi" for n in ("call", "put")]
    day += [f"CASE WHEN spot_{s} > 0 THEN {oi.format(c=c.format(s=s))} END AS oi_{b}_{s}" for b, c in bands.items() for s in SPOTS]
    day += [f"{mean.format(c=c)} AS oi_weighted_{n}" for n, c in sides.items()]
    day += [f"{mean.format(c=f'{c} AND {r}')} AS oi_weighted_{n}_{b}d" for b, r in spans.items() for n, c in sides.items()]
    day += [f"{oi.format(c=r)} AS oi_{b}" for b, r in spans.items()]
    day += ["CAST(sum(dte * oi) AS DOUBLE) / nullif(sum(oi), 0) AS weighted_avg_dte", "sum(oi) FILTER (WHERE expiration = front) AS front_oi"]
    day += ["sum(oi) FILTER (WHERE expiration = next_monthly) AS nm_oi", "sum(strike * oi) FILTER (WHERE expiration = next_monthly) AS nm_strike_oi"]
    share = lambda a, b="total_oi": f"CAST({a} AS DOUBLE) / nullif({b}, 0)"
    ratio = {"put_call_oi_ratio": share("put_oi", "call_oi"), "pct_oi_in_front_expiry": share("front_oi"), "pct_oi_next_monthly": share("nm_oi")}
    ratio |= {f"top{n}_strikes_pct_total_oi": share(f"top{n}_oi") for n in (5, 10)} | {f"pct_oi_{b}d": share(f"oi_{b}") for b in spans}
    for s in SPOTS:
        ratio |= {f"oi_weighted_{n}{t}_div_spot_{s}": share(f"oi_weighted_{n}{t}", f"spot_{s}") for t in ("", "_0_30d", "_31_90d") for n in sides}
        ratio |= {f"oi_weighted_{n}_minus_spot_{s}": f"oi_weighted_{n} - spot_{s}" for n in sides}
        ratio |= {f"pct_oi_{b}_{s}": share(f"oi_{b}_{s}") for b in bands}
        ratio |= {f"oi_above_below_ratio_{s}": share(f"oi_above_spot_{s}", f"oi_below_spot_{s}"), f"oi_weighted_next_monthly_div_spot_{s}": f"({share('nm_strike_oi', 'nm_oi')}) / nullif(spot_{s}, 0)"}
    lag = {f"d{n}_total_oi_change": f"total_oi - lag(total_oi, {n}) OVER t" for n in (1, 5, 20)}
    for n in (1, 5):
        lag[f"d{n}_total_oi_pct_change"] = f"CAST(total_oi - lag(total_oi, {n}) OVER t AS DOUBLE) / nullif(lag(total_oi, {n}) OVER t, 0)"
        for c in ("put_call_oi_ratio", "oi_weighted_all_div_spot_pc", "oi_weighted_all_div_spot_co"):
            name = f"d{n}_{c}_change" if c.startswith("put") else f"d{n}_{c[:-3]}_change{c[-3:]}"
            lag[name] = f"{c} - lag({c}, {n}) OVER t"
    z = {k: f"CASE WHEN count({c}) OVER m >= 60 THEN round(({c} - avg({c}) OVER m) / nullif(stddev_samp({c}) OVER m, 0), 6) + 0.0 END" for k, c in day_features.ZSCORES.items()}
    cols = lambda d: ", ".join(f"{v} AS {k}" for k, v in d.items())
    return SPOT_SQL + f""",
j AS (SELECT c.*, spot_pc, spot_co, next_monthly, CAST(expiration - c.trade_date AS INTEGER) AS dte, CASE WHEN spot_pc > 0 THEN strike / spot_pc - 1 END AS m_pc, CASE WHEN spot_co > 0 THEN strike / spot_co - 1 END AS m_co,
  min(CASE WHEN expiration >= c.trade_date THEN expiration END) OVER (PARTITION BY c.ticker, c.trade_date) AS front FROM chain c JOIN dim USING (ticker, trade_date)),
base AS (SELECT ticker, trade_date, spot_pc, spot_co, {", ".join(day)} FROM j GROUP BY ticker, trade_date, spot_pc, spot_co),
strikes AS (SELECT ticker, trade_date, strike, CAST(sum(oi) AS BIGINT) AS oi, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY sum(oi) DESC) AS rk FROM chain GROUP BY ticker, trade_date, strike),
tops AS (SELECT ticker, trade_date, CAST(sum(oi) FILTER (WHERE rk <= 5) AS BIGINT) AS top5_oi, CAST(sum(oi) FILTER (WHERE rk <= 10) AS BIGINT) AS top10_oi FROM strikes GROUP BY ALL),
heads AS (SELECT ticker, trade_date, option_type, strike FROM chain GROUP BY ticker, trade_date, option_type, strike QUALIFY row_number() OVER (PARTITION BY ticker, trade_date, option_type ORDER BY sum(oi) DESC, strike) = 1),
d AS (SELECT b.*, t.top5_oi, t.top10_oi, c.strike AS max_oi_strike_call, p.strike AS max_oi_strike_put FROM base b JOIN tops t USING (ticker, trade_date)
  LEFT JOIN heads c ON c.ticker = b.ticker AND c.trade_date = b.trade_date AND c.option_type = 'C' LEFT JOIN heads p ON p.ticker = b.ticker AND p.trade_date = b.trade_date AND p.option_type = 'P'),
r AS (SELECT *, {cols(ratio)} FROM d),
l AS (SELECT *, {cols(lag)} FROM r WINDOW t AS (PARTITION BY ticker ORDER BY trade_date)),
oif AS (SELECT *, d1_total_oi_pct_change / nullif(d5_total_oi_pct_change, 0) AS d1_d5_ratio_total_oi_pct_change, {cols(z)} FROM l WINDOW m AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


FEATURE_SQL = _feature_sql()
PRICE_SQL = """, rets AS (SELECT *, ln(nullif(close, 0) / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY trade_date), 0)) AS log_ret FROM ohlc),
pf AS (SELECT ticker, trade_date, """ + ", ".join(
    [f"round(stddev_samp(log_ret) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) * sqrt(252), 6) + 0.0 AS rv_{n}d" for n in (5, 20)]
    + [f"lead(close, {n - 1}) OVER (PARTITION BY ticker ORDER BY trade_date) / nullif(open, 0) - 1 AS ret_{n}d_fwd_oc" for n in ohlc_features.HORIZONS]
) + " FROM rets)"


def _days(columns: list[str]) -> str:
    """SQL for some columns of the day rows."""
    return FEATURE_SQL + f" SELECT ticker, trade_date, {', '.join(columns)} FROM oif"


def _pick(chain, ohlc, columns, lags=False):
    rows = day_features.with_ratios(day_features.day_rows(chain, ohlc))
    rows = day_features.with_lags(rows) if lags else rows
    return rows.select(*DAY_KEY, *columns)


def day_query(name: str, columns: list[str], lags: bool = False) -> None:
    def run(chain, ohlc):
        return _pick(chain, ohlc, columns, lags)

    run.__name__ = name
    query(_days(columns))(run)


_BOTH = lambda *names: [f"{n}_{s}" for n in names for s in SPOTS]
day_query("day_totals", ["total_oi", "call_oi", "put_oi", "put_call_oi_ratio"])
day_query("moneyness_bands", _BOTH("oi_within_5pct", "oi_within_10pct", "pct_oi_within_5pct", "pct_oi_within_10pct"))
day_query("above_below", _BOTH("oi_above_spot", "oi_below_spot", "oi_above_below_ratio", "pct_oi_above_spot", "pct_oi_below_spot"))
day_query("dte_buckets", ["oi_0_30", "oi_31_90", "oi_91_365", "pct_oi_0_30d", "pct_oi_31_90d", "pct_oi_91_365d"])
day_query("weighted_strikes", ["oi_weighted_all", "oi_weighted_call", "oi_weighted_put", *_BOTH("oi_weighted_all_div_spot", "oi_weighted_all_minus_spot")])
day_query("weighted_strikes_dte", [f"oi_weighted_{n}_{b}d" for b in ("0_30", "31_90") for n in day_features.SIDES])
day_query("weighted_dte", ["weighted_avg_dte"])
day_query("top_strikes", ["top5_oi", "top10_oi", "top5_strikes_pct_total_oi", "top10_strikes_pct_total_oi"])
day_query("max_oi_strikes", ["max_oi_strike_call", "max_oi_strike_put"])
day_query("front_expiry_oi", ["pct_oi_in_front_expiry"])
day_query("next_monthly_oi", ["pct_oi_next_monthly", *_BOTH("oi_weighted_next_monthly_div_spot")])
day_query("oi_lags", ["d1_total_oi_change", "d5_total_oi_change", "d20_total_oi_change", "d1_total_oi_pct_change", "d5_total_oi_pct_change", "d1_d5_ratio_total_oi_pct_change"], lags=True)
day_query("ratio_lags", [f"d{n}_put_call_oi_ratio_change" for n in (1, 5)] + [f"d{n}_oi_weighted_all_div_spot_change_{s}" for n in (1, 5) for s in SPOTS], lags=True)


@query(", s AS (SELECT ticker, trade_date, strike, CAST(sum(oi) AS BIGINT) AS all_oi, CAST(sum(oi) FILTER (WHERE option_type = 'C') AS BIGINT) AS call_oi, CAST(sum(oi) FILTER (WHERE option_type = 'P') AS BIGINT) AS put_oi FROM chain GROUP BY ALL) SELECT * FROM s")
def strike_level(chain, ohlc):
    rows = day_features.joined(chain, day_features.day_dim(chain, ohlc))
    return day_features.strike_level(rows).select(*DAY_KEY, "strike", "all_oi", "call_oi", "put_oi")


@query(_days(list(day_features.ZSCORES)))
def zscores(chain, ohlc):
    return rounded(day_features.oi_features(chain, ohlc).select(*DAY_KEY, *day_features.ZSCORES), "zscore_")


@query(PRICE_SQL + " SELECT ticker, trade_date, round(log_ret, 6) + 0.0 AS log_ret FROM rets")
def log_returns(chain, ohlc):
    return rounded(ohlc_features.log_returns(ohlc).select(*DAY_KEY, "log_ret"), "log_ret")


@query(PRICE_SQL + " SELECT ticker, trade_date, rv_5d, rv_20d FROM pf")
def realised_vol(chain, ohlc):
    return rounded(ohlc_features.realised_vol(ohlc_features.log_returns(ohlc)).select(*DAY_KEY, "rv_5d", "rv_20d"), "rv_")


_RETS = [f"ret_{n}d_fwd_oc" for n in ohlc_features.HORIZONS]


@query(PRICE_SQL + f" SELECT ticker, trade_date, {', '.join(_RETS)} FROM pf")
def forward_returns(chain, ohlc):
    return ohlc_features.forward_returns(ohlc).select(*DAY_KEY, *_RETS)


@query(PRICE_SQL + " SELECT * FROM pf")
def ohlc_features_(chain, ohlc):
    return rounded(ohlc_features.ohlc_features(ohlc), "rv_")


_OI = [c for c in FEATURE_COLUMNS if not c.startswith(("rv_", "ret_")) and c not in DAY_KEY]


@query(_days(_OI))
def oi_features(chain, ohlc):
    return rounded(day_features.oi_features(chain, ohlc).select(*DAY_KEY, *_OI), "zscore_")


@query(FEATURE_SQL + PRICE_SQL + f" SELECT {', '.join(FEATURE_COLUMNS)} FROM oif LEFT JOIN pf USING (ticker, trade_date)")
def daily_features_(chain, ohlc):
    return rounded(daily_features(chain, ohlc), "zscore_", "rv_")


def _cut(sql: str) -> str:
    """The same CTEs over the chain and prices of the range and its buffer; listings stay whole."""
    sql = sql.replace("FROM chain)", "FROM cut)", 1)  # the days
    for old in ("FROM chain c", "FROM chain GROUP"):
        sql = sql.replace(old, old.replace("chain", "cut"))
    return sql.replace("ohlc", "cut_ohlc")


_BUFFER = f"trade_date BETWEEN DATE '{FROM}' - 130 AND DATE '{TO}'"


@query(f", cut AS (SELECT * FROM chain WHERE {_BUFFER}), cut_ohlc AS (SELECT * FROM ohlc WHERE {_BUFFER})" + _cut(FEATURE_SQL + PRICE_SQL) + f" SELECT {', '.join(FEATURE_COLUMNS)} FROM oif LEFT JOIN pf USING (ticker, trade_date) WHERE trade_date >= DATE '{FROM}'")
def daily_features_range(chain, ohlc):
    return rounded(daily_features(chain, ohlc, FROM, TO), "zscore_", "rv_")


_KEPT = ["total_oi", "call_oi", "spot_pc", "spot_co", "max_oi_strike_call", "d1_total_oi_change", "d5_total_oi_change"]


@query(_days(_KEPT))
def rebuild_jobs(chain, ohlc):
    """A full rebuild of the feature store, then one of a range: these columns are the same in both."""
    spark = chain.sparkSession
    root = new_root(spark, "store")
    merge.upsert_chain(chain, f"{root}/chain")
    merge.upsert_ohlc(ohlc, f"{root}/ohlc")
    jobs.rebuild(spark, root)
    jobs.rebuild(spark, root, FROM, TO)
    return store.read_features(spark, f"{root}/features").select(*DAY_KEY, *_KEPT)


@query(FEATURE_SQL + PRICE_SQL + f" SELECT {', '.join(FEATURE_COLUMNS)} FROM oif LEFT JOIN pf USING (ticker, trade_date)")
def rebuild_full(chain, ohlc):
    """A full rebuild of the feature store, all columns."""
    spark = chain.sparkSession
    root = new_root(spark, "store")
    merge.upsert_chain(chain, f"{root}/chain")
    merge.upsert_ohlc(ohlc, f"{root}/ohlc")
    jobs.rebuild(spark, root)
    return rounded(store.read_features(spark, f"{root}/features").select(*FEATURE_COLUMNS), "zscore_", "rv_")


AS_OF = date.fromisoformat(TO)
#: The chain after ``_refreshed``: the last days came as payloads, whose dirt is gone; the day's puts still are the snapshot's.
REFRESHED_SQL = f""", refreshed AS (SELECT ticker, trade_date, expiration, strike, option_type, CAST(CASE WHEN trade_date = DATE '{AS_OF}' AND option_type = 'P' THEN 2 * oi ELSE oi END AS BIGINT) AS oi FROM chain
WHERE trade_date < DATE '{AS_OF}' - 10 OR strike NOT IN (80, 82.5, 85, 87.5) AND (trade_date <= DATE '{AS_OF}' OR trade_date = DATE '{AS_OF}' + 1 AND option_type = 'C'))"""


def _calendar(chain: DataFrame, root: str) -> DataFrame:
    """The chain's days as a small table of its own, so that no refresh or micro-batch folds the whole chain for them again."""
    days = chain.select("trade_date").distinct()
    days.write.parquet(f"{root}/calendar")
    return chain.sparkSession.read.schema(days.schema).parquet(f"{root}/calendar")


def _refreshed(chain: DataFrame, ohlc: DataFrame) -> str:
    """A store of older rows, a daily refresh, and the next day's: its late history overwrites the calls of the snapshot."""
    spark, day = chain.sparkSession, F.col("trade_date")
    root, ago, next_day = new_root(spark, "daily"), AS_OF - timedelta(days=10), AS_OF + timedelta(days=1)
    merge.upsert_chain(chain.filter(day < ago), f"{root}/chain")
    merge.upsert_ohlc(ohlc.filter(day < ago), f"{root}/ohlc")
    days = _calendar(chain, root)
    prices = store.filter_range(ohlc, ago, next_day)
    landed = adapter.payloads(store.filter_range(chain, ago, AS_OF - timedelta(days=1)), "header")
    snapshot = adapter.payloads(chain.filter(day == AS_OF).withColumn(OI, F.col(OI) * 2), "records").withColumnRenamed("requested_date", "taken_on")
    jobs.daily_refresh(spark, root, AS_OF, prices, landed, snapshot, days)
    late = adapter.payloads(store.filter_range(chain, AS_OF, next_day).filter("option_type = 'C'"), "columnar")
    jobs.daily_refresh(spark, root, next_day, prices, late, snapshot.limit(0), days)
    return root


@query(REFRESHED_SQL + " SELECT * FROM refreshed")
def daily_refresh_chain(chain, ohlc):
    return store.read_chain(chain.sparkSession, _refreshed(chain, ohlc) + "/chain").drop("year")


@query(
    REFRESHED_SQL
    + f""" SELECT ticker, trade_date, CAST(sum(oi) AS BIGINT) AS total_oi, CAST(coalesce(sum(oi) FILTER (WHERE option_type = 'C'), 0) AS BIGINT) AS call_oi, CAST(coalesce(sum(oi) FILTER (WHERE option_type = 'P'), 0) AS BIGINT) AS put_oi
FROM refreshed WHERE trade_date BETWEEN DATE '{AS_OF}' - 45 AND DATE '{AS_OF}' + 1 GROUP BY ticker, trade_date"""
)
def daily_refresh_features(chain, ohlc):
    rows = store.read_features(chain.sparkSession, _refreshed(chain, ohlc) + "/features")
    return rows.select(*DAY_KEY, "total_oi", "call_oi", "put_oi")


@query(REFRESHED_SQL + " SELECT * FROM refreshed")
def stream_refresh(chain, ohlc):
    """The same two refreshes as payload files in one stream, the later run first and each file a micro-batch; then all of it again."""
    spark, day = chain.sparkSession, F.col("trade_date")
    root, ago, next_day = new_root(spark, "stream"), AS_OF - timedelta(days=10), AS_OF + timedelta(days=1)
    merge.upsert_chain(chain.filter(day < ago), f"{root}/chain")
    landed = lambda rows, shape, kind, run: adapter.payloads(rows, shape).select("ticker", "requested_date", F.lit(kind).alias("kind"), F.lit(run).alias("run_date"), "payload")
    late = landed(store.filter_range(chain, AS_OF, next_day).filter("option_type = 'C'"), "columnar", "history", next_day)
    taken = landed(chain.filter(day == AS_OF).withColumn(OI, F.col(OI) * 2), "records", "snapshot", AS_OF)
    first = landed(store.filter_range(chain, ago, AS_OF - timedelta(days=1)), "header", "history", AS_OF)
    for i, rows in enumerate((late, taken, first)):
        rows.repartition(1).write.mode("append").json(f"{root}/landing")
    days = _calendar(chain, root)
    for again in range(2):
        arrivals = streaming.read_landing(spark, f"{root}/landing", 1, streaming.ARRIVALS)
        streaming.merge_arrivals(arrivals, f"{root}/chain", days, f"{root}/progress-{again}").awaitTermination()
    return store.read_chain(spark, f"{root}/chain").drop("year")


_SINCE = AS_OF - timedelta(days=2)
_KNOWN = f"trade_date BETWEEN DATE '{_SINCE}' - 130 AND DATE '{AS_OF}'"


@query(
    f", known AS (SELECT * FROM chain WHERE trade_date <= DATE '{AS_OF}'), cut AS (SELECT * FROM chain WHERE {_KNOWN}), cut_ohlc AS (SELECT * FROM ohlc WHERE {_KNOWN})"
    + re.sub(r"\bFROM chain\b", "FROM known", _cut(FEATURE_SQL + PRICE_SQL))
    + f" SELECT {', '.join(FEATURE_COLUMNS)} FROM oif LEFT JOIN pf USING (ticker, trade_date) WHERE trade_date >= DATE '{_SINCE}'"
)
def added_days(chain, ohlc):
    """Three new days on top of a store that was built without them: as a range rebuild of these days has them."""
    spark, day, last = chain.sparkSession, F.col("trade_date"), _SINCE - timedelta(days=1)
    root = new_root(spark, "added")
    for until in (last, AS_OF):
        since = F.lit(True) if until == last else day > last
        merge.upsert_chain(chain.filter((day <= until) & since), f"{root}/chain")
        merge.upsert_ohlc(ohlc.filter((day <= until) & since), f"{root}/ohlc")
        jobs.rebuild(spark, root) if until == last else carry.add_days(spark, root, _SINCE, AS_OF)
    return rounded(store.read_features(spark, f"{root}/features", _SINCE).select(*FEATURE_COLUMNS), "zscore_", "rv_")


# ---- views -------------------------------------------------------------------------------

SURFACE_SQL = ", surface AS (SELECT c.*, CAST(expiration - c.trade_date AS SMALLINT) AS dte, o.close AS spot_close, CASE WHEN o.close > 0 THEN strike / o.close - 1 END AS moneyness FROM chain c LEFT JOIN ohlc o ON o.ticker = c.ticker AND o.trade_date = c.trade_date), latest AS (SELECT * FROM surface s WHERE trade_date = (SELECT max(trade_date) FROM surface x WHERE x.ticker = s.ticker))"


@query(SURFACE_SQL + " SELECT * FROM surface")
def build_surface(chain, ohlc):
    return views.build_surface(chain, ohlc)


@query(SURFACE_SQL + " SELECT * FROM surface WHERE oi >= 10 AND dte <= 200 AND abs(moneyness) <= 0.15")
def build_surface_filtered(chain, ohlc):
    return views.build_surface(chain, ohlc, min_oi=10, max_dte=200, max_abs_moneyness=0.15)


@query(SURFACE_SQL + " SELECT * FROM latest")
def surface_latest(chain, ohlc):
    return views.surface_latest(views.build_surface(chain, ohlc))


@query(SURFACE_SQL + " SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY oi DESC, expiration, strike, option_type) AS INTEGER) AS oi_rank FROM latest QUALIFY oi_rank <= 25")
def top_nodes_latest(chain, ohlc):
    return views.top_nodes_latest(views.build_surface(chain, ohlc))


@query(
    SURFACE_SQL
    + """, p AS (SELECT *, lag(oi) OVER (PARTITION BY ticker, expiration, strike, option_type ORDER BY trade_date) AS oi_prev FROM surface)
SELECT ticker, trade_date, expiration, dte, strike, option_type, oi AS oi_today, oi_prev, oi - oi_prev AS oi_change, CASE WHEN oi_prev > 0 THEN CAST(oi - oi_prev AS DOUBLE) / oi_prev END AS oi_pct_change, spot_close, moneyness FROM p"""
)
def oi_changes_daily(chain, ohlc):
    return views.oi_changes_daily(views.build_surface(chain, ohlc))


@query(
    SURFACE_SQL
    + """ SELECT ticker, trade_date, expiration, dte, CAST(sum(oi) AS BIGINT) AS total_oi, CAST(coalesce(sum(oi) FILTER (WHERE option_type = 'C'), 0) AS BIGINT) AS call_oi,
CAST(coalesce(sum(oi) FILTER (WHERE option_type = 'P'), 0) AS BIGINT) AS put_oi, count(*) AS n_strikes, min(strike) AS min_strike, max(strike) AS max_strike, round(avg(spot_close), 6) AS spot_close,
sum(strike * oi) / nullif(sum(oi), 0) AS oi_weighted_strike FROM surface GROUP BY ticker, trade_date, expiration, dte"""
)
def oi_concentration(chain, ohlc):
    return views.oi_concentration(views.build_surface(chain, ohlc)).withColumn("spot_close", F.round("spot_close", 6))


@query(FEATURE_SQL + PRICE_SQL + f" SELECT {', '.join(FEATURE_COLUMNS)}, o.close AS close_today, o.adj_close AS adj_close_today FROM oif LEFT JOIN pf USING (ticker, trade_date) LEFT JOIN ohlc o USING (ticker, trade_date)")
def features_with_returns(chain, ohlc):
    return views.features_with_returns(rounded(daily_features(chain, ohlc), "zscore_", "rv_"), ohlc)


@query(
    SURFACE_SQL
    + """, f AS (SELECT ticker, trade_date, min(expiration) AS expiration FROM surface WHERE dte >= 0 GROUP BY ticker, trade_date)
SELECT s.*, CAST(row_number() OVER (PARTITION BY ticker, trade_date ORDER BY oi DESC, strike, option_type) AS INTEGER) AS rank_in_front FROM surface s JOIN f USING (ticker, trade_date, expiration) WHERE abs(moneyness) <= 0.05"""
)
def pin_candidates(chain, ohlc):
    return views.pin_candidates(views.build_surface(chain, ohlc))


@query(SURFACE_SQL + " SELECT s.* FROM surface s JOIN (SELECT ticker, trade_date, min(expiration) AS expiration FROM surface WHERE dte >= 0 GROUP BY ticker, trade_date) f USING (ticker, trade_date, expiration)")
def front_rows(chain, ohlc):
    return views.front_rows(views.build_surface(chain, ohlc))


_VIEWS = {"oi_surface_latest": "surface_latest", "oi_top_nodes_latest": "top_nodes_latest", "oi_changes_daily": "oi_changes_daily", "oi_concentration": "oi_concentration", "features_with_returns": "features_with_returns", "pin_candidates": "pin_candidates"}


@query(" UNION ALL ".join(f"SELECT 'v_{v}' AS name, count(*) AS n FROM ({ORACLES[q]})" for v, q in _VIEWS.items()))
def register_views(chain, ohlc):
    """The rows of each registered view, read by its name."""
    spark, out = chain.sparkSession, None
    for name in views.register_views(views.build_surface(chain, ohlc), daily_features(chain, ohlc), ohlc):
        rows = spark.table(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- quality -----------------------------------------------------------------------------


@query("SELECT ticker, expiration, count(*) AS n FROM chain GROUP BY ALL HAVING count(*) > 1")
def check_unique(chain, ohlc):
    return quality.check_unique(chain, ["ticker", "expiration"])


@query(SURFACE_SQL + " SELECT 'oi' AS \"column\", count(*) - count(oi) AS n_null FROM surface UNION ALL SELECT 'spot_close', count(*) - count(spot_close) FROM surface")
def check_not_null(chain, ohlc):
    return quality.check_not_null(views.build_surface(chain, ohlc).withColumnRenamed(OI, "oi"), ["oi", "spot_close"])


@query("SELECT option_type AS value, count(*) AS n FROM chain WHERE option_type <> 'C' GROUP BY ALL")
def check_domain(chain, ohlc):
    return quality.check_domain(chain, "option_type", ["C"])


@query(f"SELECT ticker, trade_date, {', '.join(f'CAST(NULL AS ' + ('BIGINT' if f.dataType.typeName() == 'long' else 'DOUBLE') + f') AS {f.name}' for f in FEATURES.fields[2:])} FROM ohlc")
def align_schema(chain, ohlc):
    return quality.align_schema(ohlc, FEATURES)


@query("SELECT ticker, trade_date, expiration, strike, CAST(NULL AS VARCHAR) AS option_type, oi FROM chain")
def align_schema_casts(chain, ohlc):
    """Columns in another order and of other types are cast, unknown ones dropped, a missing one is null."""
    loose = chain.select(F.col(OI).cast("string").alias(OI), F.lit(1).alias("unknown"), F.col("strike").cast("string").alias("strike"), F.col("trade_date").cast("timestamp").alias("trade_date"), F.col("expiration").cast("string").alias("expiration"), "ticker")
    return quality.align_schema(loose, CHAIN)
