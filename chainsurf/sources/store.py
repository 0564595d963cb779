"""Reading the keyed stores: versioned tables, plain Parquet folders, the older layout, and relational tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from ..functions import norm_ticker
from ..schemas import CHAIN, FEATURES, OHLC
from . import versions

PARTITIONED = StructType([*CHAIN.fields, StructField("year", IntegerType())])
EXPIRATIONS = StructType([StructField("ticker", StringType()), StructField("year", IntegerType()), StructField("expiration", DateType())])
BY_TICKER_YEAR, BY_YEAR = ["ticker", "year"], ["year"]
_LEGACY = StructType([f for f in CHAIN.fields if f.name != "ticker"])


def _years(start: date | str | None, end: date | str | None, place: int) -> Callable[[versions.Key], bool]:
    """Does a partition's year lie in the range?"""
    low, high = (None if d is None else date.fromisoformat(str(d)[:10]).year for d in (start, end))
    return lambda key: key[place] is None or (low is None or int(key[place]) >= low) and (high is None or int(key[place]) <= high)


def read_chain(spark: SparkSession, root: str, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """The chain store; with a date range, partitions of other years aren't even listed.

    A plain folder with ``ticker=.../year=...`` is read too.  The schema is fixed, so ``007`` stays text.
    """
    if versions.is_versioned(spark, root):
        rows = versions.read(spark, root, PARTITIONED, BY_TICKER_YEAR, only=_years(start, end, 1))
    else:
        rows = spark.read.schema(PARTITIONED).parquet(root).select(*PARTITIONED.names)
    return filter_range(rows, start, end)


def read_expirations(spark: SparkSession, root: str) -> DataFrame:
    """(ticker, expiration) of all that was ever listed, as the chain store keeps it up to date; no chain partition is opened."""
    if not versions.is_versioned(spark, root):
        return listed_expirations(read_chain(spark, root))
    at = versions.version(spark, root)
    kept = versions.read_beside(spark, root, EXPIRATIONS, BY_TICKER_YEAR, at).select("ticker", "expiration")
    plain = {k for k, (folder, _) in at.live.items() if not folder.startswith("c=")}  # adopted, and not yet written again
    if plain:
        kept = kept.unionByName(versions.read(spark, root, EXPIRATIONS, BY_TICKER_YEAR, only=plain.__contains__, at=at).select("ticker", "expiration"))
    return kept.distinct()


def read_features(spark: SparkSession, root: str, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """The feature store, whole or a date range of it."""
    schema = StructType([*FEATURES.fields, StructField("year", IntegerType())])
    return filter_range(versions.read(spark, root, schema, BY_TICKER_YEAR, only=_years(start, end, 1)), start, end).select(*FEATURES.names)


def older_files(spark: SparkSession, root: str, tickers: Iterable[str] | None = None, years: Iterable[int] | None = None) -> list[tuple[str, int, str]]:
    """(ticker, year, path) of the files ``<ticker>/<year>.parquet``; names that are no year are passed over.  Lists folders, opens nothing."""
    pattern, store = versions.file_at(spark, f"{root}/*/*.parquet")
    tickers = None if tickers is None else {t.strip().upper() for t in tickers}
    years = None if years is None else set(years)
    out = []
    for s in store.globStatus(pattern) or []:
        path = s.getPath().toString()
        found = re.search(r"([^/]+)/([+-]?\d+)\.parquet$", path)
        if found:
            ticker, year = found[1].strip().upper(), int(found[2])
            if (tickers is None or ticker in tickers) and (years is None or year in years):
                out.append((ticker, year, path))
    return sorted(out)


def read_chain_files(spark: SparkSession, root: str, tickers: Iterable[str] | None = None, years: Iterable[int] | None = None) -> DataFrame:
    """The older layout ``<ticker>/<year>.parquet``, whole or some tickers and years of it; only their files are opened.

    Ticker and year come from the path; other files go.
    """
    files = older_files(spark, root, tickers, years)
    if not files:
        return spark.createDataFrame([], PARTITIONED)
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(_LEGACY).parquet(*[p for _, _, p in files])
    rows = rows.withColumn("ticker", norm_ticker(F.url_decode(F.regexp_replace(F.regexp_extract(path, r"([^/]+)/[^/]+\.parquet$", 1), r"\+", "%2B"))))
    rows = rows.withColumn("year", F.regexp_extract(path, r"([^/]+)\.parquet$", 1).cast("int"))
    return rows.select(*PARTITIONED.names)


def list_tickers(chain: DataFrame) -> DataFrame:
    return chain.select(norm_ticker(F.col("ticker")).alias("ticker")).distinct()


def list_years(chain: DataFrame, ticker: str | None = None) -> DataFrame:
    rows = chain if ticker is None else chain.filter(F.col("ticker") == ticker.upper())
    year = F.col("year") if "year" in chain.columns else F.year("trade_date")
    return rows.select("ticker", year.alias("year")).distinct()


def read_year(chain: DataFrame, ticker: str, year: int) -> DataFrame:
    """One partition; no rows, with the schema, where there is none."""
    return chain.filter((F.col("ticker") == ticker.upper()) & (F.col("year") == year))


def filter_range(df: DataFrame, start: date | str | None, end: date | str | None, by: str = "trade_date") -> DataFrame:
    """Inclusive date range; also bounds ``year``, where there is one, so that whole partitions are skipped."""
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            day = date.fromisoformat(str(bound)[:10])
            df = df.filter(getattr(F.col(by), op)(F.lit(day)))
            if "year" in df.columns:
                df = df.filter(getattr(F.col("year"), op)(day.year))
    return df


def read_range(chain: DataFrame, ticker: str, start, end) -> DataFrame:
    return filter_range(chain.filter(F.col("ticker") == ticker.upper()), start, end)


def read_ohlc(spark: SparkSession, root: str, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """The price store, or a plain folder of prices."""
    if versions.is_versioned(spark, root):
        schema = StructType([*OHLC.fields, StructField("year", IntegerType())])
        rows = versions.read(spark, root, schema, BY_YEAR, only=_years(start, end, 0))
    else:
        rows = spark.read.schema(OHLC).parquet(root)
    return filter_range(rows, start, end).select(*OHLC.names)


def date_ranges(first: date, last: date, parts: int) -> list[tuple[date, date]]:
    """[from, to) ranges of about equal length that hold every day from ``first`` to ``last`` once."""
    days = (last - first).days + 1
    cuts = sorted({first + timedelta(days=days * i // parts) for i in range(parts + 1)})
    return list(zip(cuts, cuts[1:], strict=False))


def read_jdbc(spark: SparkSession, url: str, table: str, year_bounds: list[tuple[date, date]] | None = None, parts: int | None = None, on: str = "trade_date", **properties) -> DataFrame:
    """A relational table, read by half-open date ranges, each a task.

    The ranges are given, or ``parts`` of them are cut between the first and the last date,
    which the source is asked for.  Rows without a date come with the first range.  Later
    filters and column choices are part of each task's statement at the source.
    """
    if year_bounds is None and parts is not None:
        span = spark.read.jdbc(url, f"(SELECT MIN({on}) AS a, MAX({on}) AS b FROM {table}) span", properties=properties).first()
        year_bounds = date_ranges(span[0], span[1], parts) if span[0] is not None else None
    if not year_bounds:
        return spark.read.jdbc(url, table, properties=properties)
    day = lambda d: "{d '" + d.isoformat() + "'}"  # noqa: E731  every JDBC driver reads this form
    predicates = [f"{on} >= {day(a)} AND {on} < {day(b)}" for a, b in year_bounds]
    predicates[0] = f"({predicates[0]}) OR {on} IS NULL"
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)


def listed_expirations(chain: DataFrame) -> DataFrame:
    """Every expiration that a ticker ever listed."""
    return chain.select("ticker", "expiration").distinct()


def feature_dates(chain: DataFrame, ohlc: DataFrame, start=None, end=None) -> DataFrame:
    """The days that need a lookup: all chain days and price days of the range."""
    days = filter_range(chain, start, end).select("ticker", "trade_date").union(filter_range(ohlc, start, end).select("ticker", "trade_date"))
    return days.distinct()
