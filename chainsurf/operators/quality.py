"""Checks that a store's keys and domains would enforce, and schema alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_null) for each column; one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column", "n_null")


def check_domain(df: DataFrame, col: str, values: list) -> DataFrame:
    """(value, n) of the non-null values outside the domain."""
    return df.filter(~F.col(col).isin(*values)).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def align_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order: cast where present, typed null where missing; others go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def year_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker", F.year("trade_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def reconcile_counts(source: DataFrame, stored: DataFrame) -> DataFrame:
    """(ticker, year, n_source, n_stored, matches): both sides counted and compared."""
    a, b = year_counts(source).withColumnRenamed("n", "n_source"), year_counts(stored).withColumnRenamed("n", "n_stored")
    both = a.join(b, ["ticker", "year"], "full").na.fill(0, ["n_source", "n_stored"])
    return both.withColumn("matches", F.col("n_source") == F.col("n_stored"))
