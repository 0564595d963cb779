"""Chain and price tables from an order book, for tests and benchmarks.

A chain row is a line item: its return flag is the ticker, its ship date the day, and
part and supplier numbers give expiration and strike.  A price row is a day's orders.
Some April expirations move to Thursday and some September ones a week on, so that both
holiday cases of monthly expirations occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import CONTRACT_KEY, OHLC, OI, OI_FIELD

TICKERS = ("A", "N", "R")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.col("l_shipdate").cast("date")
    friday = F.date_add(day, F.pmod(F.lit(4) - F.weekday(day), F.lit(7)))
    weeks = F.expr("((l_partkey div 17) + l_suppkey) % 60 - 1")
    first = F.date_add(friday, (weeks * 7).cast("int"))
    third_week = F.dayofmonth(first).between(15, 21)
    moved = F.when(third_week & (F.month(first) == 4), F.date_sub(first, 1)).when(third_week & (F.month(first) == 9), F.date_add(first, 7)).otherwise(first)
    rows = items.select(
        F.col("l_returnflag").alias("ticker"),
        day.alias("trade_date"),
        moved.alias("expiration"),
        (80 + F.lit(2.5) * (F.col("l_partkey") % 17)).cast("double").alias("strike"),
        F.when(F.col("l_linestatus") == "F", "C").otherwise("P").alias("option_type"),
        F.col("l_quantity").cast("bigint").alias(OI),
    )
    return rows.groupBy(*CONTRACT_KEY).agg(F.sum(OI).alias(OI))


def ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("trade_date"))
    each = orders.select("*", F.posexplode(F.array(*map(F.lit, TICKERS))).alias("i", "ticker"))
    priced = each.withColumn("price", (95 + ((F.col("o_orderkey") * 37 + F.col("i") * 11) % 41) / F.lit(4.0)).cast("double"))
    days = priced.groupBy("ticker", "trade_date").agg(
        F.min_by("price", "o_orderkey").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return days.withColumns({"adj_close": F.col("close"), "dividends": F.lit(0.0), "splits": F.lit(0.0)}).select(*OHLC.names)


CHAIN_SQL = """
items AS (
  SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS trade_date, l_partkey AS part, l_suppkey AS supp, l_linestatus AS status, CAST(l_quantity AS BIGINT) AS oi FROM lineitem
), dated AS (
  SELECT *, trade_date + CAST((12 - isodow(trade_date)) % 7 + 7 * (((part // 17) + supp) % 60 - 1) AS INTEGER) AS e0 FROM items
), chain AS (
  SELECT ticker, trade_date,
    CASE WHEN day(e0) BETWEEN 15 AND 21 AND month(e0) = 4 THEN e0 - 1 WHEN day(e0) BETWEEN 15 AND 21 AND month(e0) = 9 THEN e0 + 7 ELSE e0 END AS expiration,
    CAST(80 + 2.5 * (part % 17) AS DOUBLE) AS strike, CASE status WHEN 'F' THEN 'C' ELSE 'P' END AS option_type, CAST(sum(oi) AS BIGINT) AS oi
  FROM dated GROUP BY ALL
)"""
OHLC_SQL = """
priced AS (
  SELECT t.ticker, CAST(o_orderdate AS DATE) AS trade_date, o_orderkey, CAST(95 + ((o_orderkey * 37 + t.i * 11) % 41) / 4.0 AS DOUBLE) AS price
  FROM orders, (VALUES ('A', 0), ('N', 1), ('R', 2)) AS t(ticker, i)
), ohlc AS (
  SELECT ticker, trade_date, arg_min(price, o_orderkey) AS open, max(price) AS high, min(price) AS low, arg_max(price, o_orderkey) AS close,
    arg_max(price, o_orderkey) AS adj_close, count(*) AS volume, CAST(0 AS DOUBLE) AS dividends, CAST(0 AS DOUBLE) AS splits
  FROM priced GROUP BY ticker, trade_date
)"""


def payloads(rows: DataFrame, shape: str) -> DataFrame:
    """(ticker, requested_date, payload): the chain as landed JSON, with some dirt.

    Strike 80 gets an unknown right, 82.5 an impossible expiration, 85 no interest and
    87.5 a strike that is no number; all of these rows are to be dropped.
    """
    k = F.col("strike")
    right = {"header": F.col("option_type"), "columnar": F.when(F.col("option_type") == "C", "call").otherwise("put"), "records": F.when(F.col("option_type") == "C", " Call ").otherwise("P")}[shape]
    when = F.date_format("expiration", "yyyy-MM-dd" if shape == "header" else "yyyyMMdd")
    items = rows.select(
        "ticker",
        F.col("trade_date").alias("requested_date"),
        F.when(k == 82.5, "2024-02-30").otherwise(when).alias("expiration"),
        F.when(k == 87.5, "n/a").otherwise(k.cast("string")).alias("strike"),
        F.when(k == 80, "X").otherwise(right).alias("right"),
        F.when(k == 85, 0).otherwise(F.col(OI)).alias(OI_FIELD),
    )
    names = ["expiration", "strike", "right", OI_FIELD]
    if shape == "header":
        body = F.to_json(F.struct(F.struct(F.array(*map(F.lit, names)).alias("format")).alias("header"), F.collect_list(F.array(*[F.col(n).cast("string") for n in names])).alias("response")))
    elif shape == "columnar":
        lists = [F.col(f"_all.{n}").alias(n) for n in names]
        packed = items.groupBy("ticker", "requested_date").agg(F.collect_list(F.struct(*names)).alias("_all"))
        return packed.select("ticker", "requested_date", F.to_json(F.struct(*lists, F.date_format("requested_date", "yyyyMMdd").alias("date"))).alias("payload"))
    else:
        body = F.to_json(F.collect_list(F.struct(*names)))
    return items.groupBy("ticker", "requested_date").agg(body.alias("payload"))


#: The chain rows that survive the dirt of ``payloads``.
CLEAN_SQL = "SELECT ticker, trade_date, expiration, strike, option_type, oi FROM chain WHERE strike NOT IN (80, 82.5, 85, 87.5)"
