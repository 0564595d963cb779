"""Last-value-wins merges and the sinks that use them.

Rows have no order in Spark, so what is merged carries ``_seq``: the batch (what is
stored comes first), then the row's place in it.  A sink stages its batch once, places
included, so that the batch is evaluated once and its order survives the files; then only
the partitions it touches are read, merged and replaced, in one commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..schemas import CHAIN, CONTRACT_KEY, DAY_KEY, FEATURES, OHLC, OI
from ..sources import versions
from ..sources.store import BY_TICKER_YEAR, BY_YEAR, EXPIRATIONS, PARTITIONED
from .quality import align_schema

SEQ, ROW, RANK = "_seq", "_row", "rank"
_YEAR = StructField("year", IntegerType())
#: The chain as stored, with the rank of rows that came with one.
STORED_CHAIN = StructType([*PARTITIONED.fields, StructField(RANK, LongType())])


def coerce_chain(df: DataFrame, *more: StructField) -> DataFrame:
    """Canonical columns and types, and ``more`` behind them; a bad strike becomes null, a missing interest is an error."""
    typed = df.withColumn("strike", F.col("strike").try_cast("double"))
    oi = F.when(F.col(OI).isNull(), F.raise_error(F.lit(f"{OI} is null"))).otherwise(F.col(OI))
    return align_schema(typed.withColumn(OI, oi), StructType([*CHAIN.fields, *more]))


def read_in_order(spark: SparkSession, *paths: str, schema: StructType | str, kind: str = "parquet") -> DataFrame:
    """Files with the place of each row in ``_row``: by name of the file, then within it.

    Spark deals files to tasks by size, so the order of a plain read is not that of their names.
    """
    rows = spark.read.schema(schema).format(kind).load(list(paths))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias(ROW))


def placed(df: DataFrame) -> DataFrame:
    """The rows with their place in ``_row``: the one they bring along, else that of the frame's own order."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def in_order(*batches: DataFrame) -> DataFrame:
    """The batches united, with their place in ``_seq``: the batch, and within it the row, so that ties have an order."""
    sides = [placed(b) for b in batches]
    kinds = {s.schema[ROW].dataType.simpleString() for s in sides}
    if len(kinds) > 1:  # places of different kinds are compared within their batch only
        names = {k: f"p{i}" for i, k in enumerate(sorted(kinds))}
        place = lambda s: F.struct(*[(F.col(ROW) if s.schema[ROW].dataType.simpleString() == k else F.lit(None)).cast(k).alias(n) for k, n in names.items()])
        sides = [s.withColumn(ROW, place(s)) for s in sides]
    out = None
    for i, s in enumerate(sides):
        s = s.withColumn(SEQ, F.struct(F.lit(i).alias("batch"), F.col(ROW).alias("row"))).drop(ROW)
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def merge_keep_last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that of the highest ``_seq``.  An aggregation, so each task first folds its own rows."""
    rest = [c for c in rows.columns if c not in (*keys, SEQ)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), SEQ).alias("_v")) if rest else rows.select(*keys).distinct()
    return last.select(*[F.col(c) if c in keys else F.col(f"_v.{c}") for c in rows.columns if c != SEQ])


@contextmanager
def staged(batch: DataFrame, root: str) -> Iterator[DataFrame]:
    """The batch as written once beside the table; the files go when the merge is done or has failed."""
    path = f"{root}/_staged/{uuid.uuid4().hex}"
    try:
        batch.write.parquet(path)
        yield batch.sparkSession.read.schema(batch.schema).parquet(path)
    finally:
        versions.delete(batch.sparkSession, path)


def _touched(new: DataFrame, by: list[str]) -> set[versions.Key]:
    """The partitions of a staged batch: as many as the log has lines for, at most."""
    return {tuple(None if v is None else str(v) for v in r) for r in new.select(*by).distinct().collect()}


def listed_by_year(chain: DataFrame) -> DataFrame:
    """What the chain store keeps beside its partitions: the expirations of each."""
    return chain.select(*EXPIRATIONS.names).distinct()


def _merge_chain(batch: DataFrame, root: str, place: Column | None) -> DataFrame:
    spark = batch.sparkSession
    with staged(batch, root) as new:
        onto, touched = versions.version(spark, root), _touched(new, BY_TICKER_YEAR)
        old = versions.read(spark, root, STORED_CHAIN, BY_TICKER_YEAR, only=touched.__contains__, at=onto)
        if place is None:
            rows = in_order(old, new)
        else:
            rows = old.unionByName(new).withColumn(SEQ, place)
        merged = merge_keep_last(rows, CONTRACT_KEY)
        after = versions.commit(merged, root, BY_TICKER_YEAR, ["trade_date", "expiration", "strike", "option_type"], onto=onto, beside=listed_by_year)
    kept = versions.read(spark, root, PARTITIONED, BY_TICKER_YEAR, only=touched.__contains__, at=after)
    return kept.groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("n"))


def upsert_chain(batch: DataFrame, root: str) -> DataFrame:
    """Merge a batch into the chain store; (ticker, year, n) of the partitions after the merge.

    Of rows with one key the last in the batch's order wins: the order of ``_row`` where
    the batch has it (``read_in_order``), else that of the frame.
    """
    rows = placed(batch)
    rows = coerce_chain(rows, rows.schema[ROW]).withColumns({RANK: F.lit(None).cast("long"), "year": F.year("trade_date")})
    return _merge_chain(rows, root, None)


def upsert_ranked(batch: DataFrame, root: str) -> DataFrame:
    """Merge rows with a ``rank``: of one key the highest rank stays, whatever the order in which batches come.

    Equal ranks go by the larger interest, so merging a batch again, or in another order,
    gives the same table.  Rows merged without a rank rank below all others.
    """
    rows = coerce_chain(batch, StructField(RANK, LongType())).withColumn("year", F.year("trade_date"))
    return _merge_chain(rows, root, F.struct(F.coalesce(RANK, F.lit(-(1 << 63))), F.col(OI)))


def upsert_ohlc(batch: DataFrame, root: str) -> None:
    """Merge price rows: all measures of a (ticker, trade_date) are replaced.  Only the years of the batch are rewritten."""
    rows = placed(batch)
    rows = align_schema(rows, StructType([*OHLC.fields, rows.schema[ROW]])).withColumn("year", F.year("trade_date"))
    with staged(rows, root) as new:
        onto, touched = versions.version(batch.sparkSession, root), _touched(new, BY_YEAR)
        old = versions.read(batch.sparkSession, root, StructType([*OHLC.fields, _YEAR]), BY_YEAR, only=touched.__contains__, at=onto)
        versions.commit(merge_keep_last(in_order(old, new), DAY_KEY), root, BY_YEAR, DAY_KEY, onto=onto)


def range_replaced(old: DataFrame, new: DataFrame, start=None, end=None) -> DataFrame:
    """``old`` with the new rows in place of the processed tickers' rows of the range.

    Processed are the tickers with new rows; so an empty slice leaves stale rows as they are.
    """
    within = F.lit(True)
    if start is not None:
        within = F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    done = new.select("ticker").distinct().withColumn("_done", F.lit(True))
    kept = old.join(done, "ticker", "left").filter(F.col("_done").isNull() | ~within).drop("_done")
    return kept.unionByName(new)


def replace_features(new: DataFrame, root: str, start=None, end=None) -> versions.Version:
    """Replace the features of the processed tickers, all of them or those of a date range.

    The slice is evaluated once.  A range reads and rewrites the years it lies in only;
    partitions that have lost all their rows go.
    """
    spark, schema = new.sparkSession, StructType([*FEATURES.fields, _YEAR])
    with staged(align_schema(new, FEATURES).withColumn("year", F.year("trade_date")), root) as rows:
        onto = versions.version(spark, root)
        done = {r[0] for r in rows.select("ticker").distinct().collect()}
        years = None if start is None else range(date.fromisoformat(str(start)[:10]).year, date.fromisoformat(str(end)[:10]).year + 1)
        gone = {k for k in onto.live if k[0] in done and (years is None or k[1] is not None and int(k[1]) in years)}
        if years is not None:
            rows = range_replaced(versions.read(spark, root, schema, BY_TICKER_YEAR, only=gone.__contains__, at=onto), rows, start, end)
        return versions.commit(rows, root, BY_TICKER_YEAR, ["trade_date"], gone=gone, onto=onto)


def export_by_year(rows: DataFrame, root: str) -> DataFrame:
    """Move a raw table (a relational one, read by date ranges) into the chain store."""
    return upsert_chain(rows, root)
