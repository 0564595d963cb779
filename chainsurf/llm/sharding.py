"""Weighted rendezvous sharding: each record goes to the shard that draws best for its key.

A shard's draw for a key is ``-ln(u) / weight`` with u from the first 52 bits of
``md5(key:shard)``; the smallest draw wins.  The key and the shards decide alone, so
one more shard takes rows only into itself (law ``key``), and a shard of weight w gets
w shares of the keys.

Slots number the rows of a shard from 0 without gaps.  They come from two levels: the
row's number within its cell (one of ``CELLS`` per shard, by md5 of key and content)
plus the rows of the earlier cells, so no task ever holds a whole shard.  Equal rows are
counted before they are dealt out, and become rows again at the end.

Defined cases: a null key draws as the text ``null``; null and empty texts have size 1
and crc 0; repeated rows get different slots of one shard; an empty table gives an
empty result; extra columns are ignored by ``assign``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import let, stored

CELLS = 1024
_BITS = 1 << 52


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The shard's draw for the key: a double above 0, smaller is better."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(_BITS))) / F.lit(float(weight))


def choose(key: Column, weights: list[float]) -> Column:
    """The number of the shard that wins the key; ties go to the smaller number."""
    return F.array_min(F.array(*[F.struct(draw(key, i, w).alias("d"), F.lit(i).alias("s")) for i, w in enumerate(weights)]))["s"]


def choose_and_grow(key: Column, weights: list[float], extra: float = 1.0) -> Column:
    """struct(shard, grown): the winner among the shards, and with one more of weight ``extra``."""
    draws = F.array(*[F.struct(draw(key, i, w).alias("d"), F.lit(i).alias("s")) for i, w in enumerate(weights)])
    more = F.struct(draw(key, len(weights), extra).alias("d"), F.lit(len(weights)).alias("s"))
    return let(F.array_min(draws), lambda best: F.struct(best["s"].alias("shard"), F.least(best, more)["s"].alias("grown")))


def assign(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``."""
    t = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(t.cast("binary"))
    cell = F.conv(F.substring(F.md5(F.concat_ws("/", F.coalesce(F.col(key).cast("string"), F.lit("null")), crc.cast("string"))), 1, 8), 16, 10).cast("bigint") % cells
    rows = docs.select(F.col(key), (F.octet_length(t) + 1).cast("bigint").alias("size"), crc.alias("text_crc32"), choose_and_grow(F.col(key), weights).alias("_to"), cell.cast("int").alias("_cell"))
    rows = rows.select(key, "size", "text_crc32", F.col("_to.shard").alias("shard"), F.col("_to.grown").alias("grown_shard"), "_cell")
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))  # equal rows travel as one
    rows = stored(rows, "shards")
    counts = rows.groupBy("shard", "_cell").agg(F.sum("_n").alias("n"))  # at most shards x cells rows
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "_cell", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum("_n").over(Window.partitionBy("shard", "_cell").orderBy(F.col(key), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_own", own).join(starts, ["shard", "_cell"])
    each = placed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return each.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_own") + F.col("_i")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id") -> None:
    """Write ``docs`` under ``path`` in folders ``shard=<n>``, without moving rows between tasks."""
    docs.withColumn("shard", choose(F.col(key), weights)).write.partitionBy("shard").parquet(path)
