"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all work runs on this machine, as in tests, a new temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Folders of the tables stored inside the innermost ``scratch``; None outside of any.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("_SCRATCH", default=None)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it: this cuts its lineage."""
    path = new_path(df.sparkSession, what)
    if _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more, so that a run holds few of them at once."""
    for df in tables:
        delete(df.sparkSession, df._folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside go at the end, also of a failed run, but for those handed to what it yields.

    What is kept belongs to the scratch around this one, if there is one.
    """
    held, kept = [], set()
    outer = _SCRATCH.set(held)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._folder)
        return df

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _SCRATCH.reset(outer)
        for folder in held:
            if folder not in kept:
                delete(spark, folder)
        if _SCRATCH.get() is not None:
            _SCRATCH.get().extend(kept)


def let(value, body):
    """SQL ``let``: evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str):
    """With the id, the name of a row by its content."""
    return F.xxhash64(F.col(text).cast("string"))


def presence(ids: DataFrame, words: int = 1 << 17) -> DataFrame:
    """A presence filter of fixed size over the one long column of ``ids``.

    At most ``words`` rows (slot, bits): each id sets one of 64 * words bits, so the
    table has at most 2 MB whatever the input is and may be broadcast.  It answers
    "maybe present"; it never loses an id.
    """
    spot = F.xxhash64(F.col(ids.columns[0]))
    return (
        ids.select(F.pmod(spot, F.lit(words)).cast("int").alias("slot"), F.pmod(F.shiftright(spot, 40), F.lit(64)).cast("int").alias("bit"))
        .groupBy("slot")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )


def maybe_present(df: DataFrame, key: str, filter_table: DataFrame, words: int = 1 << 17, present: bool = True) -> DataFrame:
    """The rows of ``df`` whose key may be in the ids of ``presence`` (or surely is not); no shuffle of ``df``."""
    spot = F.xxhash64(F.col(key))
    return (
        df.withColumn("_slot", F.pmod(spot, F.lit(words)).cast("int"))
        .withColumn("_bit", F.pmod(F.shiftright(spot, 40), F.lit(64)).cast("int"))
        .join(F.broadcast(filter_table), F.expr("_slot = slot AND (shiftright(bits, _bit) & 1) = 1"), "left_semi" if present else "left_anti")
        .drop("_slot", "_bit")
    )
