"""The merges fed by a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import RANK, upsert_chain, upsert_ranked
from ..sources.payloads import ingest_history, ingest_snapshot

LANDING = "ticker string, requested_date date, payload string"
#: ``kind`` is history or snapshot; ``run_date`` is the day of the refresh that fetched the payload, ``requested_date`` the day it is of.
ARRIVALS = "ticker string, requested_date date, kind string, run_date date, payload string"


def read_landing(spark: SparkSession, path: str, files_per_trigger: int = 100, schema: str = LANDING) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def merge_landing(landing: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of history payloads into the chain store, then stop when all files are in.

    The merge is idempotent, so a batch that is run again after a failure changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        upsert_chain(ingest_history(batch), root)

    return landing.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ranked_rows(arrivals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Chain rows of landed payloads with the ``rank`` that a daily refresh gives them.

    A later run ranks above an earlier one, and a run's snapshot above its history.  A
    payload that landed twice counts once; rows of one contract are summed within a rank.
    """
    rank = F.unix_date("run_date").cast("long") * 2 + F.when(F.col("kind") == "snapshot", 1).otherwise(0)
    once = arrivals.dropDuplicates(["ticker", "requested_date", "kind", "run_date", "payload"]).withColumn(RANK, rank)
    history = once.filter("kind = 'history'").select("ticker", "requested_date", RANK, "payload")
    snapshots = once.filter("kind = 'snapshot'").select("ticker", F.col("requested_date").alias("taken_on"), RANK, "payload")
    return ingest_history(history).unionByName(ingest_snapshot(snapshots, calendar))


def merge_arrivals(arrivals: DataFrame, root: str, calendar: DataFrame, checkpoint: str) -> StreamingQuery:
    """Merge history and snapshot payloads, whatever the order of their micro-batches, then stop when all files are in.

    The store holds the rank of each row, so what a payload overwrites depends on the runs
    and not on the order of arrival; and each micro-batch is one commit, which a replay
    repeats without changing anything.  So every payload has its effect exactly once.
    """

    def merge(batch: DataFrame, _: int) -> None:
        upsert_ranked(ranked_rows(batch, calendar), root)

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
