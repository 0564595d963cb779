"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, classifier, conversations, decontaminate, licenses, main_text, near_duplicates, pieces, quality_rules, sharding, substrings, url_filters, warc
from .shared import table


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 4).alias("p_good"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    hosts = spark.createDataFrame([(h,) for h in url_filters.BLOCKED_HOSTS], "host string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules, blocked=hosts)


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * 16)


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.judge(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op5_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "documents"))


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest form of encoding and decoding: scores and digests of the three best segmentations stand in columns."""
    found = pieces.encode_digest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_pieces", "score", F.get("scores", F.lit(1)).alias("second_score"), F.get("scores", F.lit(2)).alias("third_score"), "ids_sha256", F.get("nbest_sha256", F.lit(1)).alias("second_sha256"), F.get("nbest_sha256", F.lit(2)).alias("third_sha256"), "round_trip")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op12_host_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece_nbest,
        op2_benchmark_decontamination,
        op3_license_scans,
        op4_recompression,
        op5_bottom_k_near_duplicates,
        op6_quality_rules,
        op7_quality_classifier,
        op8_url_filters,
        op9_warc,
        op10_rendezvous_sharding,
        op11_conversation_repair,
        op12_host_suffix_arrays,
        op13_centroid_clustering,
    )
}
