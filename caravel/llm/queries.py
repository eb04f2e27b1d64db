"""The registered queries of the corpus operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import doc_id, keyed, table
from .decontamination import benchmark_hits
from .jaccard import jaccard_join
from .language_model import lm_scores
from .licenses import license_scan
from .packing import pack
from .quality_rules import quality
from .sharding import shard
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_array_dedup
from .toxicity import SCORE, toxicity


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shard(table(spark, sf_dir, "documents"), 40, replayable=True).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), 2048)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    return out.select("doc_id", held_out.alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    out = lm_scores(docs).select("id", "t", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return keyed(docs).select("id", "t").join(out, ["id", "t"]).select(doc_id().alias("doc_id"), "n_tokens", "n_known", "train_tokens", "base_score", "score").withColumn("held_out", held_out)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join(keyed(table(spark, sf_dir, "documents")), 5, 80)
    return out.select(doc_id().alias("doc_id"), "n_shingles", doc_id("component_id").alias("component_id"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: a document's is its source, its language and its id."""
    return license_scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_rules": op8_quality_rules,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_license_scan": op10_license_scan,
}
#: The others have no SQL: what they return is learned, drawn or aligned. Tests hold them against brute force.
ORACLES: dict[str, str] = {"op3_suffix_array_dedup": oracles.OP3, "op6_substring_dedup": oracles.OP6, "op9_jaccard_join": oracles.OP9}
