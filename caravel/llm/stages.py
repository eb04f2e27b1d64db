"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir), and all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, discard_since, keyed, materialize, table, written
from .decontamination import decontaminated
from .jaccard import jaccard_join
from .packing import pack
from .suffix_dedup import suffix_array_dedup
from .toxicity import SCORE, toxicity

KEY = ("_caravel_id", "_caravel_t")


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({KEY[0]: F.coalesce("doc_id", F.lit(NULL_ID)), KEY[1]: F.xxhash64(text)})


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a score of one half or more; documents without a text have nothing toxic and stay. A score of one half to the last
    bit is that of all documents where labels of both classes are missing: nothing is known there, and nothing is rejected."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where((F.col(SCORE) <= 0.5) | (F.coalesce(F.octet_length("text"), F.lit(0)) == 0)).drop(SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that links at 0.8; of repeated rows, one."""
    mark = written()
    kept = jaccard_join(keyed(docs), 5, 80).where("first").select(F.col("id").alias(KEY[0]), F.col("t").alias(KEY[1])).distinct()
    kept = materialize(kept, "kept")
    discard_since(mark, kept)
    return _with_key(docs).join(kept, list(KEY), "left_semi").dropDuplicates(list(KEY)).drop(*KEY)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 100 that start earlier too; a character that is cut in two goes whole. n_chars follows the text."""
    out = suffix_array_dedup(docs, length=100, keep_columns="_caravel_cut")
    cut = F.col("_caravel_cut").isNotNull()
    kept = F.col("_caravel_cut.kept_text")
    return out.withColumns({"text": F.when(cut, kept).otherwise(F.col("text")), "n_chars": F.when(cut, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item, exactly or edited."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return pack(docs, 2048)


STAGES = [("toxicity", toxic), ("jaccard_join", near_duplicates), ("suffix_array_dedup", repeats), ("decontamination", leaks), ("packing", packed)]
