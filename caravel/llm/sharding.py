"""Two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly into memory-sized buckets by seeded hashes. Pass two puts each bucket in memory, permutes it with
Fisher-Yates (Spark's shuffle() of an array) and gives each record its place in the order of all buckets. Shards are equal ranges of that
order, so their row counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions


def shard(df: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20, replayable: bool = False) -> DataFrame:
    """(doc_id, text, bucket, shard, slot) for every row of df, repeated rows too; slot counts from 0 in each shard without gaps.

    Nulls stay null and are records like others; a bucket holds about bucket_bytes of text, but at least one row. Other columns are
    ignored; an empty table gives no rows. Records are told apart by their place in df, which must not change when df is
    read again: replayable says so (files, a checkpoint); else df is first written to the shared folder. A copy with the same id and text is scattered like any other record.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = df.sparkSession
    if not replayable:
        df = materialize(df.select(id_col, text_col), "records")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    buckets = max(4 * partitions(spark), math.ceil((total["b"] + 64 * total["n"]) / bucket_bytes))
    draw = F.xxhash64(F.lit(seed), "place", "id")
    scattered = rows.withColumns({"bucket": F.pmod(draw, F.lit(buckets)).cast("int"), "draw": F.xxhash64(F.lit(seed + 1), "place", "id")})
    counts = scattered.groupBy("bucket").agg(F.count("*").cast("int").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One short row a bucket; sorted within partitions, so that a repeated task draws the same permutations.
    permuted = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket")
        .select("bucket", "before", F.shuffle(F.sequence(F.lit(0), F.col("n") - 1), seed).alias("slots"))
    )
    gathered = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("draw", "place", "id", "text"))).alias("records"))
    placed = gathered.join(permuted, "bucket").select("bucket", "before", F.inline(F.arrays_zip("records", "slots")))
    n = max(1, total["n"])
    at = F.col("before") + F.col("slots")
    return placed.select(F.col("records.id").alias("doc_id"), F.col("records.text").alias("text"), "bucket", at.alias("at")).select(
        "doc_id", "text", "bucket", F.expr(f"cast((at * {n_shards}L) div {n}L as int)").alias("shard"), F.expr(f"at - (((at * {n_shards}L) div {n}L) * {n}L + {n_shards - 1}L) div {n_shards}L").alias("slot")
    )
