"""Shared helpers of the corpus operators: tables, the shared folder, document keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of one word: the six ASCII white-space characters separate words.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null document id inside the operators: smaller than every other id.
NULL_ID = -(2**63)

#: Bytes of one Arrow batch between Spark and a Python worker, where the session sets no limit of its own.
BATCH_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a session within one JVM may leave it unset: it gets a
    folder of its own, which no other machine needs to see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="caravel-checkpoints-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: its folder goes with the application's
            return


def discard(df: DataFrame) -> None:
    """Removes a table that materialize() wrote and nothing reads any more."""
    own = (df.sparkSession, df._written_to)
    _remove(*own)
    _written.remove(own)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes a table in the shared folder and reads it back, so that a lost executor never repeats what came before. The
    shuffle files that led to the table go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def written() -> int:
    """A mark for discard_since()."""
    return len(_written)


def discard_since(mark: int, *keep: DataFrame) -> None:
    """Removes the tables written since a mark but those to keep."""
    kept = {df._written_to for df in keep}
    for own in [x for x in _written[mark:] if x[1] not in kept]:
        _remove(*own)
        _written.remove(own)


def bounded(spark: SparkSession) -> None:
    """Arrow batches by bytes, not by rows alone, so that long texts make no large batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, text): the operators' own columns, so that others in the input cannot clash.

    id is the document id (NULL_ID for null), text the text (empty for null) and t 64 bits of the text's hash. Rows that agree in
    id and text are one document to the operators; rows with one id and different texts are ordered by t.
    """
    bounded(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.xxhash64(text).alias("t"),
        text.alias("text"),
    )


def doc_id(c: str | Column = "id") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != NULL_ID, c)


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
