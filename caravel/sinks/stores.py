"""Sinks: objects of rows, replayable NDJSON, and changes merged into tables of files. All survive a repeated batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.serializers import ndjson
from ..operators.changelog import apply_to_state, unmatched
from .partitioning import object_key

CODECS = ("uncompressed", "snappy", "gzip", "zstd")


def files(spark: SparkSession):
    """Small files of a store that Spark can reach."""
    return _Files(spark)


class _Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _of(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._of(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """False if it is there already: two writers never both succeed where the store creates files atomically."""
        fs, p = self._of(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def list(self, path: str) -> list[tuple[str, int]]:
        """(name, bytes) of the files of a folder and below, by name."""
        fs, p = self._of(path)
        if not fs.exists(p):
            return []
        found, it = [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            found.append((s.getPath().toString(), s.getLen()))
        return sorted(found)

    def delete(self, path: str) -> None:
        fs, p = self._of(path)
        fs.delete(p, True)


def write_parquet(df: DataFrame, root: str, table: str, delivery: int, codec: str = "zstd", max_rows: int = 1_000_000, max_bytes: int | None = None, row_bytes: int | None = None) -> None:
    """root/table/partition=P/delivery=D/…: append-only objects of at most max_rows rows, and of max_bytes at row_bytes a row. A repeated delivery
    replaces its own objects and no others."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec}")
    limit = max_rows if max_bytes is None else max(1, min(max_rows, max_bytes // max(1, row_bytes or 1)))
    spark, key = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "dynamic")
    try:
        out = df.withColumn("delivery", F.lit(delivery))
        out.write.mode("overwrite").option("compression", codec).option("maxRecordsPerFile", limit).partitionBy("partition", "delivery").parquet(f"{root}/{table}")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def objects(rows: DataFrame, prefix: str, table: str, columns: list[str]) -> DataFrame:
    """(key, lines, first_offset, last_offset, body) of each NDJSON object of rows with partition_path, epoch and start_offset. Boundaries depend on
    the data alone, so a repeated batch writes the same objects."""
    line = ndjson(rows.select(*columns))
    keyed = rows.select(object_key(prefix, table).alias("key"), "offset", *(["message_index"] if "message_index" in rows.columns else []), line.alias("line"))
    order = ["offset", *(["message_index"] if "message_index" in rows.columns else [])]
    ordered = F.sort_array(F.collect_list(F.struct(*order, "line")))
    out = keyed.groupBy("key").agg(F.count("*").alias("lines"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), ordered.alias("_rows"))
    return out.select("key", "lines", "first_offset", "last_offset", F.concat(F.array_join(F.transform("_rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("body"))


def write_objects(found: DataFrame, root: str, journal: str, batch: int) -> bool:
    """Writes objects and then the batch's journal entry; False if the journal has the batch, whose objects are then complete."""
    store, entry = files(found.sparkSession), f"{journal}/{batch:020d}.json"
    if store.exists(entry):
        return False
    found.write.mode("overwrite").parquet(f"{root}/batch={batch}")
    summary = found.agg(F.count("*").alias("objects"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).first()
    return store.create(entry, json.dumps({"batch": batch, "objects": summary["objects"], "lines": summary["lines"]}))


class Unmatched(ValueError):
    """Updates found no row."""


def merge(state: DataFrame, collapsed: DataFrame, keys: list[str], values: list[str], mode: str = "changelog") -> DataFrame:
    """The table after collapsed changes. append: all rows are new, a known key is an error; upsert: creates and reads only; update: every row must
    be there; delete: missing rows are tolerated; changelog: each by its op, and updates must find their row."""
    if mode == "append":
        clash = collapsed.join(state.select(*keys), keys, "left_semi").count()
        if clash:
            raise Unmatched(f"{clash} rows are there already")
        return state.select(*keys, *values).unionByName(collapsed.select(*keys, *values))
    forced = {"upsert": "c", "update": "u", "delete": "d"}.get(mode)
    if forced:
        collapsed = collapsed.withColumn("op", F.lit(forced))
    elif mode != "changelog":
        raise ValueError(f"unknown mode {mode}")
    if mode in ("update", "changelog"):
        lost = unmatched(state, collapsed, keys).count()
        if lost:
            raise Unmatched(f"{lost} updates find no row")
    return apply_to_state(state, collapsed, keys, values)


def replacing(collapsed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for a table that keeps the newest row of each key: commit_time = version + 1, delete_time the same for a delete, else 0."""
    at = (F.col("version") + 1).cast("decimal(20,0)")
    return collapsed.select(*[c for c in collapsed.columns if c not in ("op", "version", "pos", "included")], at.alias("commit_time"), F.when(F.col("op") == "d", at).otherwise(F.lit(0)).alias("delete_time"))


def current(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What such a table shows: the newest row of each key, without deleted ones. One shuffle, combined before it."""
    values = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("commit_time")).alias("_r"))
    return newest.where("_r.delete_time = 0").select(*keys, *[F.col(f"_r.{v}").alias(v) for v in values if v not in ("commit_time", "delete_time")])


def row_delta(collapsed: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(equality deletes: every touched key, data rows: all but deletes) of one snapshot."""
    return collapsed.select(*keys), collapsed.where("op <> 'd'").select(*keys, *values)


def commit_replica(spark: SparkSession, root: str, collapsed: DataFrame, keys: list[str], values: list[str], delivery: str, batch: int) -> bool:
    """Merges a batch into the newest version of a table of files, copy on write; False if the batch is committed already.

    Each version has a marker with the delivery and the batch. A batch whose commit is in doubt finds its marker and is not applied again.
    """
    store = files(spark)
    marks = [m for m, _ in store.list(f"{root}/_commits") if m.endswith(".json")]
    last = json.loads(store.read(marks[-1])) if marks else {"version": 0, "batches": {}}
    if last["batches"].get(delivery, -1) >= batch:
        return False
    deletes, data = row_delta(collapsed, keys, values)
    out = data
    if last["version"]:
        out = spark.read.parquet(f"{root}/v{last['version']}").join(deletes, keys, "left_anti").unionByName(data)
    version = last["version"] + 1
    out.write.mode("overwrite").parquet(f"{root}/v{version}")
    if not store.create(f"{root}/_commits/{version:020d}.json", json.dumps({"version": version, "batches": {**last["batches"], delivery: batch}})):
        raise RuntimeError("another writer committed this version")
    return True


def bulk(rows: DataFrame, index: str, keys: list[str], op: str | None = None, routing: str | None = None) -> DataFrame:
    """(id, action, document) of a search store's bulk request: the id joins the key's parts, escaped; deletes have no document."""
    part = lambda k: F.replace(F.replace(F.col(k).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    identity = F.concat_ws("|", *[part(k) for k in keys])
    target = [F.lit(index).alias("_index"), identity.alias("_id"), *([F.col(routing).alias("routing")] if routing else [])]
    gone = F.col(op) == "d" if op else F.lit(False)
    action = F.when(gone, F.to_json(F.struct(F.struct(*target).alias("delete")))).otherwise(F.to_json(F.struct(F.struct(*target).alias("index"))))
    return rows.select(identity.alias("id"), action.alias("action"), F.when(~gone, ndjson(rows.drop(*[c for c in (op, routing) if c]))).alias("document"))


def records(rows: DataFrame, dataset: str, keys: list[str], topic: str | None = None, prefix: str | None = None) -> DataFrame:
    """(topic, key, value) of message records: a configured topic, or prefix.dataset."""
    if (topic is None) == (prefix is None):
        raise ValueError("either a topic or a prefix")
    return rows.select(F.lit(topic or f"{prefix}.{dataset}").alias("topic"), F.to_json(F.struct(*keys)).alias("key"), ndjson(rows).alias("value"))


def discard(df: DataFrame) -> int:
    """Runs all of df, stores nothing, and says how many rows there were."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def reconcile(baseline: int, written: DataFrame, read_back: Callable[[], DataFrame]) -> dict[str, int]:
    """Baseline plus committed rows must be what the destination holds."""
    committed, final = discard(written), read_back().count()
    if baseline + committed != final:
        raise ValueError(f"{baseline} rows before and {committed} committed, but {final} are there")
    return {"baseline": baseline, "committed": committed, "final": final}


#: What sinks take (fixed values): types they lack, and bytes of a name at most.
LIMITS = {"json": ((T.BinaryType, T.MapType), 255), "columnar": ((T.DayTimeIntervalType, T.YearMonthIntervalType, T.NullType), 255), "relational": ((T.MapType, T.ArrayType, T.StructType), 63)}


def validate(df: DataFrame, sink: str, table: str) -> None:
    """Checks a table's name and columns against a sink's limits before anything runs."""
    lacks, longest = LIMITS[sink]
    names = [table, *df.columns]
    wrong = [n for n in names if not n or len(n.encode()) > longest or "\0" in n]
    wrong += [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if isinstance(f.dataType, lacks)]
    lower = [c.lower() for c in df.columns]
    wrong += sorted({c for c in lower if lower.count(c) > 1})
    if wrong:
        raise ValueError(f"the sink {sink} does not take {wrong}")
