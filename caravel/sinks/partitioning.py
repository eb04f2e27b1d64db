"""Where rows of an object sink go: partition paths, epochs of rows, and object keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an object key at most (fixed value).
KEY_BYTES = 1024
#: Characters that a path component may not hold (fixed values): separators, controls and those that stores encode.
REFUSED = r"[\x00-\x1F\x7F/\\{}^%`\[\]\"<>~#|*?\r\n]"
#: strftime directives and Spark's patterns (fixed values).
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "p": "a", "I": "hh"}
SCALARS = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
#: The order in which rows are routed (fixed values).
ROUTING = ("topic", "partition", "offset", "message_index")


def component(c: Column, label: str) -> Column:
    """A path component as it is; an empty, relative or illegal one stops the job, nothing is encoded."""
    bad = c.isNull() | (c == "") | c.isin(".", "..") | c.rlike(REFUSED)
    return F.when(~bad, c).otherwise(F.raise_error(F.concat(F.lit(f"{label} is no path component: "), F.coalesce(c, F.lit("null")))))


def source_path(topic: str = "topic", partition: str = "partition") -> Column:
    return F.concat(F.lit("topic="), component(F.col(topic), "topic"), F.lit("/partition="), F.col(partition).cast("string"))


def fields_path(df: DataFrame, names: list[str]) -> Column:
    """name=value/…; a null value and a type that is no scalar are errors."""
    parts = []
    for n in names:
        kind = df.schema[n].dataType
        if not isinstance(kind, SCALARS):
            raise ValueError(f"{n} cannot partition: {kind.simpleString()}")
        if re.search(REFUSED, n):
            raise ValueError(f"{n} is no path component")
        text = F.when(F.col(n), "true").otherwise("false") if isinstance(kind, T.BooleanType) else F.col(n).cast("string")
        parts.append(F.concat(F.lit(f"{n}="), component(F.when(F.col(n).isNotNull(), text), n)))
    return F.concat_ws("/", *parts)


def spark_time_pattern(path: str) -> str:
    out = ""
    for directive, literal in re.findall(r"%(.)|([^%]+)", path):
        if literal:
            out += re.sub(r"([A-Za-z]+)", r"'\1'", literal)
        elif directive in STRFTIME:
            out += STRFTIME[directive]
        else:
            raise ValueError(f"unsupported directive %{directive}")
    return out


def record_time_path(ms: Column, window_ms: int, path: str = "%Y/%m/%d/%H", zone: str = "UTC") -> Column:
    """The tumbling slot of a record in a time zone, as a path; a null time stops the job. The session's zone has no effect."""
    slot = F.floor(ms / window_ms) * window_ms
    there = F.when(ms.isNotNull(), slot.cast("bigint")).otherwise(F.raise_error(F.lit("the record time is missing")).cast("bigint"))
    wall = F.convert_timezone(F.current_timezone(), F.lit(zone), F.timestamp_millis(there).cast("timestamp_ntz"))
    return F.date_format(wall, spark_time_pattern(path))


def routed(df: DataFrame, path: Column, dlq: str = "is_dlq") -> DataFrame:
    """Adds partition_path and sorts within tasks by topic, partition, offset, message index and dead letter."""
    order = [c for c in (*ROUTING, dlq) if c in df.columns]
    return df.withColumn("partition_path", path).repartition("topic", "partition").sortWithinPartitions(*order)


def epochs(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None, record_ms: int | None = None, size: Column | None = None, time: str = "write_ts_ms", keep_on_path_change: bool = False) -> DataFrame:
    """Adds epoch, the number of each object of a source partition, and start_offset, its first offset.

    An object ends before the row that would take it beyond max_rows, max_bytes or record_ms from its first row, or that has another
    partition path. Rows of a source partition are folded in order, one state at a time, since each limit counts from where the last ended;
    without limits on bytes and time, windows do it.
    """
    order = [F.col(c) for c in ("offset", "message_index") if c in df.columns]
    w = Window.partitionBy("topic", "partition").orderBy(*order)
    changed = F.lit(0) if keep_on_path_change else F.when(F.lag("partition_path").over(w).eqNullSafe(F.col("partition_path")), 0).otherwise(1)
    stretches = df.withColumn("_change", changed).withColumn("_stretch", F.sum("_change").over(w)).drop("_change")
    inner = Window.partitionBy("topic", "partition", "_stretch").orderBy(*order)
    if max_bytes is None and record_ms is None:
        part = F.floor((F.row_number().over(inner) - 1) / max_rows) if max_rows else F.lit(0)
        cut = stretches.withColumn("_part", part)
    else:
        cost = (size if size is not None else F.lit(0)).cast("bigint")
        ordered = stretches.withColumns({"_size": cost, "_ms": F.col(time).cast("bigint") if record_ms is not None else F.lit(0).cast("bigint")})
        ordered = ordered.repartition("topic", "partition").sortWithinPartitions("topic", "partition", "_stretch", *order)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields), "_part long"])
        cut = ordered.mapInArrow(_folded(max_rows, max_bytes, record_ms), schema).drop("_size", "_ms")
    numbered = cut.withColumn("epoch", (F.dense_rank().over(Window.partitionBy("topic", "partition").orderBy("_stretch", "_part")) - 1).cast("bigint"))
    first_of = Window.partitionBy("topic", "partition", "epoch")
    return numbered.withColumn("start_offset", F.min("offset").over(first_of)).drop("_stretch", "_part")


def _folded(max_rows: int | None, max_bytes: int | None, record_ms: int | None):
    """Appends the number of each row's object within its stretch to sorted rows; one state is held, whatever the size of a source partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, rows, held, first = None, 0, 0, 0, 0
        for batch in batches:
            out = []
            keys = zip(*(batch[c].to_pylist() for c in ("topic", "partition", "_stretch")), strict=True)
            for own, cost, ms in zip(keys, batch["_size"].to_pylist(), batch["_ms"].to_pylist(), strict=True):
                if own != key:
                    key, part, rows, held, first = own, 0, 0, 0, ms
                elif (max_rows and rows + 1 > max_rows) or (max_bytes is not None and held + cost > max_bytes) or (record_ms is not None and ms - first >= record_ms):
                    part, rows, held, first = part + 1, 0, 0, ms
                rows, held = rows + 1, held + cost
                out.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "_part"])

    return run


def object_key(prefix: str, table: str) -> Column:
    """prefix/table/path/topic+partition+start.json; longer ones than a store takes stop the job."""
    name = F.concat(component(F.col("topic"), "topic"), F.lit("+"), F.col("partition").cast("string"), F.lit("+"), F.col("start_offset").cast("string"), F.lit(".json"))
    key = F.concat_ws("/", *([F.lit(prefix)] if prefix else []), F.lit(table), F.col("partition_path"), name)
    return F.when(F.octet_length(key) <= KEY_BYTES, key).otherwise(F.raise_error(F.lit(f"an object key is longer than {KEY_BYTES} bytes")))
