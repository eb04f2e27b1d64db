"""Deterministic generated tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of the log preset (fixed values): constants, and those of rows 1 and 2 of each three.
LOG = {
    "dc": "logs.example.net", "dst_type": "ydb", "host": "worker-135.compute.example.net", "id": "dtth5g2ssbu0jrr88fe9", "job_id": "191f7211-e42e2e24-3f60384-1001405", "level": "INFO", "revision": "20729271",
    "runtime": "yt", "src_type": "lf", "ts": "2026-08-22T08:29:37.215+0300", "yt_operation_id": "d94589b8-3c75384f-3f603e8-cb56576a", "additional_properties": "{}",
}
CALLERS = ("pqv1/commit_latency_logger.go:80", "bufferer/bufferer.go:213", "stats/sink_wrapper.go:98")
MESSAGES = ("Ack: [115113], durations: [199.030424ms]", "Flush is triggered by interval", "Sink committed 200 row events in 103.061381ms with 238.60779ms - 456.60789ms lag")
FIRST_FLUSH = 185_528
#: Constants of the 64-bit mixer (fixed values, public).
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def numeric(spark: SparkSession, columns: int, rows: int, start_row: int = 0) -> DataFrame:
    """column_k = row XOR (k - 1)."""
    row = F.col("id")
    return spark.range(start_row, start_row + rows).select(*[row.bitwiseXOR(F.lit(k - 1)).alias(f"column_{k}") for k in range(1, columns + 1)])


def transfer_logs(spark: SparkSession, rows: int, start_row: int = 0) -> DataFrame:
    """Log records of three kinds in turn, with the coordinates of their messages."""
    if start_row + rows > 2**63 - FIRST_FLUSH:
        raise ValueError("the rows go beyond 64-bit numbers")
    row, kind = F.col("id"), F.col("id") % 3
    pick = lambda values: F.when(kind == 0, values[0]).when(kind == 1, values[1]).otherwise(values[2])
    own = {
        "caller": pick(CALLERS), "data_row_events": F.when(kind == 2, F.lit(200).cast("bigint")), "events": F.when(kind == 2, F.lit(200).cast("bigint")), "flush_num": F.when(kind == 1, row + FIRST_FLUSH),
        "job_index": F.lit(1).cast("bigint"), "lag": F.when(kind == 2, F.lit(0.45661641)), "len": F.when(kind == 1, F.lit(200).cast("bigint")), "msg": pick(MESSAGES), "size": F.when(kind == 1, "858 kB"), "trigging_interval": F.when(kind == 1, "333ms"),
    }
    order = ("caller", "data_row_events", "dc", "dst_type", "events", "flush_num", "host", "id", "job_id", "job_index", "lag", "len", "level", "msg", "revision", "runtime", "size", "src_type", "trigging_interval", "ts", "yt_operation_id", "additional_properties")
    columns = [(own[n] if n in own else F.lit(LOG[n])).alias(n) for n in order]
    system = [F.lit("cdc/prod/logs").alias("_system_topic"), F.lit(0).cast("bigint").alias("_system_partition"), row.alias("_system_offset"), F.lit(0).cast("decimal(20,0)").alias("_system_message_index")]
    return spark.range(start_row, start_row + rows).select(*columns, *system)


def mix64(row: Column) -> Column:
    """The public 64-bit mixer of a row number. Spark's own products do not wrap around, numpy's do."""

    def run(rows: pa.Array) -> pa.Array:
        z = rows.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return pa.array((z ^ (z >> np.uint64(31))).view(np.int64))

    return F.arrow_udf(run, "bigint")(row)


def hits(spark: SparkSession, rows: int, start_row: int = 0) -> DataFrame:
    """Web hits whose values are drawn by the mixer: a generated table in the shape of the click benchmark, of its own distribution."""
    base = spark.range(start_row, start_row + rows).select(F.col("id").alias("WatchID"), *[mix64(F.col("id") * 8 + k).alias(f"m{k}") for k in range(5)])
    unit = lambda k: F.shiftrightunsigned(F.col(f"m{k}"), 11) / F.lit(float(1 << 53))
    return base.select(
        "WatchID", F.timestamp_seconds(F.lit(1_372_636_800) + F.floor(unit(0) * 2_678_400)).alias("EventTime"), F.pmod("m1", F.lit(10_000)).cast("int").alias("CounterID"), F.pmod("m2", F.lit(1_000_000)).alias("UserID"),
        F.floor(F.pow(unit(3), 3) * 2_000).cast("int").alias("ResolutionWidth"), F.concat(F.lit("http://example.com/"), F.hex(F.pmod("m4", F.lit(65_536)))).alias("URL"),
    )


def all_types(spark: SparkSession, rows: int, start_row: int = 0) -> DataFrame:
    """A column of each type that a table can hold, from the row number; every seventh row is null."""
    n = F.col("id")
    columns = {
        "boolean": n % 2 == 0, "int8": (n % 128).cast("tinyint"), "int16": (n % 32_768).cast("smallint"), "int32": (n % 2**31).cast("int"), "int64": n, "uint8": (n % 256).cast("smallint"), "uint16": (n % 65_536).cast("int"),
        "uint32": (n % 2**32).cast("bigint"), "uint64": n.cast("decimal(20,0)"), "float32": (n / 4).cast("float"), "float64": n / 8, "decimal128": (n / 100).cast("decimal(38,2)"), "utf8": n.cast("string"), "binary": n.cast("string").cast("binary"),
        "date32": F.date_add(F.lit("1970-01-01").cast("date"), (n % 20_000).cast("int")), "timestamp": F.timestamp_micros(n), "timestamp_ntz": F.timestamp_micros(n).cast("timestamp_ntz"),
        "list": F.array(n, n + 1), "struct": F.struct(n.alias("a"), n.cast("string").alias("b")), "map": F.create_map(n.cast("string"), n),
    }
    return spark.range(start_row, start_row + rows).select(n.alias("id"), *[F.when(n % 7 != 6, c).alias(k) for k, c in columns.items()])


def messages(events: DataFrame) -> DataFrame:
    """Events as raw JSON messages with topic, partition and offset; every 17th is malformed."""
    from pyspark.sql import Window

    part = F.pmod("user_id", F.lit(4))
    body = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    return events.select(
        F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(body).cast("binary").alias("value"), F.lit(False).alias("tombstone"), F.lit("events").alias("topic"), part.alias("partition"),
        (F.row_number().over(Window.partitionBy(part).orderBy("event_id")) - 1).cast("long").alias("offset"), "event_id",
    )


def stream(spark: SparkSession, rows_per_second: int, preset: str = "numeric") -> DataFrame:
    """An unbounded generated table: row numbers at a rate."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    if preset != "numeric":
        raise ValueError(f"unknown stream preset {preset}")
    return rate.select(*[F.col("value").bitwiseXOR(F.lit(k - 1)).alias(f"column_{k}") for k in range(1, 5)], "timestamp")
