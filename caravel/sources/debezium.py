"""Debezium envelopes to change events with source columns, and change events to Debezium records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .json_parser import b64

#: Source and event columns and where an envelope holds them (fixed values).
SOURCE_COLUMNS = {
    "_system_source_database": ("source", "db"), "_system_source_schema": ("source", "schema"), "_system_source_table": ("source", "table"), "_system_source_transaction_id": ("source", "txId"),
    "_system_source_timestamp_ms": ("source", "ts_ms"), "_system_source_timestamp_us": ("source", "ts_us"), "_system_source_timestamp_ns": ("source", "ts_ns"),
    "_system_event_timestamp_ms": ("ts_ms",), "_system_event_timestamp_us": ("ts_us",), "_system_event_timestamp_ns": ("ts_ns",),
}
#: Stands for a value that the source did not send (fixed value).
UNAVAILABLE = "__debezium_unavailable_value"


def parse(messages: DataFrame) -> DataFrame:
    """message_key_base64, data, op, offset, the source columns, and error (null for a good event) of each envelope.

    A key is required; create and read have an after image only, a delete a before image only, an update an after image. data is the image that
    the operation leaves, or removes. Tombstones must have a key and no value, and give no event. A payload may be wrapped in {schema, payload}.
    """
    text = F.col("value").cast("string")
    root = F.from_json(text, "map<string,variant>")
    held = messages.select("*", F.explode(F.array(root)).alias("_root"))
    payload = F.try_element_at("_root", F.lit("payload"))
    inner = F.when(payload.isNotNull() & ~F.is_variant_null(payload), F.from_json(F.to_json(payload), "map<string,variant>")).otherwise(F.col("_root"))
    held = held.select("*", F.explode(F.array(inner)).alias("_e"))
    get = lambda name: F.try_element_at("_e", F.lit(name))
    there = lambda name: F.coalesce(F.schema_of_variant(get(name)).startswith("OBJECT"), F.lit(False))
    op = F.try_variant_get(get("op"), "$", "string")
    image = F.when(op == "d", get("before")).otherwise(get("after"))
    tombstone = F.coalesce(F.col("tombstone"), F.lit(False))
    empty = F.col("value").isNull() | (F.octet_length("value") == 0)
    error = (
        F.when(tombstone & ~empty, "a tombstone has a value")
        .when(F.col("key").isNull(), "a record needs its key")
        .when(tombstone, F.lit(None))
        .when(F.col("_e").isNull(), "not an envelope")
        .when(op.isNull() | ~op.isin("c", "r", "u", "d"), "unknown operation")
        .when(op.isin("c", "r") & (there("before") | ~there("after")), "a create has an after image only")
        .when((op == "u") & ~there("after"), "an update has an after image")
        .when((op == "d") & (there("after") | ~there("before")), "a delete has a before image only")
        .when(F.to_json(image).contains(f'"{UNAVAILABLE}"'), "a value is unavailable")
    )
    columns = []
    for name, path in SOURCE_COLUMNS.items():
        kind = "string" if name.startswith("_system_source_") and path[-1] in ("db", "schema", "table") else "bigint"
        columns.append(F.try_variant_get(get(path[0]), "$" + "".join(f".{p}" for p in path[1:]), kind).alias(name))
    out = held.select("topic", "partition", "offset", F.explode(F.array(F.struct(error.alias("error"), tombstone.alias("gone"), b64(F.col("key")).alias("message_key_base64"), F.to_json(image).alias("data"), op.alias("op"), *columns))).alias("_o"))
    return out.where("not _o.gone or _o.error is not null").select("topic", "partition", "offset", "_o.*").drop("gone")


def envelope(op: Column, before: Column, after: Column, source: Column, ts_ms: Column, transaction: Column | None = None) -> Column:
    return F.to_json(F.struct(before.alias("before"), after.alias("after"), source.alias("source"), op.alias("op"), ts_ms.alias("ts_ms"), (transaction if transaction is not None else F.lit(None).cast("string")).alias("transaction")), {"ignoreNullFields": "false"})


def image(values: list[str], mask: str | None = None) -> Column:
    """The row image; values of columns that the mask (an array of booleans) leaves out are the marker of unavailable ones."""
    if mask is None:
        return F.struct(*values)
    return F.struct(*[F.when(F.col(mask)[i], F.col(v).cast("string")).otherwise(F.lit(UNAVAILABLE)).alias(v) for i, v in enumerate(values)])


def emit(events: DataFrame, keys: list[str], values: list[str], old_keys: list[str] | None = None, op: str = "op", version: str = "version", mask: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """(key, value, part) records of change events, in the order of part within an event; a null value is a tombstone.

    A delete is followed by a tombstone. An update that moves the key is a delete of the old key, its tombstone, and a create. A record beyond
    max_bytes stops the job.
    """
    key_of = lambda names: F.to_json(F.struct(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)]))
    source = F.struct(F.lit("caravel").alias("connector"))
    none = F.lit(None).cast("string")
    row = lambda o, before, after: envelope(o, before, after, source, F.col(version))
    full = image([*keys, *values], None)
    own = image(values, mask) if mask else full
    record = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    key = key_of(keys)
    before_own = F.struct(*[F.col(k).alias(k) for k in keys])
    deleted = [record(key, row(F.lit("d"), before_own, none)), record(key, none)]
    plain = F.array(record(key, row(F.col(op), none, own)))
    parts = F.when(F.col(op) == "d", F.array(*deleted))
    if old_keys:
        moved = F.lit(False)
        for k, o in zip(keys, old_keys, strict=True):
            moved = moved | (F.col(o).isNotNull() & ~F.col(o).eqNullSafe(F.col(k)))
        old = key_of(old_keys)
        before_old = F.struct(*[F.col(o).alias(k) for k, o in zip(keys, old_keys, strict=True)])
        parts = parts.when((F.col(op) == "u") & moved, F.array(record(old, row(F.lit("d"), before_old, none)), record(old, none), record(key, row(F.lit("c"), none, full))))
    out = events.select(*[c for c in (version,) if c in events.columns], F.posexplode(parts.otherwise(plain)).alias("part", "_r")).select(version, "part", "_r.key", "_r.value")
    if max_bytes is not None:
        size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
        out = out.withColumn("value", F.when(size <= max_bytes, F.col("value")).otherwise(F.raise_error(F.lit(f"a record is larger than {max_bytes} bytes"))))
    return out
