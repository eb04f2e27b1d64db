"""Parsers, sinks, changelog rules, transforms and generators as queries over the given tables, with DuckDB's SQL for the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.hashes import murmur3
from .middleware import chain
from .operators import changelog, splits
from .operators.identity import Card, TableId, select_tables
from .sinks import partitioning, stores
from .sources import debezium, generator, objects, parsers, registry
from .sources.json_parser import Field, JsonParser, envelope_dlq, parse
from .streaming.state import deduplicated

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def as_messages(df: DataFrame, value, key=None) -> DataFrame:
    """Messages of events: partition and offset from the event's number, so that no shuffle is needed."""
    return df.select(
        value.cast("binary").alias("value"), F.lit(False).alias("tombstone"), (key if key is not None else F.lit(None)).cast("binary").alias("key"), F.lit("account/events").alias("topic"),
        F.pmod("event_id", F.lit(4)).alias("partition"), F.col("event_id").alias("offset"), (F.col("event_id") * 1000).alias("write_ts_ms"),
    )


def body():
    return F.to_json(F.struct("event_id", "event_type", "value"))


# --- JSON documents


@query("SELECT event_id AS id, event_id % 4 AS part, event_id AS \"off\", CAST(0 AS BIGINT) AS idx FROM events UNION ALL SELECT user_id, event_id % 4, event_id, 1 FROM events")
def json_framing_lines(spark, d):
    """Two lines a message, with an empty one between them."""
    v = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit('}\n\n{"id":'), F.col("user_id"), F.lit("}"))
    return parse(as_messages(events(spark, d), v), JsonParser((Field("id", "int64", nullable=False),), system={"partition": "part", "offset": "off", "message_index": "idx"}))[0]


@query("SELECT event_id AS id, CAST(0 AS BIGINT) AS idx FROM events UNION ALL SELECT user_id, 1 FROM events")
def json_framing_array(spark, d):
    v = F.concat(F.lit('[{"id":'), F.col("event_id"), F.lit('},{"id":'), F.col("user_id"), F.lit("}]"))
    return parse(as_messages(events(spark, d), v), JsonParser((Field("id", "int64"),), framing="json_array", system={"message_index": "idx"}))[0]


@query("SELECT event_id AS id, event_type AS kind FROM events")
def json_framing_document(spark, d):
    """A line feed within a document is white space."""
    v = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',\n"kind":"'), F.col("event_type"), F.lit('"}'))
    return parse(as_messages(events(spark, d), v), JsonParser((Field("id", "int64"), Field("kind", "string")), framing="single_document"))[0]


@query("SELECT event_id AS id, CAST(user_id AS BIGINT) AS deep, '{\"b\":[1,' || user_id || ']}' AS inner_ FROM events")
def json_paths(spark, d):
    v = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"a":{"b":[1,'), F.col("user_id"), F.lit("]}}"))
    return parse(as_messages(events(spark, d), v), JsonParser((Field("id", "int64"), Field("deep", "int64", "$.a.b[1]"), Field("inner_", "json", "$.a"))))[0]


@query("SELECT event_id AS \"off\", CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 128 AS TINYINT) END AS i8, CASE WHEN event_id % 4 = 1 THEN CAST(1.5 AS FLOAT) END AS f32, CASE WHEN event_id % 4 = 2 THEN TRUE END AS b FROM events WHERE event_id % 4 < 3")
def json_ranges(spark, d):
    """An int8 beyond its range, a text for a boolean and the like go to the dead letters; here every fourth message does."""
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.concat(F.lit('{"i8":'), F.col("event_id") % 128, F.lit("}"))).when(k == 1, '{"f32":1.5}').when(k == 2, '{"b":true}').otherwise(F.when(F.col("event_id") % 8 == 3, '{"i8":300}').otherwise('{"b":"true"}'))
    return parse(as_messages(events(spark, d), v), JsonParser((Field("i8", "int8"), Field("f32", "float32"), Field("b", "boolean")), system={"offset": "off"}))[0]


@query("SELECT event_id AS \"off\", CASE WHEN event_id % 8 = 3 THEN 'i8 has another type or range' ELSE 'b has another type or range' END AS error_message, event_id * 1000 AS source_write_timestamp_ms FROM events WHERE event_id % 4 = 3")
def json_range_errors(spark, d):
    k = F.col("event_id") % 4
    v = F.when(k < 3, '{"i8":1}').otherwise(F.when(F.col("event_id") % 8 == 3, '{"i8":300}').otherwise('{"b":"true"}'))
    return parse(as_messages(events(spark, d), v), JsonParser((Field("i8", "int8"), Field("b", "boolean")), system={"offset": "off"}))[1].select("off", "error_message", "source_write_timestamp_ms")


@query("SELECT event_id AS id, CAST(event_id AS DECIMAL(12, 2)) + CAST(0.25 AS DECIMAL(12, 2)) AS price FROM events WHERE event_id % 3 <> 0")
def json_decimal(spark, d):
    """Exact decimals from texts; one digit too many is an error, not a rounding."""
    v = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"price":"'), F.col("event_id"), F.when(F.col("event_id") % 3 == 0, ".255").otherwise(".250"), F.lit('"}'))
    return parse(as_messages(events(spark, d), v), JsonParser((Field("id", "int64"), Field("price", "decimal(12,2)"))))[0]


@query("SELECT event_id AS id, epoch_ms(CAST(epoch_ms(ts) AS BIGINT)) AS at, epoch_ms(event_id * 1000) AS ep, CAST(ts AS DATE) AS day FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def json_times(spark, d):
    """A text without an offset is UTC; epochs by unit; a date from a text."""
    e = events(spark, d)
    v = F.to_json(F.struct(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.col("event_id").alias("ep"), F.date_format("ts", "yyyy-MM-dd").alias("day")))
    fields = (Field("id", "int64"), Field("at", "timestamp", time="[year]-[month]-[day]T[hour]:[minute]:[second]Z"), Field("ep", "timestamp", time="s"), Field("day", "date", time="yyyy-MM-dd"))
    out = parse(as_messages(e, v), JsonParser(fields))[0]
    return out.select("id", F.col("at").cast("timestamp_ntz").alias("at"), F.col("ep").cast("timestamp_ntz").alias("ep"), "day")


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE length(event_type) <= 5")
def json_max_length(spark, d):
    v = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    return parse(as_messages(events(spark, d), v), JsonParser((Field("id", "int64"), Field("kind", "string", max_length=5)), on_error="drop"))[0]


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN '{}' ELSE '{\"user_id\":' || user_id || '}' END AS additional_properties FROM events")
def json_unknown_collected(spark, d):
    v = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"id":'), F.col("event_id"), F.lit("}"))).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), "user_id")))
    return parse(as_messages(events(spark, d), v), JsonParser((Field("id", "int64"),), unknown="collect"))[0]


@query("SELECT event_id AS \"off\", 'unknown field user_id' AS error_message FROM events WHERE event_id % 2 = 1")
def json_unknown_refused(spark, d):
    v = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"id":'), F.col("event_id"), F.lit("}"))).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), "user_id")))
    return parse(as_messages(events(spark, d), v), JsonParser((Field("id", "int64"),), unknown="fail", system={"offset": "off"}))[1].select("off", "error_message")


@query("SELECT event_id AS \"off\", 'duplicate key' AS error_message, to_base64(encode('{\"id\":1,\"id\":null}')) AS raw_base64 FROM events WHERE event_id % 5 = 0")
def json_duplicate_key(spark, d):
    v = F.when(F.col("event_id") % 5 == 0, '{"id":1,"id":null}').otherwise('{"id":1}')
    return parse(as_messages(events(spark, d), v), JsonParser((Field("id", "int64"),), system={"offset": "off"}))[1].select("off", "error_message", "raw_base64")


@query("SELECT 'account/events' AS t, event_id % 4 AS p, event_id AS o, CAST(0 AS BIGINT) AS i, event_id * 1000 AS w, event_type AS event_type FROM events")
def json_system_columns(spark, d):
    parser = JsonParser((Field("event_type", "string"),), system={"topic": "t", "partition": "p", "offset": "o", "message_index": "i", "write_timestamp_ms": "w"})
    return parse(as_messages(events(spark, d), body()), parser)[0]


# --- other messages


@query("SELECT event_id AS \"offset\", 'unknown operation' AS error_message, to_base64(encode(event_type)) AS raw_base64, to_base64(encode(CAST(user_id AS VARCHAR))) AS key_base64, '[{\"key\":\"h\",\"value\":\"' || to_base64(encode(event_type)) || '\"},{\"key\":\"h\",\"value\":null}]' AS headers_json, FALSE AS tombstone FROM events WHERE event_id % 10 = 0")
def envelope_dead_letters(spark, d):
    m = as_messages(events(spark, d), F.col("event_type"), F.col("user_id").cast("string"))
    header = lambda v: F.struct(F.lit("h").alias("key"), v.cast("binary").alias("value"))
    m = m.withColumn("headers", F.array(header(F.col("value")), header(F.lit(None)))).withColumn("err", F.when(F.col("offset") % 10 == 0, "unknown operation"))
    return envelope_dlq(m, "err").select("offset", "error_message", "raw_base64", "key_base64", "headers_json", "tombstone")


@query("SELECT event_id AS \"offset\", 'a' || chr(9) || event_type || chr(10) || '\\' AS t, event_id % 2 = 0 AS b, CAST(event_id % 256 AS SMALLINT) AS u FROM events")
def tskv_escapes(spark, d):
    v = F.concat(F.lit("tskv\tt=a\\t"), F.col("event_type"), F.lit("\\n\\\\\tb="), (F.col("event_id") % 2 == 0).cast("string"), F.lit("\tu="), F.col("event_id") % 256)
    m = as_messages(events(spark, d), v).select("value", "offset")
    return parsers.parse_tskv(m, (Field("t", "string"), Field("b", "boolean"), Field("u", "uint8")))


@query("SELECT event_id AS \"offset\", CASE event_id % 6 WHEN 0 THEN 'not a TSKV record' WHEN 1 THEN 'duplicate key' WHEN 2 THEN 'empty key' WHEN 3 THEN 'unknown escape' WHEN 4 THEN 'a has another type or range' END AS error_message FROM events WHERE event_id % 6 < 5")
def tskv_errors(spark, d):
    k = F.col("event_id") % 6
    v = F.when(k == 0, "a=1").when(k == 1, "tskv\ta=1\ta=2").when(k == 2, "tskv\t=1").when(k == 3, "tskv\tb=\\q").when(k == 4, "tskv\ta=x").otherwise("tskv\ta=1")
    return parsers.parse_tskv(as_messages(events(spark, d), v).select("value", "offset"), (Field("a", "int64"), Field("b", "string")), on_error="dlq")[1].select("offset", "error_message")


@query("SELECT 'account/events' AS topic, event_id % 4 AS partition, event_id AS \"offset\", event_id * 1000 AS \"timestamp\", '[{\"key\":\"h\",\"value_base64\":null}]' AS headers, hex(encode(CAST(user_id AS VARCHAR))) AS key_hex, FALSE AS tombstone, CASE WHEN event_id % 3 <> 0 THEN '{\"a\":1}' END AS value, CASE WHEN event_id % 3 = 0 THEN 'not a JSON document' END AS error FROM events")
def raw_with_metadata(spark, d):
    m = as_messages(events(spark, d), F.when(F.col("event_id") % 3 == 0, "{").otherwise('{"a":1}'), F.col("user_id").cast("string"))
    m = m.withColumn("headers", F.array(F.struct(F.lit("h").alias("key"), F.lit(None).cast("binary").alias("value"))))
    out = parsers.raw_to_table(m, "json", timestamp=True, headers=True, key=True)
    return out.select("topic", "partition", "offset", "timestamp", "headers", F.hex("key").alias("key_hex"), "tombstone", "value", "error")


@query("SELECT 'account/events' AS topic, event_id % 4 AS partition, max(event_id) + 1 AS next_offset FROM events GROUP BY event_id % 4")
def discard_messages(spark, d):
    return parsers.discard(as_messages(events(spark, d), body()))


@query("SELECT event_type AS \"table\", count(*) AS n FROM events GROUP BY event_type")
def topic_routing(spark, d):
    """One table per topic, all topics in one pass; a topic's table is the last part of its path."""
    m = events(spark, d).select(F.concat(F.lit("account/"), F.col("event_type")).alias("topic"))
    return m.groupBy(parsers.routed(m, "from_message").alias("table")).agg(F.count("*").alias("n"))


@query("SELECT 'account/click' AS \"table\", count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT 'account/view', count(*) FROM events WHERE event_type = 'view'")
def topic_tables(spark, d):
    m = events(spark, d).select(F.concat(F.lit("account/"), F.col("event_type")).alias("topic"))
    out = parsers.route(m, ["account/click", "account/view"], lambda x: x.agg(F.count("*").alias("n")))
    frames = [f.select(F.lit(name).alias("table"), "n") for name, f in sorted(out.items())]
    return frames[0].unionByName(frames[1])


@query("SELECT * FROM (VALUES ('event_id', 'int64', FALSE), ('event_type', 'string', FALSE), ('k', 'int64', TRUE), ('value', 'float64', FALSE)) t(name, type, nullable)")
def detected_columns(spark, d):
    """What a sample of payloads looks like: a key that only some have is nullable, one of mixed kinds is left out."""
    rows = events(spark, d).orderBy("event_id").limit(20).collect()
    payloads = [json.dumps({"event_id": r["event_id"], "event_type": r["event_type"], "value": float(r["value"]) + 0.5, "mixed": "a" if i else 1} | ({"k": 1} if i % 2 else {})).encode() for i, r in enumerate(rows)]
    return spark.createDataFrame([(f.name, f.type, f.nullable) for f in parsers.detect(payloads)[1]], "name string, type string, nullable boolean")


AVRO = {"type": "record", "name": "event", "fields": [{"name": "event_id", "type": "long"}, {"name": "event_type", "type": ["null", "string"]}, {"name": "value", "type": "double"}]}
PROTO = {1: {"name": "event_id", "type": "sint64"}, 2: {"name": "event_type", "type": "string"}, 3: {"name": "value", "type": "double"}}
JSON_SCHEMA = {"type": "object", "additionalProperties": False, "required": ["event_id"], "properties": {"event_id": {"type": "integer"}, "event_type": {"type": ["string", "null"]}, "value": {"type": "number", "minimum": -1e9, "maximum": 1e9}}}
EVENT_SQL = "SELECT event_id AS \"offset\", event_id, event_type, value, CAST({id} AS BIGINT) AS schema_id FROM events"


@query(EVENT_SQL.format(id=7))
def registry_avro(spark, d):
    """Events written as framed Avro values and read back by their writer schema."""
    return _round_trip(spark, d, 7, lambda r: registry.avro_bytes(AVRO, r, registry.avro_names(AVRO)), registry.avro_decoder(AVRO))


@query(EVENT_SQL.format(id=8))
def registry_protobuf(spark, d):
    return _round_trip(spark, d, 8, lambda r: registry.protobuf_bytes(PROTO, r), registry.protobuf_decoder(PROTO))


@query(EVENT_SQL.format(id=9))
def registry_json_schema(spark, d):
    return _round_trip(spark, d, 9, lambda r: json.dumps(r).encode(), registry.json_decoder(JSON_SCHEMA))


def _round_trip(spark, d, identity, encoder, decoder) -> DataFrame:
    e = events(spark, d).select("event_id", "event_type", "value")
    m = registry.encode(e, identity, encoder, "body").select(F.lit("t").alias("topic"), F.lit(0).cast("long").alias("partition"), F.col("event_id").alias("offset"), F.col("body").alias("value"))
    return registry.decode(m, {identity: decoder}, {"event_id": "bigint", "event_type": "string", "value": "double"}).where("error is null").select("offset", "event_id", "event_type", "value", "schema_id")


@query("SELECT event_id AS \"offset\", CASE event_id % 3 WHEN 0 THEN 'no schema id' WHEN 1 THEN 'unknown schema 5' END AS error, CASE WHEN event_id % 3 = 1 THEN 5 WHEN event_id % 3 = 2 THEN 8 END::BIGINT AS schema_id FROM events")
def registry_schemas(spark, d):
    """Every message has its own writer schema: none, one that is not registered, or a known one."""
    k = F.col("event_id") % 3
    v = F.when(k == 0, F.lit(bytearray(b"zz"))).when(k == 1, F.lit(bytearray(registry.frame(5, b"")))).otherwise(F.lit(bytearray(registry.frame(8, registry.protobuf_bytes(PROTO, {"event_id": 1})))))
    m = as_messages(events(spark, d), v)
    return registry.decode(m, {8: registry.protobuf_decoder(PROTO)}, {"event_id": "bigint"}, ["offset"]).select("offset", "error", "schema_id")


# --- changes


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as valid changes of ten thousand keys: c for a key's first event and after deletes, d for errors, else u that sets one of two values."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = events(spark, sf_dir).withColumn("gone", F.col("event_type") == "error")
    before = F.lag("gone").over(w)
    op = F.when(F.col("gone") & before.isNotNull() & ~before, "d").when(before.isNull() | before, "c").otherwise("u")
    return e.withColumn("op", op).withColumn("op", F.when(F.lag("op").over(w) == "d", "c").otherwise(F.col("op"))).select("user_id", "op", F.col("event_id").alias("pos"), F.col("event_id").alias("version"), F.col("event_type").alias("a"), F.col("value").alias("b"), (F.col("event_id") % 2 == 0).alias("sets_a"))


CHANGES = """WITH e AS (SELECT *, event_type = 'error' AS gone FROM events), l AS (SELECT *, lag(gone) OVER (PARTITION BY user_id ORDER BY event_id) AS bf FROM e),
o AS (SELECT *, CASE WHEN gone AND bf IS NOT NULL AND NOT bf THEN 'd' WHEN bf IS NULL OR bf THEN 'c' ELSE 'u' END AS op0 FROM l),
ch AS (SELECT user_id, CASE WHEN lag(op0) OVER (PARTITION BY user_id ORDER BY event_id) = 'd' THEN 'c' ELSE op0 END AS op, event_id AS pos, event_id AS version, event_type AS a, value AS b, event_id % 2 = 0 AS sets_a FROM o)"""
MASKED = f"""{CHANGES}, m AS (SELECT *, op = 'c' OR (op = 'u' AND sets_a) AS ha, op = 'c' OR (op = 'u' AND NOT sets_a) AS hb FROM ch WHERE user_id % 2 = 0 OR op <> 'c'),
k AS (SELECT user_id, arg_max(op, pos) AS lastop, CASE WHEN count(*) FILTER (WHERE op = 'c') > 0 THEN 'c' ELSE 'u' END AS made, arg_max({{'v': a}}, pos) FILTER (WHERE ha) AS a, arg_max({{'v': b}}, pos) FILTER (WHERE hb) AS b, max(pos) AS pos FROM m GROUP BY user_id),
col AS (SELECT user_id, CASE WHEN lastop = 'd' THEN 'd' ELSE made END AS op, CASE WHEN lastop <> 'd' THEN a.v END AS a, CASE WHEN lastop <> 'd' THEN b.v END AS b, lastop <> 'd' AND a IS NOT NULL AS ina, lastop <> 'd' AND b IS NOT NULL AS inb, pos FROM k)"""


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed changes, those of odd keys without their creates: updates of rows that were there before."""
    ch = changes(spark, sf_dir).where("user_id % 2 = 0 or op <> 'c'")
    return changelog.collapse(ch, ["user_id"], ["a", "b"], masks={"a": F.col("sets_a"), "b": ~F.col("sets_a")}, presence=True)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id").distinct().select("user_id", F.lit("old").alias("a"), F.lit(-1.0).alias("b"))


STATE = "st AS (SELECT DISTINCT user_id, 'old' AS a, CAST(-1 AS DOUBLE) AS b FROM events)"


@query(f"{MASKED} SELECT user_id, op, a, b, ina, inb FROM col")
def changelog_masked(spark, d):
    return masked(spark, d).select("user_id", "op", "a", "b", F.get("included", F.lit(0)).alias("ina"), F.get("included", F.lit(1)).alias("inb"))


@query(f"{MASKED}, {STATE} SELECT st.user_id, CASE WHEN op IS NULL OR (op = 'u' AND NOT ina) THEN st.a ELSE col.a END AS a, CASE WHEN op IS NULL OR (op = 'u' AND NOT inb) THEN st.b ELSE col.b END AS b FROM st LEFT JOIN col USING (user_id) WHERE op IS NULL OR op <> 'd'")
def changelog_masked_apply(spark, d):
    """A value that an update does not set stays what it was."""
    return changelog.apply_to_state(state(spark, d), masked(spark, d), ["user_id"], ["a", "b"])


@query(f"{MASKED}, {STATE} SELECT user_id, op, CASE WHEN op = 'u' AND NOT ina THEN st.a ELSE col.a END AS a, CASE WHEN op = 'u' AND NOT inb THEN st.b ELSE col.b END AS b FROM col JOIN st USING (user_id)")
def changelog_restore(spark, d):
    """Full images: what an update leaves out comes from the current row."""
    return changelog.restore(state(spark, d), masked(spark, d), ["user_id"], ["a", "b"]).select("user_id", "op", "a", "b")


@query(f"{MASKED} SELECT user_id FROM col WHERE op = 'u' AND user_id % 4 = 1")
def changelog_unmatched(spark, d):
    """Updates whose row the state lacks."""
    return changelog.unmatched(state(spark, d).where("user_id % 4 <> 1"), masked(spark, d), ["user_id"]).select("user_id")


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'unknown operation' WHEN 1 THEN 'null key' WHEN 2 THEN 'bad version' WHEN 3 THEN 'bad mask' WHEN 4 THEN 'a create sets all columns' END AS reason FROM events WHERE event_id % 7 < 5")
def changelog_errors(spark, d):
    k = F.col("event_id") % 7
    e = events(spark, d).select("event_id", F.when(k != 1, F.col("event_id")).alias("id"), F.when(k == 0, "x").otherwise("c").alias("op"), F.col("event_id").alias("pos"), F.when(k == 2, -1).otherwise(1).cast("long").alias("version"), F.when(k == 3, F.lit(bytearray([7]))).when(k == 4, F.lit(bytearray([1]))).otherwise(F.lit(bytearray([3]))).alias("mask"))
    return changelog.errors(e, ["id"], mask="mask", width=2).select("event_id", "reason")


@query("SELECT user_id AS id, 'd' AS op, 2 * event_id AS pos FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id + 1000000, 'c', 2 * event_id + 1 FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id, 'u', 2 * event_id + 1 FROM events WHERE event_id % 3 <> 0")
def changelog_key_moves(spark, d):
    moved = F.col("event_id") % 3 == 0
    e = events(spark, d).select(F.when(moved, F.col("user_id") + 1_000_000).otherwise(F.col("user_id")).alias("id"), F.col("user_id").alias("old"), F.lit("u").alias("op"), F.col("event_id").alias("pos"), F.lit(bytearray([3])).alias("mask"))
    return changelog.split_key_moves(e, "id", "old", mask="mask", width=2).select("id", "op", "pos")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id END AS id, CASE WHEN event_id % 2 = 0 THEN 'd' ELSE 'c' END AS op FROM events")
def changelog_old_keys(spark, d):
    """A delete's key is its old one."""
    gone = F.col("event_id") % 2 == 0
    e = events(spark, d).select("event_id", F.when(~gone, F.col("event_id")).alias("id"), F.when(gone, F.col("user_id")).alias("old"), F.when(gone, "d").otherwise("c").alias("op"))
    return changelog.old_keys(e, ["id"], ["old"]).select("event_id", "id", "op")


@query(f"{CHANGES} SELECT user_id, pos, CASE WHEN op = 'u' THEN 'c' ELSE op END AS op FROM ch")
def changelog_full_image_upserts(spark, d):
    ch = changes(spark, d).withColumn("old", F.col("user_id"))
    return changelog.full_image_upserts(ch, ["user_id"], ["old"]).select("user_id", "pos", "op")


@query("SELECT event_id, event_id % 2 = 1 AS b0, event_id % 4 > 1 AS b1, event_id % 8 > 3 AS b2, event_id % 16 < 8 AS fits FROM events")
def mask_bits(spark, d):
    """The bits of a binary mask of three columns; a fourth bit is beyond it."""
    mask = F.unhex(F.lpad(F.hex(F.col("event_id") % 16), 2, "0"))
    return events(spark, d).select("event_id", *[changelog.bit(mask, i).alias(f"b{i}") for i in range(3)], changelog.mask_fits(mask, 3).alias("fits"))


@query(f"{CHANGES} SELECT version, op, 0 AS part, CASE WHEN op = 'd' THEN NULL ELSE a END AS a, FALSE AS tombstone FROM ch UNION ALL SELECT version, NULL, 1, NULL, TRUE FROM ch WHERE op = 'd'")
def debezium_records(spark, d):
    """A record for each change, and a tombstone after each delete."""
    out = debezium.emit(changes(spark, d), ["user_id"], ["a", "b"])
    field = lambda p: F.get_json_object("value", p)
    return out.select("version", field("$.op").alias("op"), "part", field("$.after.a").alias("a"), F.col("value").isNull().alias("tombstone"))


@query("SELECT event_id AS version, p AS part, CASE p WHEN 0 THEN user_id ELSE CASE p WHEN 1 THEN user_id ELSE user_id + 1000000 END END AS id, CASE p WHEN 0 THEN 'd' WHEN 2 THEN 'c' END AS op FROM events, (VALUES (0), (1), (2)) t(p)")
def debezium_key_moves(spark, d):
    """An update that moves the key: a delete of the old key, its tombstone, and a create."""
    e = events(spark, d).select((F.col("user_id") + 1_000_000).alias("id"), F.col("user_id").alias("old"), F.lit("u").alias("op"), F.col("event_id").alias("version"), "value")
    out = debezium.emit(e, ["id"], ["value"], ["old"])
    return out.select("version", "part", F.get_json_object("key", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.op").alias("op"))


@query("SELECT event_id AS \"offset\", CASE event_id % 5 WHEN 1 THEN 'a create has an after image only' WHEN 2 THEN 'unknown operation' WHEN 3 THEN 'a value is unavailable' END AS error, CASE event_id % 5 WHEN 2 THEN 'x' WHEN 4 THEN 'd' ELSE 'c' END AS op, CASE WHEN event_id % 5 IN (0, 4) THEN '{\"v\":' || user_id || '}' END AS data, 'shop' AS db, event_id * 1000 AS ms FROM events")
def debezium_parse(spark, d):
    k = F.col("event_id") % 5
    image = F.concat(F.lit('{"v":'), F.when(k == 3, F.lit(f'"{debezium.UNAVAILABLE}"')).otherwise(F.col("user_id").cast("string")), F.lit("}"))
    op = F.when(k == 2, "x").when(k == 4, "d").otherwise("c")
    before, after = F.when(k.isin(1, 4), image).otherwise("null"), F.when(k == 4, "null").otherwise(image)
    v = F.concat(F.lit('{"payload":{"op":"'), op, F.lit('","before":'), before, F.lit(',"after":'), after, F.lit(',"source":{"db":"shop"},"ts_ms":'), F.col("event_id") * 1000, F.lit("}}"))
    out = debezium.parse(as_messages(events(spark, d), v, F.lit("k")))
    return out.select("offset", "error", "op", F.when(F.col("error").isNull(), F.col("data")).alias("data"), F.col("_system_source_database").alias("db"), F.col("_system_event_timestamp_ms").alias("ms"))


@query(f"{CHANGES}, k AS (SELECT user_id, max(pos) AS p FROM ch GROUP BY user_id) SELECT ch.user_id, a FROM ch JOIN k ON ch.user_id = k.user_id AND pos = p WHERE op <> 'd'")
def replacing_merge_state(spark, d):
    """Versions of rows, and what a table that keeps the newest of each key shows."""
    rows = stores.replacing(changes(spark, d).select("user_id", "op", "version", "a"), ["user_id"])
    return stores.current(rows, ["user_id"]).select("user_id", "a")


@query(f"{CHANGES}, k AS (SELECT user_id, max(pos) AS p FROM ch GROUP BY user_id) SELECT 'delete' AS kind, user_id, NULL AS a FROM k UNION ALL SELECT 'data', ch.user_id, a FROM ch JOIN k ON ch.user_id = k.user_id AND pos = p WHERE op <> 'd'")
def row_delta(spark, d):
    collapsed = changelog.collapse(changes(spark, d), ["user_id"], ["a"])
    deletes, data = stores.row_delta(collapsed, ["user_id"], ["a"])
    return deletes.select(F.lit("delete").alias("kind"), "user_id", F.lit(None).cast("string").alias("a")).unionByName(data.select(F.lit("data").alias("kind"), "user_id", "a"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM customer UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_custkey % 5 = 0")
def merge_upsert(spark, d):
    c = table(spark, d, "customer")
    now = c.select(F.col("c_custkey").alias("id"), F.lit("old").alias("v"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("v")).unionByName(c.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 10_000_000).alias("id"), F.lit("new").alias("v")))
    return stores.merge(now, new, ["id"], ["v"], "upsert")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM customer")
def merge_update(spark, d):
    """Every update must find its row, or the merge stops."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("v"))
    return stores.merge(c, c.where("id % 3 = 0").withColumn("v", F.lit("new")), ["id"], ["v"], "update")


@query("SELECT c_custkey AS id, 'old' AS v FROM customer WHERE c_custkey % 3 <> 0")
def merge_delete(spark, d):
    """Rows that are not there are tolerated."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("v"))
    return stores.merge(c, c.where("id % 3 = 0").unionByName(c.select((F.col("id") + 10_000_000).alias("id"), "v")), ["id"], ["v"], "delete")


@query("SELECT c_custkey AS id, 'old' AS v FROM customer UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer")
def merge_append(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("v"))
    return stores.merge(c, c.select((F.col("id") + 10_000_000).alias("id"), F.lit("new").alias("v")), ["id"], ["v"], "append")


@query("SELECT n_regionkey || '|' || n_name AS id, n_nationkey % 2 = 1 AS gone, CASE WHEN n_nationkey % 2 = 0 THEN '{\"n_regionkey\":' || n_regionkey || ',\"n_name\":\"' || n_name || '\"}' END AS document FROM nation")
def search_bulk(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", "n_name", F.when(F.col("n_nationkey") % 2 == 1, "d").otherwise("c").alias("op"))
    out = stores.bulk(n, "ix", ["n_regionkey", "n_name"], "op")
    return out.select("id", F.get_json_object("action", "$.delete._id").isNotNull().alias("gone"), "document")


@query("SELECT 'pre.nation' AS topic, '{\"n_nationkey\":' || n_nationkey || '}' AS \"key\", '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def message_records(spark, d):
    return stores.records(table(spark, d, "nation").select("n_nationkey", "n_name"), "nation", ["n_nationkey"], prefix="pre")


# --- object sinks


def sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.lit("t").alias("topic"), F.pmod("user_id", F.lit(4)).alias("partition"), F.col("event_id").alias("offset"), F.lit(0).cast("long").alias("message_index"), (F.col("event_id") * 700).alias("write_ts_ms"), "event_type", (F.col("event_id") % 2 == 0).alias("even"))


@query("SELECT 'topic=t/partition=' || (user_id % 4) AS path, count(*) AS n FROM events GROUP BY 1")
def partition_by_source(spark, d):
    return sink_rows(spark, d).groupBy(partitioning.source_path().alias("path")).agg(F.count("*").alias("n"))


@query("SELECT 'event_type=' || event_type || '/even=' || (event_id % 2 = 0) AS path, count(*) AS n FROM events GROUP BY 1")
def partition_by_fields(spark, d):
    r = sink_rows(spark, d)
    return r.groupBy(partitioning.fields_path(r, ["event_type", "even"]).alias("path")).agg(F.count("*").alias("n"))


@query("SELECT strftime(CAST(timezone('Asia/Tokyo', to_timestamp((event_id * 700 // 60000) * 60)) AS TIMESTAMP), '%Y-%m-%d/%H/%M') AS path, count(*) AS n FROM events GROUP BY 1")
def partition_by_record_time(spark, d):
    """Tumbling slots of a minute in a time zone, whatever the session's."""
    return sink_rows(spark, d).groupBy(partitioning.record_time_path(F.col("write_ts_ms"), 60_000, "%Y-%m-%d/%H/%M", "Asia/Tokyo").alias("path")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT user_id % 4 AS partition, event_id AS off, (row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1) // 50 AS epoch FROM events) SELECT partition, epoch, count(*) AS n, min(off) AS start_offset FROM r GROUP BY 1, 2")
def rotation_by_rows(spark, d):
    r = sink_rows(spark, d).withColumn("partition_path", partitioning.source_path())
    return partitioning.epochs(r, max_rows=50).groupBy("partition", "epoch", "start_offset").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT user_id % 4 AS partition, event_id AS off, (row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1) // 25 AS epoch FROM events) SELECT partition, epoch, count(*) AS n, min(off) AS start_offset FROM r GROUP BY 1, 2")
def rotation_by_bytes(spark, d):
    """Rows of ten bytes, objects of 255 at most: 25 rows each."""
    r = sink_rows(spark, d).withColumn("partition_path", partitioning.source_path())
    return partitioning.epochs(r, max_bytes=255, size=F.lit(10)).groupBy("partition", "epoch", "start_offset").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT user_id % 4 AS p, event_id AS off, event_type, (row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1) // 50 AS epoch FROM events), k AS (SELECT p, epoch, min(off) AS s, count(*) AS lines, max(off) AS last_offset, string_agg('{\"event_type\":\"' || event_type || '\"}' || chr(10), '' ORDER BY off) AS body FROM r GROUP BY 1, 2) SELECT 'pre/ev/topic=t/partition=' || p || '/t+' || p || '+' || s || '.json' AS \"key\", lines, s AS first_offset, last_offset, body FROM k")
def object_bodies(spark, d):
    """Objects with their keys; their boundaries depend on the rows alone."""
    r = partitioning.epochs(partitioning.routed(sink_rows(spark, d), partitioning.source_path()), max_rows=50)
    return stores.objects(r, "pre", "ev", ["event_type"])


# --- transforms, identities, splits, generators


@query("SELECT 'lake.events_all' AS \"table\", event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def transform_chain(spark, d):
    """Two tables are renamed to one; a step concerns the tables by what they are called when it begins."""
    e = events(spark, d).select("event_id", "event_type")
    sets = [chain.Dataset(TableId("raw", f"events_{k}"), e) for k in ("click", "view")]
    steps = [{"type": "filter", "tables": f"raw.events_{k}", "config": {"field": "event_type", "value": k}} for k in ("click", "view")]
    steps.append({"type": "rename_table", "config": {"source": r"^raw\.events_\w+$", "target": "lake.events_all", "regex": True}})
    (name, out), *rest = chain.Chain.of(steps).apply(sets).items()
    assert not rest
    return out.df.groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit(name.text()).alias("table"), "event_type", "n")


@query("SELECT 'raw.clicks' AS \"table\", event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) WHERE n > 1")
def transform_sql_step(spark, d):
    steps = [{"type": "rename_table", "config": {"source": "events", "target": "clicks"}}, {"type": "sql", "tables": "raw.clicks", "config": {"query": "SELECT event_type, count(*) AS n FROM input GROUP BY event_type HAVING count(*) > 1"}}]
    ((name, out),) = chain.Chain.of(steps).apply([chain.Dataset(TableId("raw", "events"), events(spark, d))]).items()
    return out.df.select(F.lit(name.text()).alias("table"), "event_type", "n")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, '0x' || hex(encode(n_name)) AS raw, '[' || n_regionkey || ',null]' AS list FROM nation WHERE n_nationkey < 5")
def exact_cells(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 5")
    return chain.exact(n.select("n_nationkey", "n_name", F.col("n_name").cast("binary").alias("raw"), F.array("n_regionkey", F.lit(None)).alias("list")))


@query("SELECT 'before' AS side, event_id FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events ORDER BY events.event_id LIMIT 20) UNION ALL SELECT 'after', event_id FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events ORDER BY events.event_id LIMIT 20) WHERE event_type = 'click'")
def transform_preview(spark, d):
    """Cells before and after a step, from the first rows."""
    first = events(spark, d).orderBy("event_id").select("event_id", "event_type")
    c = chain.Chain.of([{"type": "filter", "config": {"field": "event_type", "value": "click"}}])
    before, after = c.preview(chain.Dataset(TableId("raw", "events"), first), 1)
    return spark.createDataFrame([("before", r["event_id"]) for r in before] + [("after", r["event_id"]) for r in after], "side string, event_id string")


@query("SELECT * FROM (VALUES ('main', 'raw.customer', (SELECT count(*) FROM customer)), ('main', 'raw.nation', 2 * (SELECT count(*) FROM nation))) t(role, \"table\", n)")
def merged_row_counts(spark, d):
    """Output rows per role and table; a retried batch's counts are added."""
    first = chain.row_counts({TableId("raw", n): chain.Dataset(TableId("raw", n), table(spark, d, n)) for n in ("customer", "nation")})
    again = chain.row_counts({TableId("raw", "nation"): chain.Dataset(TableId("raw", "nation"), table(spark, d, "nation"))})
    return spark.createDataFrame([(role, t, n) for (role, t), n in chain.merged_counts(first, again).items()], "role string, table string, n long")


@query("SELECT 'n_name' AS \"column\", count(*) AS rows, count(*) - count(n_name) AS nulls, CAST(min(strlen(n_name)) AS BIGINT) AS least_bytes, CAST(max(strlen(n_name)) AS BIGINT) AS most_bytes, CAST(sum(strlen(n_name)) AS BIGINT) AS bytes FROM nation UNION ALL SELECT 'k', count(*), count(*) - count(nullif(n_regionkey, 1)), min(strlen(CAST(nullif(n_regionkey, 1) AS VARCHAR))), max(strlen(CAST(nullif(n_regionkey, 1) AS VARCHAR))), CAST(sum(strlen(CAST(nullif(n_regionkey, 1) AS VARCHAR))) AS BIGINT) FROM nation")
def column_profile(spark, d):
    out = chain.profile(table(spark, d, "nation").select("n_name", F.expr("nullif(n_regionkey, 1)").alias("k")))
    return out.select("column", "rows", "nulls", *[F.col(c).cast("long").alias(c) for c in ("least_bytes", "most_bytes", "bytes")])


@query("SELECT 'customer' AS \"table\" UNION ALL SELECT 'orders'")
def selected_tables(spark, d):
    """Rules over the catalogue of the given folder."""
    found = [TableId(None, t) for t in objects.tables(spark, d)]
    chosen = select_tables(found, [Card("custom*"), Card("order?")])
    return spark.createDataFrame([(t.name,) for t in chosen], "`table` string")


@query("SELECT CAST(n_nationkey % 4 AS INTEGER) AS part, count(*) AS n, sum(CAST(n_nationkey AS BIGINT))::BIGINT AS s FROM nation GROUP BY 1")
def hash_buckets(spark, d):
    n = table(spark, d, "nation")
    part = F.lit(None).cast("int")
    for i, p in enumerate(splits.hash_predicates("cast(n_nationkey as bigint)", 4)):
        part = F.when(F.expr(p), F.lit(i)).otherwise(part)
    return n.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("n_nationkey").cast("long")).alias("s"))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS k, CAST(max(cnt) AS BIGINT) AS times FROM (SELECT l_orderkey, 1 AS cnt FROM lineitem)")
def split_ranges_cover(spark, d):
    """Ranges from the keys' own bounds: each row is in one range."""
    li = table(spark, d, "lineitem")
    low, high = li.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    hits = F.lit(0)
    for p in splits.equal_ranges("l_orderkey", low, high, 8):
        hits = hits + F.expr(p).cast("int")
    return li.agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("k"), F.max(hits).cast("long").alias("times"))


@query("SELECT range AS \"offset\", CASE range % 3 WHEN 0 THEN 'pqv1/commit_latency_logger.go:80' WHEN 1 THEN 'bufferer/bufferer.go:213' ELSE 'stats/sink_wrapper.go:98' END AS caller, CASE WHEN range % 3 = 1 THEN 185528 + range END AS flush_num, CASE WHEN range % 3 = 2 THEN 0.45661641::DOUBLE END AS lag, CASE WHEN range % 3 = 1 THEN '858 kB' END AS size, 'INFO' AS level FROM range(10, 1010)")
def generator_logs(spark, d):
    return generator.transfer_logs(spark, 1000, 10).select(F.col("_system_offset").alias("offset"), "caller", "flush_num", "lag", "size", "level")


@query("SELECT range AS id, CASE WHEN range % 7 <> 6 THEN range % 2 = 0 END AS b, CASE WHEN range % 7 <> 6 THEN CAST(range % 128 AS TINYINT) END AS i8, CASE WHEN range % 7 <> 6 THEN CAST(range AS VARCHAR) END AS utf8, CASE WHEN range % 7 <> 6 THEN DATE '1970-01-01' + CAST(range % 20000 AS INTEGER) END AS date32, CASE WHEN range % 7 <> 6 THEN range / 8 END AS f64, CASE WHEN range % 7 <> 6 THEN 2 ELSE -1 END AS items FROM range(500)")
def generator_all_types(spark, d):
    out = generator.all_types(spark, 500)
    return out.select("id", F.col("boolean").alias("b"), F.col("int8").alias("i8"), "utf8", "date32", F.col("float64").alias("f64"), F.when(F.col("list").isNull(), -1).otherwise(F.size("list")).alias("items"))


@query("SELECT range AS \"WatchID\", TRUE AS in_range FROM range(2000)")
def generator_hits(spark, d):
    h = generator.hits(spark, 2000)
    return h.select("WatchID", (F.col("CounterID").between(0, 9_999) & F.col("UserID").between(0, 999_999) & F.col("ResolutionWidth").between(0, 2_000) & (F.year("EventTime") == 2013)).alias("in_range"))


@query("SELECT event_type AS t, CASE event_type WHEN 'never' THEN '' ELSE 'x' END AS seen, 32 AS digits FROM (SELECT DISTINCT event_type FROM events)")
def murmur_hashes(spark, d):
    """128 bits of each distinct value; values are held against the published ones in the tests."""
    e = events(spark, d).select("event_type").distinct()
    h = F.hex(murmur3(F.col("event_type")))
    return e.select(F.col("event_type").alias("t"), F.when(h.isNotNull(), "x").otherwise("").alias("seen"), F.length(h).alias("digits"))


@query("SELECT event_id % 4 AS partition, event_id AS \"offset\" FROM events")
def deduplicated_messages(spark, d):
    """Messages that came twice count once, by their coordinates."""
    m = as_messages(events(spark, d), body()).withColumn("message_index", F.lit(0))
    return deduplicated(m.unionByName(m)).select("partition", "offset")


@query("SELECT event_id AS \"offset\", 'u' AS op, 'shop' AS namespace, 'orders' AS \"table\", '{\"id\":\"' || user_id || '\"}' AS old_key FROM events")
def logical_replication(spark, d):
    v = F.concat(F.lit('{"change":[{"kind":"update","schema":"shop","table":"orders","columnnames":["id"],"columnvalues":["1"],"oldkeys":{"keynames":["id"],"keyvalues":["'), F.col("user_id"), F.lit('"]}}]}'))
    return objects.wal2json(as_messages(events(spark, d), v)).select("offset", "op", "namespace", "table", "old_key")


@query("SELECT event_id + 1 AS version, CASE WHEN event_id % 2 = 0 THEN 'd' ELSE 'c' END AS op, '[' || user_id || ']' AS \"key\", CASE WHEN event_id % 2 = 1 THEN '{\"v\":1}' END AS data FROM events")
def change_feed(spark, d):
    """While a snapshot overlaps the feed, a change's version is its offset + 1."""
    v = F.concat(F.lit('{"key":['), F.col("user_id"), F.lit("],"), F.when(F.col("event_id") % 2 == 0, '"erase":{}}').otherwise('"newImage":{"v":1}}'))
    return objects.changefeed(as_messages(events(spark, d), v), overlap=True).select("version", "op", "key", "data")


@query("SELECT CAST(event_id AS VARCHAR) AS _id, '{\"a\":' || user_id || '}' AS _source, CAST(event_id AS VARCHAR) AS _routing_key FROM events")
def search_export(spark, d):
    v = F.concat(F.lit('{"_id":"'), F.col("event_id"), F.lit('","_source":{"a":'), F.col("user_id"), F.lit("}}"))
    return objects.search_hits(as_messages(events(spark, d), v)).select("_id", "_source", "_routing_key")


@query("SELECT n_nationkey, '[' || n_regionkey || ']' AS l, n_name FROM nation")
def unsupported_types_as_text(spark, d):
    from pyspark.sql import types as T

    n = table(spark, d, "nation").select("n_nationkey", F.array("n_regionkey").alias("l"), "n_name")
    return objects.unsupported_as_text(n, (T.StringType, T.LongType, T.IntegerType))


@query("SELECT n_nationkey, n_name FROM nation")
def strict_parquet(spark, d):
    """All objects of a folder under one schema."""
    return objects.parquet(spark, d, "nation.parquet").select("n_nationkey", "n_name")


@query(f"{CHANGES} SELECT user_id, op, pos FROM ch")
def changelog_checked(spark, d):
    """Valid changes pass the check as they are."""
    return changelog.checked(changes(spark, d), ["user_id"]).select("user_id", "op", "pos")
