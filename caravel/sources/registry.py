"""Messages with registered schemas: the registry's framing, and Avro, JSON Schema and Protobuf values to typed columns.

The decoders are plain Python over Arrow batches: Spark's own need jars. A value that does not fit its schema is an error of its row.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First byte of a framed message (fixed value).
MAGIC = 0


def schema_id(value: Column) -> Column:
    """The schema id of a framed message: a zero byte, then four bytes, big-endian; null for other values."""
    framed = (F.octet_length(value) >= 5) & (F.hex(F.substring(value, 1, 1)) == "00")
    return F.when(framed, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("bigint"))


def body(value: Column) -> Column:
    return F.when(schema_id(value).isNotNull(), F.substring(value, F.lit(6), F.octet_length(value)))


def frame(identity: int, value: bytes) -> bytes:
    return bytes([MAGIC]) + struct.pack(">I", identity) + value


class Wrong(ValueError):
    """A value does not fit its schema."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = out = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Wrong("unfinished number")
        b = data[at]
        out |= (b & 0x7F) << shift
        at += 1
        shift += 7
        if b < 0x80:
            return out & 0xFFFFFFFFFFFFFFFF, at


def _zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _write_varint(n: int) -> bytes:
    out = b""
    n &= 0xFFFFFFFFFFFFFFFF
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if n < 0 or at + n > len(data):
        raise Wrong("the value ends early")
    return data[at : at + n], at + n


def avro_names(schema: Any, names: dict[str, Any] | None = None, open_: tuple[str, ...] = ()) -> dict[str, Any]:
    """Named types of a schema; recursive ones and unions of several branches are refused."""
    names = {} if names is None else names
    if isinstance(schema, list):
        if len([b for b in schema if b != "null"]) != 1 or len(schema) > 2:
            raise Wrong("only unions with null are supported")
        for b in schema:
            avro_names(b, names, open_)
    elif isinstance(schema, dict):
        kind = schema["type"]
        if kind in ("record", "enum", "fixed"):
            names[schema["name"]] = schema
            for f in schema.get("fields", ()):
                avro_names(f["type"], names, (*open_, schema["name"]))
        elif kind == "array":
            avro_names(schema["items"], names, open_)
        elif kind == "map":
            avro_names(schema["values"], names, open_)
        elif isinstance(kind, dict | list):
            avro_names(kind, names, open_)
    elif schema in open_:
        raise Wrong(f"{schema} holds itself")
    return names


def avro_value(schema: Any, data: bytes, at: int, names: dict[str, Any]) -> tuple[Any, int]:
    """(value, place after it) of an Avro binary value."""
    if isinstance(schema, list):
        i, at = _varint(data, at)
        i = _zigzag(i)
        if not 0 <= i < len(schema):
            raise Wrong("unknown branch")
        return avro_value(schema[i], data, at, names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, dict | list):
        return avro_value(kind, data, at, names)
    if kind in names and not isinstance(schema, dict):
        return avro_value(names[kind], data, at, names)
    if kind == "null":
        return None, at
    if kind == "boolean":
        b, at = _take(data, at, 1)
        if b not in (b"\0", b"\1"):
            raise Wrong("not a boolean")
        return b == b"\1", at
    if kind in ("int", "long"):
        n, at = _varint(data, at)
        return _zigzag(n), at
    if kind in ("float", "double"):
        b, at = _take(data, at, 4 if kind == "float" else 8)
        return struct.unpack("<f" if kind == "float" else "<d", b)[0], at
    if kind in ("bytes", "string"):
        n, at = _varint(data, at)
        b, at = _take(data, at, _zigzag(n))
        return (b.decode() if kind == "string" else b), at
    if kind == "fixed":
        return _take(data, at, schema["size"])
    if kind == "enum":
        n, at = _varint(data, at)
        n = _zigzag(n)
        if not 0 <= n < len(schema["symbols"]):
            raise Wrong("unknown symbol")
        return schema["symbols"][n], at
    if kind == "record":
        out = {}
        for f in schema["fields"]:
            out[f["name"]], at = avro_value(f["type"], data, at, names)
        return out, at
    if kind in ("array", "map"):
        out: Any = [] if kind == "array" else {}
        while True:
            n, at = _varint(data, at)
            n = _zigzag(n)
            if n < 0:
                _, at = _varint(data, at)
            if not n:
                return out, at
            for _ in range(abs(n)):
                if kind == "array":
                    v, at = avro_value(schema["items"], data, at, names)
                    out.append(v)
                else:
                    k, at = avro_value("string", data, at, names)
                    out[k], at = avro_value(schema["values"], data, at, names)
    raise Wrong(f"unsupported type {kind}")


def avro_bytes(schema: Any, value: Any, names: dict[str, Any]) -> bytes:
    """The Avro binary value; the inverse of avro_value()."""
    if isinstance(schema, list):
        i = next((k for k, b in enumerate(schema) if (b == "null") == (value is None)), None)
        if i is None:
            raise Wrong("null is no branch")
        return _write_varint(i << 1) + avro_bytes(schema[i], value, names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, dict | list):
        return avro_bytes(kind, value, names)
    if kind in names and not isinstance(schema, dict):
        return avro_bytes(names[kind], value, names)
    if kind == "null":
        return b""
    if value is None:
        raise Wrong("null where there must be a value")
    if kind == "boolean":
        return bytes([bool(value)])
    if kind in ("int", "long"):
        return _write_varint((value << 1) ^ (value >> 63))
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", value)
    if kind in ("bytes", "string"):
        b = value.encode() if isinstance(value, str) else value
        return _write_varint(len(b) << 1) + b
    if kind == "fixed":
        return value
    if kind == "enum":
        return _write_varint(schema["symbols"].index(value) << 1)
    if kind == "record":
        return b"".join(avro_bytes(f["type"], value.get(f["name"]), names) for f in schema["fields"])
    if kind == "array":
        return (_write_varint(len(value) << 1) + b"".join(avro_bytes(schema["items"], v, names) for v in value) if value else b"") + b"\0"
    if kind == "map":
        return (_write_varint(len(value) << 1) + b"".join(avro_bytes("string", k, names) + avro_bytes(schema["values"], v, names) for k, v in value.items()) if value else b"") + b"\0"
    raise Wrong(f"unsupported type {kind}")


def avro_decoder(schema: dict) -> Callable[[bytes], dict]:
    names = avro_names(schema)

    def run(data: bytes) -> dict:
        out, at = avro_value(schema, data, 0, names)
        if at != len(data):
            raise Wrong("bytes are left over")
        return out

    return run


#: Types of JSON Schema and the Python types that fit them (fixed values).
JSON_KINDS = {"string": str, "integer": int, "boolean": bool, "object": dict, "array": list}


def json_decoder(schema: dict) -> Callable[[bytes], dict]:
    """Of a closed object schema: an open one, and a number without bounds, are refused."""
    if schema.get("type") != "object" or schema.get("additionalProperties") is not False:
        raise Wrong("only closed objects are supported")
    kinds = {}
    for name, p in schema["properties"].items():
        ts = p["type"] if isinstance(p["type"], list) else [p["type"]]
        if "number" in ts and not ("minimum" in p and "maximum" in p):
            raise Wrong(f"{name} is a number without bounds")
        kinds[name] = ({t for t in ts if t != "null"}, "null" in ts, p)

    def run(data: bytes) -> dict:
        value = json.loads(data)
        if not isinstance(value, dict) or set(value) - set(kinds):
            raise Wrong("not an object of the schema")
        for name in schema.get("required", ()):
            if name not in value:
                raise Wrong(f"{name} is missing")
        for name, v in value.items():
            ts, nullable, p = kinds[name]
            fits = (v is None and nullable) or any((t == "number" and isinstance(v, int | float) and not isinstance(v, bool) and p["minimum"] <= v <= p["maximum"]) or (t in JSON_KINDS and isinstance(v, JSON_KINDS[t]) and (t != "integer" or not isinstance(v, bool))) for t in ts)
            if not fits:
                raise Wrong(f"{name} has another type")
        return {name: value.get(name) for name in kinds}

    return run


#: Wire types of Protobuf scalars (fixed values).
WIRE = {"int32": 0, "int64": 0, "uint32": 0, "uint64": 0, "sint32": 0, "sint64": 0, "bool": 0, "enum": 0, "fixed64": 1, "sfixed64": 1, "double": 1, "string": 2, "bytes": 2, "message": 2, "fixed32": 5, "sfixed32": 5, "float": 5}
PACKED = {"fixed64": "<Q", "sfixed64": "<q", "double": "<d", "fixed32": "<I", "sfixed32": "<i", "float": "<f"}


def _scalar(kind: str, raw: Any, fields: dict | None) -> Any:
    if kind in PACKED:
        return struct.unpack(PACKED[kind], raw)[0]
    if kind in ("int32", "int64", "enum"):
        return raw - 2**64 if raw >= 2**63 else raw
    if kind in ("sint32", "sint64"):
        return _zigzag(raw)
    if kind == "bool":
        return bool(raw)
    if kind == "string":
        return raw.decode()
    return protobuf_value(fields, raw) if kind == "message" else raw


def protobuf_value(fields: dict[int, dict], data: bytes, unknown: str = "discard") -> dict:
    """A message by its descriptor: {number: {name, type, repeated?, fields? of messages}}. Lists may be packed. unknown: discard or fail."""
    out: dict[str, Any] = {f["name"]: [] if f.get("repeated") else None for f in fields.values()}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire in (1, 5):
            raw, at = _take(data, at, 8 if wire == 1 else 4)
        elif wire == 2:
            n, at = _varint(data, at)
            raw, at = _take(data, at, n)
        else:
            raise Wrong(f"unknown wire type {wire}")
        f = fields.get(number)
        if f is None:
            if unknown == "fail":
                raise Wrong(f"unknown field {number}")
            continue
        kind = f["type"]
        if f.get("repeated") and wire == 2 and WIRE[kind] != 2:
            own = 0
            while own < len(raw):
                if WIRE[kind] == 0:
                    v, own = _varint(raw, own)
                else:
                    v, own = _take(raw, own, 8 if WIRE[kind] == 1 else 4)
                out[f["name"]].append(_scalar(kind, v, None))
            continue
        if wire != WIRE[kind]:
            raise Wrong(f"{f['name']} has another wire type")
        v = _scalar(kind, raw, f.get("fields"))
        if f.get("repeated"):
            out[f["name"]].append(v)
        else:
            out[f["name"]] = v
    return out


def protobuf_bytes(fields: dict[int, dict], value: dict) -> bytes:
    """The inverse of protobuf_value(); lists are not packed."""
    out = b""
    for number, f in fields.items():
        kind = f["type"]
        for v in value.get(f["name"]) or [] if f.get("repeated") else [value.get(f["name"])]:
            if v is None:
                continue
            out += _write_varint(number << 3 | WIRE[kind])
            if kind in PACKED:
                out += struct.pack(PACKED[kind], v)
            elif kind in ("sint32", "sint64"):
                out += _write_varint((v << 1) ^ (v >> 63))
            elif WIRE[kind] == 0:
                out += _write_varint(int(v))
            else:
                b = v.encode() if kind == "string" else protobuf_bytes(f["fields"], v) if kind == "message" else v
                out += _write_varint(len(b)) + b
    return out


def protobuf_decoder(fields: dict[int, dict], unknown: str = "discard") -> Callable[[bytes], dict]:
    return lambda data: protobuf_value(fields, data, unknown)


def protoseq(data: bytes, magic: bytes, limit: int = 64 << 20) -> Iterator[tuple[bytes | None, bytes | None]]:
    """(payload, None) of each frame: a little-endian length, the payload, the magic. A broken stretch is (None, stretch), up to the next magic."""
    at = 0
    while at < len(data):
        if at + 4 <= len(data):
            n = int.from_bytes(data[at : at + 4], "little")
            end = at + 4 + n
            if n <= limit and data[end : end + len(magic)] == magic:
                yield data[at + 4 : end], None
                at = end + len(magic)
                continue
        to = data.find(magic, at)
        to = len(data) if to < 0 else to + len(magic)
        yield None, data[at:to]
        at = to


def decode(messages: DataFrame, decoders: dict[int, Callable[[bytes], dict]], columns: dict[str, str], passed: list[str] | None = None) -> DataFrame:
    """passed columns, schema_id, columns {name: Spark type}, and error (null for good rows) of framed messages, each by its own writer schema.

    Values of lists, maps and messages go to string columns as JSON text. A schema that is not registered is an error of the row.
    """
    passed = passed or ["topic", "partition", "offset"]
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.select(*passed).schema.fields), "schema_id long", *(f"`{n}` {t}" for n, t in columns.items()), "error string"])
    framed = messages.select(*passed, schema_id(F.col("value")).alias("schema_id"), body(F.col("value")).alias("_body"))
    target = framed.sparkSession.createDataFrame([], out_schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            rows, errors = [], []
            for i, data in zip(batch["schema_id"].to_pylist(), batch["_body"].to_pylist(), strict=True):
                try:
                    if i is None:
                        raise Wrong("no schema id")
                    if i not in decoders:
                        raise Wrong(f"unknown schema {i}")
                    value = decoders[i](data)
                    rows.append({k: json.dumps(v, default=lambda b: b.decode("latin-1")) if isinstance(v, dict | list) else v for k, v in value.items()})
                    errors.append(None)
                except (ValueError, KeyError, struct.error) as e:
                    rows.append({})
                    errors.append(str(e))
            cols = [batch[p] for p in passed] + [batch["schema_id"]] + [pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in columns] + [pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return framed.mapInArrow(run, out_schema)


def encode(df: DataFrame, identity: int, encoder: Callable[[dict], bytes], value: str = "value") -> DataFrame:
    """df with one more column: its rows as framed values of a registered schema."""
    names = list(df.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{value}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([frame(identity, encoder(r)) for r in batch.to_pylist()], pa.binary())], names=[*names, value])

    return df.mapInArrow(run, schema)
