"""Parsers of messages other than JSON documents: TSKV, raw rows, table names, topic routes, and what a sample looks like."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .json_parser import INTEGERS, TYPES, Field, JsonParser, b64, epoch_time, exact_decimal, parse, utc_time

#: Escaped letters of a TSKV value and what they stand for (fixed values).
ESCAPES = {"\\": "\\", "t": "\t", "n": "\n", "r": "\r", "0": "\0", "=": "="}


def parse_json(df: DataFrame, columns: dict[str, tuple[str, str, bool]], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) for columns {name: (path, type, nullable)}; the other columns of df are passed through. See json_parser."""
    named = {"bigint": "int64", "int": "int32", "double": "float64"}
    rest = [c for c in df.columns if c != value]
    parser = JsonParser(tuple(Field(n, named.get(t, t), p, nullable) for n, (p, t, nullable) in columns.items()), framing="single_document")
    held = df.select(F.col(value).alias("value"), *[F.col(c).alias(f"_pass_{c}") for c in rest])
    good, bad = parse(held, parser, passed=[f"_pass_{c}" for c in rest])
    named_back = [F.col(f"_pass_{c}").alias(c) for c in rest]
    return good.select(*named_back, *columns), bad.select("raw_base64", "error_message", *named_back)


def unescaped(text: Column) -> Column:
    """Escapes undone from left to right; an unknown or unfinished one gives null."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\$"), F.lit(0))
    one = lambda x: F.when(~x.startswith("\\"), x)

    def undone(x: Column) -> Column:
        out = one(x)
        for k, v in ESCAPES.items():
            out = out.when(x == "\\" + k, F.lit(v))
        return out

    done = F.transform(parts, undone)
    return F.when(text == "", F.lit("")).when(F.exists(done, lambda x: x.isNull()), F.lit(None)).otherwise(F.array_join(done, ""))


def _of_text(f: Field, text: Column) -> Column:
    """A text in the field's type, null where it does not fit; nothing depends on the session's ANSI setting."""
    if f.type in ("string", "json"):
        return text
    if f.type == "boolean":
        return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
    if f.type in INTEGERS:
        lo, hi = INTEGERS[f.type]
        wide = F.when(text.rlike(r"^-?\d{1,20}$"), text.try_cast("decimal(38,0)"))
        return F.when(wide.between(F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)")), wide).cast(f.spark_type)
    if f.type in ("float32", "float64"):
        wide = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
        return F.when(F.abs(wide) <= (3.4028234663852886e38 if f.type == "float32" else 1.7976931348623157e308), wide).cast(f.spark_type)
    if f.type.startswith("decimal"):
        return exact_decimal(text, *map(int, re.findall(r"\d+", f.type)))
    if f.time in ("s", "ms", "us", "ns"):
        out = epoch_time(F.when(text.rlike(r"^-?\d{1,18}$"), text.try_cast("bigint")), f.time)
    else:
        out = utc_time(text, f.time)
    return out.cast("date") if f.type == "date" else out


def parse_tskv(df: DataFrame, columns: dict[str, str] | tuple[Field, ...], value: str = "value", on_error: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """`tskv\\tkey=value…` to typed columns: rows, or (rows, dead letters) with the policy dlq. fail stops the job at the first error.

    A missing prefix or `=`, an empty or repeated key, an unknown escape, a tombstone, a missing value where there must be one and a value of
    another type or range are errors.
    """
    named = {"bigint": "int64", "int": "int32", "double": "float64"}
    fields = columns if isinstance(columns, tuple) else tuple(Field(n, named.get(t, t)) for n, t in columns.items())
    text = F.col(value).cast("string")
    parts = F.slice(F.split(text, "\t"), 2, 1 << 30)
    cut = F.transform(parts, lambda x: F.struct(F.instr(x, "=").alias("at"), x.alias("x")))
    entries = F.transform(cut, lambda c: F.struct(unescaped(F.substring(c["x"], F.lit(1), c["at"] - 1)).alias("k"), unescaped(F.substring(c["x"], c["at"] + 1, F.length(c["x"]))).alias("v"), c["at"].alias("at")))
    held = df.select("*", F.explode(F.array(F.when(text.startswith("tskv\t"), entries))).alias("_kv"))
    keys = F.transform("_kv", lambda e: e["k"])
    find = lambda name: F.get(F.filter("_kv", lambda e: e["k"] == name), F.lit(0))["v"]
    raws = [find(f.name) for f in fields]
    outs = [_of_text(f, r).alias(f.name) for f, r in zip(fields, raws, strict=True)]
    held = held.select("*", F.explode(F.array(F.struct(*outs, F.lit(0).alias("_none")))).alias("_out"))
    error = F.when(F.col("tombstone"), "a tombstone holds no record") if "tombstone" in df.columns else F.when(F.lit(False), "")
    error = (
        error.when(F.col("_kv").isNull(), "not a TSKV record")
        .when(F.exists("_kv", lambda e: e["at"] == 0), "a field has no value")
        .when(F.exists("_kv", lambda e: e["k"].isNull() | e["v"].isNull()), "unknown escape")
        .when(F.exists(keys, lambda k: k == ""), "empty key")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate key")
    )
    for f, raw in zip(fields, raws, strict=True):
        out = F.col("_out")[f.name]
        if not f.nullable:
            error = error.when(raw.isNull(), f"{f.name} is missing")
        error = error.when(raw.isNotNull() & out.isNull(), f"{f.name} has another type or range")
        if f.max_length is not None:
            error = error.when(F.char_length(out.cast("string")) > f.max_length, f"{f.name} is too long")
    held = held.select("*", F.explode(F.array(error)).alias("_error"))
    rest = [c for c in df.columns if c != value]
    names = [f.name for f in fields]
    if on_error == "fail":
        held = held.withColumn("_out", F.when(F.col("_error").isNull(), F.col("_out")).otherwise(F.raise_error(F.col("_error"))))
        return held.select(*rest, *[F.col("_out")[n].alias(n) for n in names])
    good = held.where("_error is null").select(*rest, *[F.col("_out")[n].alias(n) for n in names])
    if on_error == "drop":
        return good
    return good, held.where("_error is not null").select(b64(F.col(value)).alias("raw_base64"), F.col("_error").alias("error_message"), *rest)


def raw_to_table(df: DataFrame, value_as: str = "bytes", timestamp: bool = False, headers: bool = False, key: bool = False) -> DataFrame:
    """topic, partition and offset (the key), the message's timestamp, headers and key if asked for, tombstone, and the untouched value.

    value_as string or json adds `error` for values that are no UTF-8, or no JSON document; the value of those is null, the bytes stay in raw.
    Headers keep their order, repeated names and null values.
    """
    value = F.col("value")
    out = ["topic", "partition", "offset"]
    if timestamp:
        out.append(F.col("write_ts_ms").alias("timestamp"))
    if headers:
        out.append(F.to_json(F.transform("headers", lambda h: F.struct(h["key"].alias("key"), b64(h["value"]).alias("value_base64"))), {"ignoreNullFields": "false"}).alias("headers"))
    if key:
        out.append("key")
    out.append("tombstone")
    if value_as == "bytes":
        return df.select(*out, "value")
    text = F.try_validate_utf8(value.cast("string"))
    good = text if value_as == "string" else F.when(F.try_parse_json(text).isNotNull(), text)
    error = F.when(value.isNotNull() & good.isNull(), F.lit("not UTF-8" if value_as == "string" else "not a JSON document"))
    return df.select(*out, good.alias("value"), error.alias("error"), F.when(error.isNotNull(), value).alias("raw"))


def discard(df: DataFrame) -> DataFrame:
    """The next offset of each partition, and no row of the messages."""
    return df.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def table_name(rule: str, topic: str, configured: str | None = None) -> str:
    """from_config: the configured name; from_topic_name: the whole topic; from_message: the last part of its path."""
    if rule == "from_config":
        if not configured:
            raise ValueError("a table name must be configured")
        return configured
    if rule not in ("from_topic_name", "from_message"):
        raise ValueError(f"unknown rule {rule}")
    name = topic if rule == "from_topic_name" else topic.rstrip("/").rsplit("/", 1)[-1]
    if not name:
        raise ValueError(f"the topic {topic!r} gives no table name")
    return name


def route(messages: DataFrame, topics: Iterable[str], transform: Callable[[DataFrame], DataFrame], rule: str = "from_topic_name", configured: str | None = None) -> dict[str, DataFrame]:
    """One table per topic; topics that give one name are one table. Each topic's rows are filtered at the scan."""
    named: dict[str, list[str]] = {}
    for t in topics:
        named.setdefault(table_name(rule, t, configured), []).append(t)
    return {name: transform(messages.where(F.col("topic").isin(ts))) for name, ts in named.items()}


def routed(messages: DataFrame, rule: str = "from_topic_name", configured: str | None = None) -> Column:
    """The table of each message, in one pass over all topics."""
    if rule == "from_config":
        return F.lit(table_name(rule, "", configured))
    return F.col("topic") if rule == "from_topic_name" else F.element_at(F.split(F.rtrim(F.col("topic"), F.lit("/")), "/"), -1)


def _kind(v: object) -> str | None:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, int):
        return "int64" if -(2**63) <= v < 2**63 else "uint64" if 0 <= v < 2**64 else "float64"
    return "float64" if isinstance(v, float) and math.isfinite(v) else None


def detect(payloads: list[bytes]) -> tuple[str, tuple[Field, ...]]:
    """(format, columns) of a sample: json, tskv or raw. A key is a column if it is an identifier and its values are of one kind; a key that is
    null or absent somewhere is nullable."""
    texts = []
    for p in payloads:
        try:
            texts += [x for x in p.decode().split("\n") if x.strip()]
        except UnicodeDecodeError:
            return "raw", ()
    if texts and all(x.startswith("tskv\t") for x in texts):
        rows = [dict(e.split("=", 1) for e in x.split("\t")[1:] if "=" in e) for x in texts]
        return "tskv", _columns([{k: _narrow(v) for k, v in r.items()} for r in rows])
    try:
        rows = [json.loads(x) for x in texts]
    except ValueError:
        return "raw", ()
    return ("json", _columns(rows)) if rows and all(isinstance(r, dict) for r in rows) else ("raw", ())


def _narrow(text: str) -> object:
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?\d+", text) and -(2**63) <= int(text) < 2**64:
        return int(text)
    try:
        return float(text) if math.isfinite(float(text)) else text
    except ValueError:
        return text


def _columns(rows: list[dict]) -> tuple[Field, ...]:
    names = sorted({k for r in rows for k in r if re.fullmatch(r"[A-Za-z_]\w*", k)})
    out = []
    for n in names:
        values = [r.get(n) for r in rows]
        kinds = {_kind(v) for v in values if v is not None}
        if len(kinds) == 1 and None not in kinds:
            out.append(Field(n, kinds.pop(), nullable=any(v is None for v in values)))
    return tuple(out)


__all__ = ["TYPES", "Field", "JsonParser", "detect", "discard", "parse_json", "parse_tskv", "raw_to_table", "route", "routed", "table_name", "unescaped"]
