"""JSON messages to typed rows and dead letters: framing, paths, kinds, ranges, exact decimals, times, lengths and unknown fields.

A document is parsed once, to a map of its root fields whose values keep their JSON kind. Values are never cast, cut, rounded or nulled
silently: what does not fit is an error of its row, which the error policy sends to the dead letters, drops, or stops the job with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of the integer types (fixed values).
INTEGERS = {f"int{b}": (-(2 ** (b - 1)), 2 ** (b - 1) - 1) for b in (8, 16, 32, 64)} | {f"uint{b}": (0, 2**b - 1) for b in (8, 16, 32, 64)}
#: Spark types of the column types (fixed values).
TYPES = {
    "string": "string", "json": "string", "boolean": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int",
    "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "date": "date", "timestamp": "timestamp",
}
EPOCHS = {"s": 1, "ms": 1000, "us": 1_000_000, "ns": 1_000_000_000}
#: Parts of a bracketed time format and what they are in Spark's patterns (fixed values).
TIME_PARTS = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH", "minute": "mm", "second": "ss", "offset_hour": "XXX", "weekday": "EEEE"}
#: Names of the system columns and the message fields behind them (fixed values).
SYSTEM = {"topic": "topic", "partition": "partition", "offset": "offset", "message_index": "message_index", "write_timestamp_ms": "write_ts_ms"}


@dataclass(frozen=True)
class Field:
    """A column: its type, where it is ($.name unless a path is given), and what it must keep to."""

    name: str
    type: str
    path: str | None = None
    nullable: bool = True
    max_length: int | None = None
    time: str | None = None  # unit of an epoch, a Spark pattern, or a bracketed format

    @property
    def root(self) -> str:
        """The first step of the path."""
        return steps(self.path)[0] if self.path else self.name

    @property
    def spark_type(self) -> str:
        return TYPES.get(self.type, self.type)


@dataclass(frozen=True)
class JsonParser:
    fields: tuple[Field, ...]
    framing: str = "json_lines"  # single_document, json_lines or json_array
    unknown: str = "drop"  # drop, fail or collect
    extra: str = "additional_properties"
    on_error: str = "dlq"  # dlq, drop or fail
    system: dict[str, str] = field(default_factory=dict)  # kind to column name

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields] + list(self.system.values()) + [self.extra] * (self.unknown == "collect")
        if len(set(names)) < len(names):
            raise ValueError(f"column names are not unique: {sorted(names)}")
        for f in self.fields:
            if f.type not in TYPES and not re.fullmatch(r"decimal\(\d+,\d+\)", f.type):
                raise ValueError(f"unknown type {f.type} of column {f.name}")
            if f.path:
                steps(f.path)
            if f.type in ("date", "timestamp") and not f.time:
                raise ValueError(f"column {f.name} needs a time format")
        if set(self.system) - set(SYSTEM):
            raise ValueError(f"unknown system columns: {sorted(set(self.system) - set(SYSTEM))}")


def b64(c: Column) -> Column:
    """Base64 in one line."""
    return F.translate(F.base64(c.cast("binary")), "\r\n", "")


def steps(path: str) -> list[str]:
    """Steps of a path of names and indexes; filters and slices are refused."""
    if not re.fullmatch(r"\$(\.[A-Za-z_][\w-]*|\['[^']+'\]|\[\d+\])+", path):
        raise ValueError(f"unsupported path {path}")
    found = [a or b or c for a, b, c in re.findall(r"\.([A-Za-z_][\w-]*)|\['([^']+)'\]|(\[\d+\])", path)]
    if found[0].startswith("["):
        raise ValueError(f"a path begins with a name: {path}")
    return found


def spark_pattern(text: str) -> str:
    """A bracketed time format, such as [year]-[month]-[day], as Spark's; other patterns stay."""
    if "[" not in text:
        return text
    out = ""
    for part, literal in re.findall(r"\[([^\]]+)\]|([^\[]+)", text):
        if part.startswith("subsecond"):
            digits = re.search(r"digits:(\d)", part)
            out += "S" * int(digits.group(1) if digits else 6)
        elif part:
            name = part.split()[0]
            if name == "offset_minute":
                continue
            if name not in TIME_PARTS:
                raise ValueError(f"unsupported time part [{part}]")
            out += TIME_PARTS[name]
        else:
            out += re.sub(r"([A-Za-z]+)", r"'\1'", literal)
    return out.replace("XXX:", "XXX")


def utc_time(text: Column, pattern: str) -> Column:
    """The instant of a text; without an offset in the pattern it is UTC, whatever the session's zone."""
    pattern = spark_pattern(pattern)
    parsed = F.try_to_timestamp(text, F.lit(pattern))
    return parsed if re.search(r"[XxOzV]", re.sub(r"'[^']*'", "", pattern)) else F.from_utc_timestamp(parsed, F.current_timezone())


def epoch_time(number: Column, unit: str) -> Column:
    """The instant of an integer epoch, floored to microseconds."""
    scale = EPOCHS[unit]
    micros = F.floor(number / (scale // 1_000_000)) if scale > 1_000_000 else number.cast("decimal(38,0)") * (1_000_000 // scale)
    in_range = F.abs(micros.cast("decimal(38,0)")) < F.lit(str(2**62)).cast("decimal(38,0)")
    return F.when(in_range, F.timestamp_micros(micros.cast("bigint")))


def exact_decimal(text: Column, precision: int, scale: int) -> Column:
    """The decimal of a text of digits, null where its digits or its scale do not fit."""
    shape = text.rlike(r"^-?\d+(\.\d+)?$")
    value = F.when(shape, text.try_cast(f"decimal({precision},{scale})"))
    fraction = F.regexp_replace(F.regexp_extract(text, r"\.(\d+)$", 1), "0+$", "")
    return F.when(shape & (F.length(fraction) <= scale), value)


def convert(f: Field, value: Column, kind: Column) -> Column:
    """The value of a variant in the field's type, null where its kind or its range is another."""
    get = lambda t: F.try_variant_get(value, "$", t)
    number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    whole = kind.startswith("BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)")
    text = kind.startswith("STRING")
    if f.type == "string":
        return F.when(text, get("string"))
    if f.type == "json":
        return F.to_json(value)
    if f.type == "boolean":
        return F.when(kind.startswith("BOOLEAN"), get("boolean"))
    if f.type in INTEGERS:
        lo, hi = INTEGERS[f.type]
        wide = get("decimal(38,0)") if f.type == "uint64" else get("bigint")
        bound = lambda x: F.lit(str(x)).cast("decimal(38,0)") if f.type == "uint64" else F.lit(x)
        return F.when(whole & wide.between(bound(lo), bound(hi)), wide).cast(f.spark_type)
    if f.type in ("float32", "float64"):
        wide = get("double")
        limit = 3.4028234663852886e38 if f.type == "float32" else 1.7976931348623157e308
        return F.when(number & (F.abs(wide) <= limit), wide).cast(f.spark_type)
    if f.type.startswith("decimal"):
        precision, scale = map(int, re.findall(r"\d+", f.type))
        return F.when(text, exact_decimal(get("string"), precision, scale))
    out = F.when(whole, epoch_time(get("bigint"), f.time)) if f.time in EPOCHS else F.when(text, utc_time(get("string"), f.time))
    return out.cast("date") if f.type == "date" else out


def framed(messages: DataFrame, framing: str) -> DataFrame:
    """One row per document, with message_index and its text in _line. A value that is no array is one document that is none."""
    text = F.col("value").cast("string")
    if framing == "json_lines":
        parts = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    elif framing == "json_array":
        found = F.from_json(text, "array<variant>")
        parts = F.when(found.isNotNull() & F.ltrim(text).startswith("["), F.transform(found, lambda v: F.to_json(v))).otherwise(F.array(text))
    elif framing == "single_document":
        parts = F.array(text)
    else:
        raise ValueError(f"unknown framing {framing}")
    return messages.select("*", F.posexplode(parts).alias("message_index", "_line"))


def parse(messages: DataFrame, parser: JsonParser, passed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of messages with a binary value and the metadata that parser.system names; `passed` columns go along as they are.

    Duplicate mapped root keys are an error; nested ones are too. Tombstones hold no document and give no rows. Dead letters are empty unless
    the policy is dlq. A missing system value is an error that stops the job.
    """
    mapped = sorted({f.root for f in parser.fields})
    rows = framed(messages.where(~F.coalesce(F.col("tombstone"), F.lit(False))) if "tombstone" in messages.columns else messages, parser.framing)
    doc = F.when(F.ltrim("_line").startswith("{"), F.from_json("_line", "map<string,variant>"))
    held = rows.select("*", F.explode(F.array(doc)).alias("_doc"))
    names = F.map_keys("_doc")
    known = F.filter(names, lambda k: k.isin(mapped))
    variants, checks = [], []
    for i, f in enumerate(parser.fields):
        v = F.try_element_at("_doc", F.lit(f.root))
        rest = steps(f.path)[1:] if f.path else []
        if rest:
            v = F.try_variant_get(v, "$" + "".join(s if s.startswith("[") else f"['{s}']" for s in rest), "variant")
        variants.append(F.struct(v.alias("v"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.schema_of_variant(v)).alias("kind")).alias(f"f{i}"))
    held = held.select("*", F.explode(F.array(F.struct(*variants, F.lit(0).alias("none")))).alias("_raw"))
    outs = [convert(f, F.col(f"_raw.f{i}.v"), F.col(f"_raw.f{i}.kind")).alias(f.name) for i, f in enumerate(parser.fields)]
    if parser.unknown == "collect":
        rest = F.map_filter("_doc", lambda k, _: ~k.isin(mapped)) if mapped else F.col("_doc")
        outs.append(F.coalesce(F.to_json(rest), F.lit("{}")).alias(parser.extra))
    held = held.select("*", F.explode(F.array(F.struct(*outs))).alias("_out"))
    error = F.when(F.col("_doc").isNull(), F.lit("not a JSON document")).when(F.size(known) > F.size(F.array_distinct(known)), F.lit("duplicate key"))
    if parser.unknown == "fail":
        other = F.filter(names, lambda k: ~k.isin(mapped))
        error = error.when(F.size(other) > 0, F.concat(F.lit("unknown field "), F.get(other, F.lit(0))))
    for i, f in enumerate(parser.fields):
        kind, out = F.col(f"_raw.f{i}.kind"), F.col("_out")[f.name]
        if not f.nullable:
            checks.append((kind.isNull(), f"{f.name} is missing"))
        checks.append((kind.isNotNull() & out.isNull(), f"{f.name} has another type or range"))
        if f.max_length is not None:
            checks.append((F.char_length(out.cast("string")) > f.max_length, f"{f.name} is too long"))
    for test, said in checks:
        error = error.when(test, F.lit(said))
    system = [F.col(c) for c in passed or []]
    for kind, name in parser.system.items():
        c = F.col(SYSTEM[kind])
        system.append(F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{kind} is missing"))).cast("bigint" if kind not in ("topic",) else "string").alias(name))
    # A generator keeps the filters below from pulling the parse up, which would run it once for each.
    held = held.select("*", F.explode(F.array(error)).alias("_error"))
    if parser.on_error == "fail":
        held = held.withColumn("_out", F.when(F.col("_error").isNull(), F.col("_out")).otherwise(F.raise_error(F.col("_error"))))
        good, bad = held, held.where(F.lit(False))
    else:
        good, bad = held.where("_error is null"), held.where(F.col("_error").isNotNull() if parser.on_error == "dlq" else F.lit(False))
    good = good.select("_out.*", *system)
    written = F.col("write_ts_ms") if "write_ts_ms" in messages.columns else F.lit(None)
    bad = bad.select(b64(F.col("_line")).alias("raw_base64"), F.col("_error").alias("error_message"), written.cast("bigint").alias("source_write_timestamp_ms"), *system)
    return good, bad


def envelope_dlq(messages: DataFrame, error: str) -> DataFrame:
    """Dead letters of whole messages (columns are fixed names) whose column `error` is not null."""
    headers = F.to_json(F.transform("headers", lambda h: F.struct(h["key"].alias("key"), b64(h["value"]).alias("value"))), {"ignoreNullFields": "false"})
    return messages.where(F.col(error).isNotNull()).select(
        b64(F.col("value")).alias("raw_base64"), F.col(error).alias("error_message"), F.col("write_ts_ms").alias("source_write_timestamp_ms"), b64(F.col("key")).alias("key_base64"),
        F.coalesce(headers, F.lit("[]")).alias("headers_json"), "tombstone", "topic", "partition", "offset",
    )
