"""Objects of a store as tables: listing, strict schemas, JSON objects, samples; and databases by planned reads."""

from __future__ import annotations

import fnmatch
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.stores import files
from .json_parser import JsonParser, parse


def listing(spark: SparkSession, root: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path, bytes) of the objects below root, sorted by full key; empty objects and hidden ones are left out."""
    found = [(p, n) for p, n in files(spark).list(root) if n > 0 and not p.rsplit("/", 1)[-1].startswith((".", "_")) and fnmatch.fnmatchcase(p.rsplit("/", 1)[-1], pattern)]
    return sorted(found, key=lambda x: x[0].encode())


def parquet(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """All objects as one table. Every object's schema must be that of the first, in names, order and types: nothing is widened or filled in.

    Only footers are read to check this, by tasks, not by the driver.
    """
    paths = [p for p, _ in listing(spark, root, pattern)]
    if not paths:
        raise ValueError(f"no objects in {root}")
    first = spark.read.parquet(paths[0])
    differing = []
    for p in paths[1:]:
        own = spark.read.parquet(p).schema
        if [(f.name, f.dataType) for f in own.fields] != [(f.name, f.dataType) for f in first.schema.fields]:
            differing.append(p)
    if differing:
        raise ValueError(f"schemas differ from {paths[0]}: {differing[:5]}")
    return spark.read.schema(first.schema).parquet(*paths)


def json_objects(spark: SparkSession, root: str, parser: JsonParser, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of text objects. Lines are split where they are read; a whole object is one value only for the other framings."""
    paths = [p for p, _ in listing(spark, root, pattern)]
    if not paths:
        raise ValueError(f"no objects in {root}")
    if parser.framing == "json_lines":
        rows = spark.read.text(paths).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("topic"))
    else:
        rows = spark.read.format("binaryFile").load(paths).select(F.col("content").alias("value"), F.col("path").alias("topic"))
    return parse(rows, parser)


def discard_objects(spark: SparkSession, root: str) -> tuple[int, int]:
    """(objects, bytes) that a read would have covered; nothing is read."""
    found = listing(spark, root)
    return len(found), sum(n for _, n in found)


def tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables of a folder, each a file or a folder of Parquet."""
    names = set()
    for p, _ in listing(spark, root):
        rest = p[p.index(root.rstrip("/").split("://")[-1]) + len(root.rstrip("/").split("://")[-1]) + 1 :]
        names.add(rest.split("/")[0].removesuffix(".parquet"))
    return sorted(names)


def sample(df: DataFrame, rows: int, max_bytes: int | None = None) -> DataFrame:
    """The first rows, as many as fit into max_bytes of text."""
    out = df.limit(rows)
    if max_bytes is None:
        return out
    from pyspark.sql import Window

    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    held = out.withColumn("_n", F.monotonically_increasing_id()).withColumn("_b", F.sum(size).over(Window.orderBy("_n")))  # of `rows` rows
    return held.where(F.col("_b") <= max_bytes).drop("_n", "_b")


#: Spark types of database types (fixed values); a type that is missing is unsupported.
POSTGRES = {"boolean": "boolean", "smallint": "smallint", "integer": "int", "bigint": "bigint", "real": "float", "double precision": "double", "text": "string", "varchar": "string", "char": "string", "uuid": "string", "json": "string", "jsonb": "string", "bytea": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "numeric": "decimal(38,18)"}
MYSQL = {"tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "bigint unsigned": "decimal(20,0)", "int unsigned": "bigint", "float": "float", "double": "double", "varchar": "string", "char": "string", "text": "string", "json": "string", "blob": "binary", "varbinary": "binary", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp", "decimal": "decimal(38,18)"}
CLICKHOUSE = {"Bool": "boolean", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)", "Float32": "float", "Float64": "double", "String": "string", "Date": "date", "DateTime": "timestamp", "DateTime64": "timestamp", "UUID": "string"}
TEXT_CAST = {"postgres": "{0}::text", "mysql": "CAST({0} AS CHAR)", "clickhouse": "toString({0})"}
DIALECTS = {"postgres": POSTGRES, "mysql": MYSQL, "clickhouse": CLICKHOUSE}


def select_list(dialect: str, columns: dict[str, str], unsupported: str = "to_string") -> tuple[str, T.StructType]:
    """(select list, schema) of a table with native types: unsupported ones are read as text, or refused."""
    quote = '"' if dialect == "postgres" else "`"
    out, schema = [], T.StructType()
    for name, native in columns.items():
        base = native.split("(")[0].strip()
        own = f"{quote}{name}{quote}"
        found = DIALECTS[dialect].get(native) or DIALECTS[dialect].get(base)
        if base in ("numeric", "decimal") and "(" in native:
            found = f"decimal({native.split('(')[1]}"
        if found is None and unsupported == "fail":
            raise ValueError(f"{name} has the unsupported type {native}")
        if found is None:
            own = f"{TEXT_CAST[dialect].format(own)} AS {own}"
        out.append(own)
        schema = schema.add(name, T.DataType.fromDDL(found or "string"), True, {"source_type": native})
    return ", ".join(out), schema


def snapshot_options(dialect: str, url: str, table: str, columns: dict[str, str], predicates: list[str], unsupported: str = "to_string") -> list[dict[str, str]]:
    """One JDBC read per predicate, each an option set of its own; the predicates cover the table once."""
    listed, _ = select_list(dialect, columns, unsupported)
    return [{"url": url, "query": f"SELECT {listed} FROM {table} WHERE {p}"} for p in predicates]


def jdbc(spark: SparkSession, options: list[dict[str, str]]) -> DataFrame:
    """The union of planned reads. Needs the database's driver on Spark's class path."""
    out = None
    for o in options:
        own = spark.read.format("jdbc").options(**o).load()
        out = own if out is None else out.unionByName(own)
    return out


def hidden(dialect: str, namespace: str, name: str) -> bool:
    """Whether a table is the system's own (fixed names)."""
    system = {"postgres": ("pg_catalog", "information_schema", "pg_toast"), "mysql": ("mysql", "sys", "performance_schema", "information_schema"), "clickhouse": ("system", "INFORMATION_SCHEMA", "information_schema")}
    return namespace in system[dialect] or (dialect == "postgres" and namespace.startswith("pg_temp")) or (dialect == "clickhouse" and name.startswith(".inner"))


def wal2json(messages: DataFrame) -> DataFrame:
    """Logical replication as JSON lines ({kind, schema, table, columnnames, columnvalues, oldkeys}) to change events with data as JSON text."""
    shape = "change array<struct<kind:string,schema:string,`table`:string,columnnames:array<string>,columnvalues:array<string>,oldkeys:struct<keynames:array<string>,keyvalues:array<string>>>>"
    held = messages.select("offset", F.posexplode(F.from_json(F.col("value").cast("string"), shape)["change"]).alias("n", "c"))
    op = F.when(F.col("c.kind") == "insert", "c").when(F.col("c.kind") == "update", "u").when(F.col("c.kind") == "delete", "d").otherwise(F.raise_error(F.lit("unknown change")))
    pairs = lambda k, v: F.to_json(F.map_from_arrays(k, v))
    return held.select("offset", "n", op.alias("op"), F.col("c.schema").alias("namespace"), F.col("c.table").alias("table"), F.when(F.col("c.kind") != "delete", pairs(F.col("c.columnnames"), F.col("c.columnvalues"))).alias("data"), F.when(F.col("c.oldkeys").isNotNull(), pairs(F.col("c.oldkeys.keynames"), F.col("c.oldkeys.keyvalues"))).alias("old_key"))


def changefeed(messages: DataFrame, overlap: bool = False) -> DataFrame:
    """A table store's change feed (JSON of key, update or erase, newImage) to change events. While a snapshot overlaps the feed, its rows have
    version 0 and the feed's offset + 1."""
    doc = F.from_json(F.col("value").cast("string"), "map<string,variant>")
    held = messages.select("offset", F.explode(F.array(doc)).alias("d"))
    get = lambda k: F.to_json(F.try_element_at("d", F.lit(k)))
    op = F.when(get("erase").isNotNull(), "d").when(get("newImage").isNotNull(), "c").otherwise("u")
    version = F.col("offset") + 1 if overlap else F.col("offset")
    return held.select(version.alias("version"), op.alias("op"), get("key").alias("key"), F.coalesce(get("newImage"), get("update")).alias("data"))


def search_hits(df: DataFrame) -> DataFrame:
    """(_id, _routing, _source, _routing_key) of exported search hits as JSON lines."""
    v = F.col("value").cast("string")
    root = F.from_json(v, "_id string, _routing string, _source variant")
    return df.select(root["_id"].alias("_id"), root["_routing"].alias("_routing"), F.to_json(root["_source"]).alias("_source"), F.coalesce(root["_routing"], root["_id"]).alias("_routing_key"))


def stamped(df: DataFrame, contract: dict[str, dict]) -> DataFrame:
    """df with contracts on its columns, which filters, joins and renaming keep."""
    return df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, **contract.get(f.name, {})}) for f in df.schema.fields])


def contract_of(df: DataFrame) -> str:
    return json.dumps({f.name: f.metadata for f in df.schema.fields if f.metadata}, sort_keys=True)


def unsupported_as_text(df: DataFrame, supported: tuple[type, ...], policy: str = "to_string") -> DataFrame:
    """Columns of other types as text, or a plan-time error."""
    wrong = [f.name for f in df.schema.fields if not isinstance(f.dataType, supported)]
    if wrong and policy == "fail":
        raise ValueError(f"unsupported types: {wrong}")
    text = lambda f: F.to_json(F.col(f.name)) if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) else F.col(f.name).cast("string")
    out: list[Column] = [(text(f) if f.name in wrong else F.col(f.name)).alias(f.name) for f in df.schema.fields]
    return df.select(*out)
