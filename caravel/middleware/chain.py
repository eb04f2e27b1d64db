"""Transforms of data sets: what one is, how they are registered, the chain that applies them per table, and its preview."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import filter_eq
from ..operators.identity import TableId, rename, union_renamed
from ..plans.sqlgate import run_sql

#: Keys of a column's contract that survive a transform where name and type are the same (fixed values).
CONTRACT = ("primary_key", "low_cardinality", "max_length", "arrow_extension")


@dataclass(frozen=True)
class Dataset:
    """A table on its way: its identity, its rows, and whether it is a changelog or dead letters."""

    table: TableId
    df: DataFrame
    role: str = "main"

    @property
    def key(self) -> list[str]:
        return [f.name for f in self.df.schema.fields if f.metadata.get("primary_key") is True]


class Transform(Protocol):
    """identity() and schema() are known before any data; apply() says how rows change."""

    def identity(self, table: TableId) -> TableId: ...

    def schema(self, df: DataFrame) -> T.StructType: ...

    def apply(self, df: DataFrame) -> DataFrame: ...


class Base:
    def identity(self, table: TableId) -> TableId:
        return table

    def apply(self, df: DataFrame) -> DataFrame:
        return df

    def schema(self, df: DataFrame) -> T.StructType:
        """Of the transform over no rows: nothing runs."""
        return self.apply(df.limit(0)).schema


@dataclass
class Filter(Base):
    field: str
    value: str

    def apply(self, df: DataFrame) -> DataFrame:
        return filter_eq(df, self.field, self.value)


@dataclass
class Sql(Base):
    query: str

    def apply(self, df: DataFrame) -> DataFrame:
        return restamped(run_sql(df, self.query), df)


@dataclass
class RenameTable(Base):
    """Exact (a whole identity, or the last part alone) or, with regex, all matches in the qualified text."""

    source: str
    target: str
    regex: bool = False

    def identity(self, table: TableId) -> TableId:
        if self.regex:
            return rename(table, self.source, self.target)
        if table.text() == self.source:
            return TableId.parse(self.target)
        if TableId(None, table.name).text() == self.source and table.namespace is not None:
            return TableId(table.namespace, TableId.parse(self.target).name)
        return table


def restamped(out: DataFrame, before: DataFrame) -> DataFrame:
    """Columns keep the contract of the column of their name and type, and no other."""
    known = {(f.name, f.dataType.simpleString()): f.metadata for f in before.schema.fields}
    kept = lambda f: {k: v for k, v in known.get((f.name, f.dataType.simpleString()), {}).items() if k in CONTRACT}
    return out.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=kept(f)) for f in out.schema.fields])


class Registry:
    """Kinds of transforms, parsers or connectors by name; a configuration is checked against the kind's fields."""

    def __init__(self) -> None:
        self.kinds: dict[str, type] = {}

    def register(self, name: str, kind: type) -> type:
        if name in self.kinds:
            raise ValueError(f"{name} is registered already")
        if not is_dataclass(kind):
            raise ValueError(f"{kind.__name__} has no typed configuration")
        self.kinds[name] = kind
        return kind

    def make(self, name: str, config: dict[str, Any]) -> Any:
        if name not in self.kinds:
            raise ValueError(f"unknown kind {name}; known are {sorted(self.kinds)}")
        allowed = {f.name for f in fields(self.kinds[name]) if f.init}
        if set(config) - allowed:
            raise ValueError(f"{name} has no settings {sorted(set(config) - allowed)}")
        return self.kinds[name](**config)


transforms = Registry()
transforms.register("filter", Filter)
transforms.register("sql", Sql)
transforms.register("rename_table", RenameTable)


@dataclass
class Step:
    transform: Transform
    tables: str = "*"  # which tables, by what they are called when the step begins

    def concerns(self, table: TableId) -> bool:
        return fnmatch.fnmatchcase(table.text(), self.tables)


@dataclass
class Chain:
    steps: list[Step] = field(default_factory=list)

    @staticmethod
    def of(configs: list[dict[str, Any]], registry: Registry = transforms) -> Chain:
        return Chain([Step(registry.make(c["type"], c.get("config", {})), c.get("tables", "*")) for c in configs])

    def _one(self, d: Dataset, steps: list[Step]) -> Dataset:
        for s in steps:
            if s.concerns(d.table):
                d = Dataset(s.transform.identity(d.table), s.transform.apply(d.df), d.role)
        return d

    def plan(self, datasets: list[Dataset]) -> dict[TableId, T.StructType]:
        """Tables and schemas that come out; conflicts are found here, before any row is read."""
        return {t: d.df.schema for t, d in self.apply([Dataset(d.table, d.df.limit(0), d.role) for d in datasets]).items()}

    def apply(self, datasets: list[Dataset]) -> dict[TableId, Dataset]:
        """All steps over all data sets; tables that get one name are one table, if their schemas are equal and have no key."""
        out: dict[TableId, list[Dataset]] = {}
        for d in datasets:
            done = self._one(d, self.steps)
            out.setdefault(done.table, []).append(done)
        return {t: Dataset(t, union_renamed([d.df for d in ds], any(d.key for d in ds)), ds[0].role) for t, ds in out.items()}

    def preview(self, dataset: Dataset, through: int, rows: int = 20) -> tuple[list[dict[str, str | None]], list[dict[str, str | None]]]:
        """Cells before and after step number `through`, from the first rows of the data set; SQL sees only those."""
        first = Dataset(dataset.table, dataset.df.limit(rows), dataset.role)
        before = self._one(first, self.steps[: through - 1])
        return cells(before.df, rows), cells(self._one(before, self.steps[through - 1 : through]).df, rows)


def exact(df: DataFrame) -> DataFrame:
    """Every cell as a text that tells values apart: nested values as JSON, binary in hex. Repeated names are an error."""
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("column names are not unique")
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.concat(F.lit("0x"), F.hex(c))
        elif isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType):
            c = F.to_json(c, {"ignoreNullFields": "false"})
        out.append(c.cast("string").alias(f.name))
    return df.select(*out)


def cells(df: DataFrame, rows: int) -> list[dict[str, str | None]]:
    return [r.asDict() for r in exact(df).limit(max(0, rows)).collect()]


def non_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; a null where the contract has none stops the job."""
    checked = {c: F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`")).otherwise(F.raise_error(F.lit(f"{c} is null")).cast(df.schema[c].dataType)) for c in columns}
    return df.withColumns(checked)


def row_counts(datasets: dict[TableId, Dataset]) -> dict[tuple[str, str], int]:
    """Rows of each (role, table), each counted in one pass of its own."""
    return {(d.role, t.text()): d.df.count() for t, d in datasets.items()}


def merged_counts(*parts: dict[tuple[str, str], int]) -> dict[tuple[str, str], int]:
    """Counts of retried batches, added up."""
    out: dict[tuple[str, str], int] = {}
    for p in parts:
        for k, v in p.items():
            out[k] = out.get(k, 0) + v
    return out


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, least_bytes, most_bytes, bytes) of all columns in one pass."""
    stats = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        text = c if isinstance(f.dataType, T.BinaryType) else F.to_json(c) if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) else c.cast("string")
        size = F.octet_length(text)
        stats.append(F.struct(F.lit(f.name).alias("column"), F.count("*").alias("rows"), F.count(F.when(c.isNull(), 1)).alias("nulls"), F.min(size).alias("least_bytes"), F.max(size).alias("most_bytes"), F.sum(size).alias("bytes")))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def source_preview(tables: dict[TableId, Callable[[], DataFrame]], table: TableId, rows: int, max_bytes: int = 1 << 20) -> list[dict[str, str | None]]:
    """The first cells of a table, within limits on rows and bytes of text."""
    out, held = [], 0
    for r in cells(tables[table](), rows):
        held += sum(len(v.encode()) for v in r.values() if v is not None)
        if held > max_bytes:
            break
        out.append(r)
    return out
