"""Typed rows to bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Types that have no JSON form of their own (fixed values).
UNSUPPORTED = (T.BinaryType, T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.VariantType)


def ndjson(df: DataFrame) -> Column:
    """One JSON object with explicit nulls. Dates are days and times microseconds, as integers; non-finite numbers stop the job; types without a
    JSON form are refused before any row."""
    wrong = [f.name for f in df.schema.fields if isinstance(f.dataType, UNSUPPORTED)]
    if wrong:
        raise ValueError(f"columns have no JSON form: {wrong}")
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{f.name} is not finite"))).otherwise(c)
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, T.DateType):
            c = F.unix_date(c)
        cols.append(c.alias(f.name))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def debezium(op: Column, before: Column, after: Column, ts_ms: Column) -> Column:
    return F.to_json(F.struct(before.alias("before"), after.alias("after"), op.alias("op"), ts_ms.alias("ts_ms")), {"ignoreNullFields": "false"})


def record_time_path(ts: Column, window_seconds: int, pattern: str = "yyyy/MM/dd/HH") -> Column:
    """The tumbling slot of a record, as a path."""
    slot = F.floor(F.unix_seconds(ts.cast("timestamp")) / window_seconds) * window_seconds
    return F.date_format(F.timestamp_seconds(slot), pattern)
