"""Row filters with plan-time checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filter_eq(df: DataFrame, field: str, value: str) -> DataFrame:
    """Rows whose string column equals value; nulls never pass. A missing column or another type is an error before any job runs."""
    found = {f.name: f.dataType for f in df.schema.fields}.get(field)
    if found is None:
        raise ValueError(f"no column {field!r}")
    if not isinstance(found, T.StringType):
        raise ValueError(f"column {field!r} is {found.simpleString()}, not a string")
    return df.where(F.col(f"`{field}`") == F.lit(value))
