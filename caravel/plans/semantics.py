"""Delivery guarantees, inferred from what source and sink can do."""

from __future__ import annotations

AT_LEAST_ONCE = {"clickhouse", "opensearch", "postgres", "mysql", "ydb", "ytsaurus", "kafka", "logbroker"}


def guarantee(source: str, sink: str, changelog: bool = False, wall_clock_rotation: bool = False) -> str:
    """none, at_least_once or exactly_once."""
    if sink == "discard":
        return "none"
    if sink == "iceberg":
        return "exactly_once" if changelog and source in ("postgres", "mysql") else "at_least_once"
    if sink == "s3":
        return "exactly_once" if source == "logbroker" and not wall_clock_rotation else "at_least_once"
    if sink in AT_LEAST_ONCE:
        return "at_least_once"
    raise ValueError(f"unknown sink {sink!r}")
