"""Durable records of a delivery: values with compare-exchange, leases, phases, admission of schemas, and retries."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sinks.stores import files

PHASES = ("snapshot", "streaming")


class Fatal(RuntimeError):
    """Trying again will not help."""


class Durable:
    """Versions of small JSON values in a shared folder. A version is created once, so of two writers one succeeds."""

    def __init__(self, spark: SparkSession, root: str):
        self.store, self.root = files(spark), root

    def _versions(self, key: str) -> list[str]:
        return [p for p, _ in self.store.list(f"{self.root}/{key}") if p.endswith(".json")]

    def get(self, key: str) -> tuple[int, object]:
        """(version, value); version 0 for a key that is not there."""
        found = self._versions(key)
        return (int(found[-1].rsplit("/", 1)[-1][:-5]), json.loads(self.store.read(found[-1]))["value"]) if found else (0, None)

    def exchange(self, key: str, version: int, value: object) -> bool:
        """Sets the value if the version is still the newest."""
        return self.get(key)[0] == version and self.store.create(f"{self.root}/{key}/{version + 1:020d}.json", json.dumps({"value": value}))

    def lease(self, key: str, owner: str, seconds: float, now: Callable[[], float] = time.time) -> bool:
        """Takes or renews a lease; another owner's stands until it runs out."""
        version, held = self.get(key)
        if held and held["owner"] != owner and held["until"] > now():
            return False
        return self.exchange(key, version, {"owner": owner, "until": now() + seconds})


def snapshot_then_stream(durable: Durable, name: str, snapshot: Callable[[], object], stream: Callable[[object], object]) -> object:
    """Runs the snapshot once, records the position that it gives, and streams from there; a restart after the snapshot goes on with the stream."""
    version, held = durable.get(name)
    if held is None or held["phase"] == PHASES[0]:
        position = snapshot()
        if not durable.exchange(name, version, {"phase": PHASES[1], "position": position}):
            raise Fatal("another worker moved the phase")
        held = {"phase": PHASES[1], "position": position}
    return stream(held["position"])


class Admission:
    """Which schema each table is written with. A batch with another schema waits until the sink has taken all before it, then is admitted."""

    def __init__(self, durable: Durable, drain: Callable[[str], None]):
        self.durable, self.drain = durable, drain

    def admit(self, table: str, df: DataFrame) -> bool:
        """True if the table's schema is new; widening or narrowing a column is fatal, added nullable columns are admitted."""
        own = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        version, held = self.durable.get(f"schema-{table}")
        if held == own:
            return False
        if held and any(own.get(k) != v for k, v in held.items()):
            raise Fatal(f"{table}: columns changed from {held} to {own}")
        self.drain(table)
        if not self.durable.exchange(f"schema-{table}", version, own):
            raise Fatal(f"{table}: another worker admitted a schema")
        return True


def retried(run: Callable[[], object], progress: Callable[[], object], attempts: int = 10, first: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> object:
    """Runs until it succeeds; waits grow from `first` to `most` seconds with jitter, and begin anew when there was durable progress in between."""
    tried, at = 0, progress()
    while True:
        try:
            return run()
        except Fatal:
            raise
        except Exception:
            now = progress()
            tried, at = (1, now) if now != at else (tried + 1, at)
            if tried >= attempts:
                raise
            sleep(min(most, first * 2 ** (tried - 1)) * (0.5 + draw() / 2))


def contiguous(done: set[int], committed: int) -> int:
    """The greatest id up to which all are done; ids that were never given out are fatal."""
    if any(i <= committed for i in done):
        raise Fatal("a committed id is done again")
    while committed + 1 in done:
        committed += 1
    return committed


def deduplicated(df: DataFrame, coordinate: tuple[str, ...] = ("topic", "partition", "offset", "message_index"), watermark: tuple[str, str] | None = None) -> DataFrame:
    """One row for each source coordinate; of a stream, within the watermark (column, delay), so that its state is bounded."""
    if df.isStreaming and watermark:
        return df.withWatermark(*watermark).dropDuplicatesWithinWatermark(list(coordinate))
    return df.dropDuplicates(list(coordinate))
