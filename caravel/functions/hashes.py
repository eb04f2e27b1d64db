"""128-bit MurmurHash3 (x64 variant) of bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of the public algorithm (fixed values).
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
MASK = 0xFFFFFFFFFFFFFFFF


def _turned(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & MASK


def _final(k: int) -> int:
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = ((k ^ (k >> 33)) * c) & MASK
    return k ^ (k >> 33)


def murmur3_x64_128(data: bytes, seed: int = 0) -> bytes:
    """16 bytes, both halves big-endian."""
    a = b = seed
    full = len(data) // 16 * 16
    part = lambda x, c, r, d: (_turned(x * c & MASK, r) * d) & MASK
    for i in range(0, full, 16):
        x, y = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        a ^= part(x, C1, 31, C2)
        a = ((_turned(a, 27) + b) * 5 + 0x52DCE729) & MASK
        b ^= part(y, C2, 33, C1)
        b = ((_turned(b, 31) + a) * 5 + 0x38495AB5) & MASK
    rest = data[full:]
    if len(rest) > 8:
        b ^= part(int.from_bytes(rest[8:], "little"), C2, 33, C1)
    if rest:
        a ^= part(int.from_bytes(rest[:8], "little"), C1, 31, C2)
    a, b = a ^ len(data), b ^ len(data)
    a = (a + b) & MASK
    b = (b + a) & MASK
    a, b = _final(a), _final(b)
    a = (a + b) & MASK
    b = (b + a) & MASK
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def murmur3(c: Column, seed: int = 0) -> Column:
    """The hash of a text or binary column; null stays null. Spark has the 32-bit hash only."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else murmur3_x64_128(v, seed) for v in values.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(c.cast("binary"))
