"""Vectorised hashing of bytes and words in numpy: everything here works on many documents laid end to end."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: Bytes of text laid end to end at a time; a longer document is taken alone, and hashed in parts of as many symbols.
CHUNK = 1 << 18

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    a = np.full(n + 1, base, np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a, out=a)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n; those of a longer sequence are not kept."""
    if n > 2 * CHUNK:
        return _power(BASE, n), _power(INVERSE, n)
    if not _powers:
        _powers.update(up=_power(BASE, 2 * CHUNK), down=_power(INVERSE, 2 * CHUNK))
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def lean(run: Callable) -> Callable:
    """Gives a task's memory back to the system at its end: workers are used again, and what each holds on to would add up."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return lean_run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def steady() -> None:
    """Keeps up to 64 MB that are freed, until release(): arrays of a MB that are made again and again are then not paged in each time."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-1, 64 << 20)
        libc.mallopt(-3, 32 << 20)
    except (OSError, AttributeError):  # another C library
        return


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes of those rows end to end, their bounds) without copying; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        bounds = offsets[at : to + 1]
        yield at, to, data[bounds[0] : bounds[-1]], bounds - bounds[0]
        at = to


def segments(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """As chunks(), but a document of more than twice the limit comes in several, cut at white space; the last field is false but for its last."""
    for a, b, data, bounds in chunks(texts, limit):
        if len(data) <= 2 * limit:
            yield a, b, data, bounds, True
            continue
        at = 0
        while at < len(data):
            to = at + limit
            while to < len(data) and not (space := np.flatnonzero(SPACE[data[to : to + limit]])).size:
                to += limit
            to = min(len(data), to + int(space[0])) if to < len(data) else len(data)
            yield a, b, data[at:to], np.array([0, to - at]), to == len(data)
            at = to


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the index of its first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]  # a word that would run over the end of a document
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, np.unique(cut)])), np.sort(np.concatenate([ends, np.unique(cut)]))
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    if len(data) > 2 * CHUNK and len(starts) > 1:  # in parts, cut between words
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), CHUNK)), len(starts)))
        parts = ((a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return np.concatenate([word_hashes(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a], lower) if (a, b) != (0, len(starts)) else _word_hashes(data, starts, ends, lower) for a, b in parts])
    return _word_hashes(data, starts, ends, lower)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    values = BYTE_VALUE[LOWER[data]] if lower else BYTE_VALUE[data]
    return mix(Rolling(values).of(starts, ends) + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each document its distinct n-word shingle hashes in ascending order; a shorter document is one shingle, an empty one none."""
    roll = Rolling(hashes)
    grams = mix(roll.grams(n))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(roll.of(np.array([a]), np.array([b])) + np.uint64(b - a)))
        else:
            out.append(grams[:0])
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, … lengths[0] of them, then those of the next."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
