"""Best-fit packing of documents into token sequences by exact complements.

Documents are tokenised and cut where they are longer than a sequence. What is packed is the histogram of piece lengths, which has at most
`capacity` entries whatever the input: patterns of lengths are found in it, each with the number of times it is used. A pattern starts
with the longest length left; single lengths, an index of pair sums, and triples through that index fill its gap exactly under the counts
still available; where no combination does, the best-fitting (longest) length goes in and the search goes on in the smaller gap. Pieces get their places by their
rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_id, keyed, materialize, partitions
from .textops import lean
from .tokens import default_path, encode, encoder

PIECES = "id long, t long, piece int, start long, length int, ids_crc32 long"


class Sums:
    """Index of the sums of two available lengths, from which triples follow as one length and a pair. Lengths only ever run out, so it is
    kept up to date by taking away; what it finds is checked against the counts that a pattern in the making leaves."""

    def __init__(self, count: np.ndarray):
        self.capacity = len(count) - 1
        self.lengths = np.flatnonzero(count)
        self.pairs = np.zeros(2 * len(count), np.int64)
        for i, x in enumerate(self.lengths.tolist()):
            self.pairs[x + self.lengths[i + 1 :]] += 1
            self.pairs[2 * x] += count[x] > 1

    def update(self, before: np.ndarray, after: np.ndarray) -> None:
        for x in np.flatnonzero((before > 1) & (after < 2)).tolist():
            self.pairs[2 * x] -= 1
        for x in np.flatnonzero((before > 0) & (after == 0)).tolist():
            self.lengths = self.lengths[self.lengths != x]
            self.pairs[x + self.lengths] -= 1

    def pair(self, gap: int, left: np.ndarray) -> list[int] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        x = self.lengths[: np.searchsorted(self.lengths, gap // 2, side="right")]
        y = gap - x
        ok = np.flatnonzero((left[x] > 0) & (left[y] > 0) & ((x != y) | (left[x] > 1)))
        return [int(y[ok[0]]), int(x[ok[0]])] if len(ok) else None

    def triple(self, gap: int, left: np.ndarray) -> list[int] | None:
        longest = self.lengths[: np.searchsorted(self.lengths, gap - 2, side="right")][::-1]
        longest = longest[(self.pairs[gap - longest] > 0) & (left[longest] > 0)]
        for a in longest.tolist():
            if 3 * a < gap:
                return None  # the two others would be longer
            left[a] -= 1
            found = self.pair(gap - a, left)
            left[a] += 1
            if found and found[0] <= a:
                return [a, *found]
        return None

    def complement(self, gap: int, left: np.ndarray) -> list[int] | None:
        """One, two or three available lengths that sum to gap exactly."""
        return [gap] if left[gap] > 0 else self.pair(gap, left) or self.triple(gap, left)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) that use up the histogram."""
    count = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        count[k] = v
    sums, out = Sums(count), []
    while len(sums.lengths):
        a = int(sums.lengths[-1])
        left, own, gap = count.copy(), [a], capacity - a
        left[a] -= 1
        while gap:
            found = sums.complement(gap, left)
            if found is None:
                fits = sums.lengths[: np.searchsorted(sums.lengths, gap, side="right")]
                fits = fits[left[fits] > 0]
                if not len(fits):
                    break
                found = [int(fits[-1])]
            for x in found:
                left[x] -= 1
            own += found
            gap -= sum(found)
        need = np.bincount(own, minlength=capacity + 1)
        used = need > 0
        times = int((count[used] // need[used]).min())
        before, count = count, count - times * need
        sums.update(before, count)
        out.append((times, own))
    return out


def places(found: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """By length and rank: from which rank on a run of pieces goes into which sequences, at which offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in found:
        offset = 0
        for x in lengths:
            rank = taken.get(x, 0)
            rows.append((x, rank, sequence, offset))
            taken[x] = rank + times
            offset += x
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "offset"))}


def tokenizing(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder(path).limit = 400_000
        for batch in batches:
            ids, ts = batch["id"].to_pylist(), batch["t"].to_pylist()
            rows = []
            for a, b, flat, bounds in encode(batch["text"], path):
                for i, lo, hi in zip(range(a, b), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    tokens = np.append(flat[lo:hi], np.uint32(end)).astype("<u4")
                    for piece, start in enumerate(range(0, len(tokens), capacity)):
                        own = tokens[start : start + capacity]
                        rows.append((ids[i], ts[i], piece, start, len(own), zlib.crc32(own.tobytes())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["id", "t", "piece", "start", "length", "ids_crc32"])
        encoder(path).clear()  # a worker that waits for other tasks holds no words

    return lean(run)


def _placing(table: dict[str, np.ndarray]):
    key = table["length"] << 40 | table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy().astype(np.int64), batch["rank"].to_numpy()
            i = np.searchsorted(key, length << 40 | rank, side="right") - 1
            sequence = table["sequence"][i] + rank - table["rank"][i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(table["offset"][i])], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece of every row of df.

    A null text is empty, so it has the end token only; null ids stay null; repeated rows are packed as often as they are there. Documents
    longer than capacity, however long, are cut into full pieces and a rest. Pieces of one length are placed in the order in which they
    are stored (ties are not told apart). Other columns are ignored; an empty table gives no rows. The driver gets the histogram of
    lengths, at most `capacity` rows.
    """
    spark = df.sparkSession
    pieces = materialize(keyed(df, id_col, text_col).mapInArrow(tokenizing(tokenizer or default_path(), capacity, end_id), PIECES), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(patterns(histogram, capacity))
    # Ranks within a length: each (length, chunk) is numbered alone, then moved on by the chunks before it, so no length makes a large group.
    chunk_count = max(partitions(spark), sum(histogram.values()) // 1_000_000)
    numbered = pieces.withColumn("place", F.monotonically_increasing_id()).withColumn("chunk", F.pmod(F.xxhash64("place"), F.lit(chunk_count)))
    counts = numbered.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("place")) - 1
    ranked = numbered.withColumn("own", own).join(before, ["length", "chunk"])
    ranked = ranked.select("id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    out = ranked.mapInArrow(_placing(table), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(doc_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
