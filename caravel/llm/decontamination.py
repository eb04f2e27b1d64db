"""Benchmark decontamination: n-gram seeds join training passages to test items, Smith-Waterman alignment scores the candidates.

Every n-gram of an item is a seed, however many documents hold it. A passage around the seeds of an item is as wide as an alignment through
them can be, and is aligned with the item word by word unless the words that it shares with the item are too few or too far apart to reach
the threshold; the score is the best local alignment over the best possible one, so edited and paraphrased copies are found. What shares no n
words in a row with the item is not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, doc_id, keyed, materialize
from .textops import Rolling, chunks, lean, mix, word_hashes, words

HITS = "id long, t long, item_id long, score double, start_word long, end_word long"
MATCH, OTHER, GAP = 1.0, -0.5, -0.5
#: Bytes of items that are sent to all tasks at once; more items go in blocks.
ITEM_BYTES = 32 << 20


class Items:
    """A block of test items, as words and n-grams."""

    def __init__(self, rows: list[tuple[int | None, bytes]], n: int):
        self.n = n
        self.ids, self.words, grams, owners, places = [], [], [], [], []
        for i, text in rows:
            data = np.frombuffer(text, np.uint8)
            starts, ends, _ = words(data, np.array([0, len(data)]))
            w = word_hashes(data, starts, ends, lower=True)
            if not len(w):
                continue
            g = mix(Rolling(w).grams(n)) if len(w) >= n else mix(Rolling(w).grams(len(w)))
            grams.append(g), owners.append(np.full(len(g), len(self.ids))), places.append(np.arange(len(g)))
            self.ids.append(i), self.words.append(w)
        cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owners, places)]
        o = np.argsort(cat[0], kind="stable")
        self.grams, self.owner, self.place = cat[0][o].astype(np.uint64), cat[1][o], cat[2][o]
        self.distinct = np.unique(self.grams)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.short = sorted({len(w) for w in self.words if len(w) < n})

    def positions(self, w: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document's words of n-grams (or of whole shorter items) that are in a sorted table, and their n-grams."""
        at, found = [], []
        for k in (self.n, *self.short):
            g = mix(Rolling(w).grams(k)) if len(w) >= k else np.zeros(0, np.uint64)
            if len(g) and len(table):
                i = np.minimum(np.searchsorted(table, g), len(table) - 1)
                hit = np.flatnonzero(table[i] == g)
                at.append(hit), found.append(g[hit])
        return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment's score and the end of it in passage."""
    before = np.zeros(len(passage) + 1)
    slope = GAP * np.arange(len(passage) + 1)
    best, end = 0.0, 0
    for w in item:
        now = np.zeros(len(passage) + 1)
        now[1:] = before[:-1] + np.where(passage == w, MATCH, OTHER)
        now = np.maximum(np.maximum(now, before + GAP), 0.0)
        now = np.maximum.accumulate(now - slope) + slope  # gaps within the row
        j = int(now.argmax())
        if now[j] > best:
            best, end = float(now[j]), j
        before = now
    return best, end


def _candidates(items: Items, w: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(item, from, to): passages that hold every alignment of threshold or more through a seed of the item; those that meet are one."""
    at, g = items.positions(w, items.distinct)
    if not len(at):
        return
    lo, hi = np.searchsorted(items.grams, g, side="left"), np.searchsorted(items.grams, g, side="right")
    count = hi - lo
    where = np.repeat(at, count)
    which = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    owner, begin = items.owner[which], where - items.place[which]
    o = np.lexsort((begin, owner))
    owner, begin = owner[o], begin[o]
    size = items.size[owner]
    slack = np.floor((MATCH - threshold) * size / -max(OTHER, GAP)).astype(np.int64)  # no more words are inserted, or the score is too low
    first, last = np.maximum(0, begin - slack), np.minimum(len(w), begin + size + slack)
    cuts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (first[1:] > last[:-1])))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(o)).tolist(), strict=True):
        yield int(owner[a]), int(first[a]), int(last[b - 1])


def bound(item: np.ndarray, passage: np.ndarray) -> float:
    """What no alignment exceeds: the best stretch of the passage, were each word that the item has a match, each other one an edit."""
    total = np.cumsum(np.where(np.isin(passage, item), MATCH, max(OTHER, GAP)))
    return float((total - np.minimum.accumulate(np.append(0.0, total[:-1]))).max()) if len(total) else 0.0


def hits(items: Items, w: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
    """The best alignment with each item that reaches the threshold: score, first word, word after the last."""
    found: dict[int, tuple[float, int, int]] = {}
    for k, a, b in _candidates(items, w, threshold):
        item, passage = items.words[k], w[a:b]
        need = threshold * len(item)
        if bound(item, passage) < need:
            continue
        score, end = align(item, passage)
        if score >= need and score / len(item) > found.get(k, (0.0,))[0]:
            _, back = align(item[::-1], passage[:end][::-1])
            found[k] = (score / len(item), a + end - back, a + end)
    return found


def _documents(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, np.ndarray]]:
    return _texts(batch[text_col])


def _texts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for a, b, data, bounds in chunks(texts):
        starts, ends, first = words(data, bounds)
        w = word_hashes(data, starts, ends, lower=True)
        for i in range(a, b):
            yield i, w[first[i - a] : first[i - a + 1]]


def _blocks(items: DataFrame, item_col: str, text_col: str, n: int) -> Iterator[Items]:
    """Items in blocks of a checked size, in the order of their ids."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("b")).distinct().orderBy("i", "b")
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r["i"], bytes(r["b"])))
        size += len(r["b"])
        if size >= ITEM_BYTES:
            yield Items(held, n)
            held, size = [], 0
    if held:
        yield Items(held, n)


def benchmark_hits(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 3, share: float = 0.001, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each document with each test item it holds.

    score: local alignment (match 1, other word -0.5, gap -0.5) over the item's number of words, threshold or more. Words are compared with
    A-Z lower-cased. Null or empty texts hold nothing; null ids stay null; repeated rows give one row; items with null text are ignored,
    repeated items count once; empty tables give no rows; other columns are ignored; texts of any length are searched whole. Of alignments that
    tie, the first passage's counts. share has no effect: seeds are not chosen by frequency. Items go to all tasks in blocks of ITEM_BYTES.
    """
    docs = keyed(df, id_col, text_col)
    out, blocks = None, _blocks(items, item_col, text_col, n)
    block = next(blocks, None)
    while block is not None:

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(batch["id"][i].as_py(), batch["t"][i].as_py(), block.ids[k], *h) for i, w in _documents(batch, "text") for k, h in hits(block, w, threshold).items()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["id", "t", "item_id", "score", "start_word", "end_word"])

        own = docs.mapInArrow(lean(run), HITS)
        block = next(blocks, None)
        if block is not None:  # one block at a time is held and sent
            own = materialize(own, "hits")
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = df.sparkSession.createDataFrame([], HITS)
    return out.distinct().select(doc_id().alias("doc_id"), "item_id", "score", "start_word", "end_word")


def _clean(block: Items, threshold: float):
    def run(texts: pa.Array) -> pa.Array:
        clean = np.ones(len(texts), bool)
        for i, w in _texts(texts):
            clean[i] = not hits(block, w, threshold)
        return pa.array(clean)

    return run


def decontaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 3, share: float = 0.001, threshold: float = 0.5) -> DataFrame:
    """The rows of df, all columns, that hold no test item (see benchmark_hits)."""
    bounded(df.sparkSession)
    df, blocks = df.withColumn(text_col, F.col(text_col).cast("string")), _blocks(items, item_col, text_col, n)
    block = next(blocks, None)
    while block is not None:
        df = df.where(F.arrow_udf(_clean(block, threshold), "boolean")(F.col(text_col)))
        block = next(blocks, None)
        if block is not None:
            df = materialize(df, "clean")
    return df
