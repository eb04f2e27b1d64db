"""Removal of repeated word spans by suffix automata of reference shards.

A reference shard holds the phrases of one bucket of triggers: every window of `length` words lies in exactly one phrase, and equal windows
lie in phrases with equal triggers, so a document's phrases need to be streamed through the automata of their own buckets only. An
automaton is bounded by its bucket and goes where the phrases of that bucket go: broadcasting the automata of all shards to all
documents would cost the square of the corpus. Within a bucket, phrases are streamed in the order of their documents: the matching
statistics against the automaton of all smaller ids decide, then the phrases join the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_id, keyed
from .phrases import heads
from .repeats import covered, repeated
from .textops import chunks, lean, words

SCHEMA = "id long, n_words long, n_removed long, kept string"


class SuffixAutomaton:
    """Of any number of sequences of integers; matches() streams another one."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c, -1)
            if q >= 0:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
                continue
            new, p = len(nxt), last
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = new

    def matches(self, sequence: list[int]) -> list[int]:
        """For each place the length of the longest suffix there that the automaton holds."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            out.append(size)
        return out


def streamed(length: int):
    def compare(r: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = r["n"].astype(np.int64) + length - 1
        end = np.cumsum(size)
        begin = end - size
        seq = np.ascontiguousarray(content).view(np.uint64).tolist()
        rec, at = [], []
        edges = np.append(np.flatnonzero(heads(r, "k")), len(r)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2 or r["id"][a] == r["id"][b - 1]:
                continue
            automaton, waiting, of = SuffixAutomaton(), [], None
            for i in range(a, b):
                own = seq[begin[i] : end[i]]
                if r["id"][i] != of:
                    for x in waiting:
                        automaton.add(x)
                    waiting, of = [], r["id"][i]
                waiting.append(own)
                if i > a:
                    for j, m in enumerate(automaton.matches(own)[length - 1 :]):
                        if m >= length:
                            rec.append(i)
                            at.append(int(r["at"][i]) + j)
        return np.array(rec, np.int64), np.array(at, np.int64)

    return compare


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["spans"]
        offsets, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
        start, end = lists.values.field("start").to_numpy(), lists.values.field("end").to_numpy()
        n, gone, kept = [], [], []
        for a, b, data, bounds in chunks(batch["text"]):
            ws, we, first = words(data, bounds)
            raw = data.tobytes()
            for i in range(a, b):
                lo, hi = first[i - a], first[i - a + 1]
                keep = np.ones(hi - lo, bool)
                if valid[i] and offsets[i + 1] > offsets[i]:
                    own = slice(offsets[i], offsets[i + 1])
                    keep = ~covered(hi - lo, start[own], end[own])
                n.append(int(hi - lo))
                gone.append(int(hi - lo - keep.sum()))
                kept.append(b" ".join(raw[x:y] for x, y in zip(ws[lo:hi][keep].tolist(), we[lo:hi][keep].tolist(), strict=True)).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of df: every word covered by `length` words that also start in a document with a smaller id goes.

    Words are runs of other than the six ASCII white-space characters; kept joins those that stay by one space. Windows are judged on the
    input. Null text: no words; null id: smaller than all others and null in the result; rows with one id never remove from each other.
    Other columns are ignored; an empty table gives no rows.
    """
    if length < 20:
        raise ValueError("length must be at least 20")
    docs = keyed(df, id_col, text_col)
    docs = docs.join(repeated(docs, streamed(length), length, max(16, length - 200), True, False), ["id", "t"], "left")
    out = docs.select("id", "text", "spans").mapInArrow(lean(_cut), SCHEMA)
    return out.select(doc_id().alias("doc_id"), "n_words", "n_removed", "kept")
