"""Which windows of a corpus start earlier elsewhere: the distributed frame of both repeat removers.

1. Each task cuts its documents into phrases (phrases.py) and sends their records, packed per bucket of the trigger's hash.
2. Each bucket settles equal phrases: all but the first are removed whole. First phrases whose trigger is in other phrases too stay open.
3. Open phrases are sent again, with their content, to the bucket of their trigger, where `compare` finds equal windows exactly.
   Windows of frequent triggers go by their own 128-bit hash instead. Of each block of input only the first of equal windows is sent, the
   others are settled there, so neither a trigger nor a window makes a large group.
Only records of phrases are shuffled for the whole corpus, never its windows; steps 1-2 are written to the shared folder. A bucket holds
about BUCKET_BYTES of text's share of records, however large the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .phrases import RECORD, cut_all, deal, heads, settle
from .textops import BYTE_VALUE, CHUNK, Rolling, chunks, lean, mix, release, spread, word_hashes, words

WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("id", "<i8"), ("t", "<i8"), ("at", "<u4")])
#: Records that a task holds before it sends them on.
BLOCK = 400_000
#: Bytes of text for which there is a bucket.
BUCKET_BYTES = 16 << 20
#: Bytes of content and windows that a task holds before it sends them on.
HELD = 8 << 20
BLOBS = "bucket int, kind int, blob binary"
OPEN = "id long, t long, kind int, at long, n int, l int, k long"
SPANS = "id long, t long, start long, end long"


def symbols(data: np.ndarray, bounds: np.ndarray, by_words: bool) -> tuple[Callable[[int, int], np.ndarray], np.ndarray]:
    """Gives any range of the symbols, hashed as it is asked for, and the documents' bounds in symbols."""
    if not by_words:
        return lambda a, b: BYTE_VALUE[data[a:b]], bounds
    starts, ends, first = words(data, bounds)
    own = word_hashes(data, starts, ends)
    return lambda a, b: own[a:b], first


def blobs(bucket: np.ndarray, kind: int, r: np.ndarray) -> pa.RecordBatch:
    o = np.argsort(bucket, kind="stable")
    bucket, r = bucket[o], r[o]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(r) else np.zeros(0, int)
    to = np.append(at[1:], len(r))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), pa.array([r[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary())],
        names=["bucket", "kind", "blob"],
    )


def sender(length: int, k: int, by_words: bool, same_document: bool, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids, ts = batch["id"].to_numpy(), batch["t"].to_numpy()
            for a, _, data, bounds in chunks(batch["text"]):
                r = cut_all(*symbols(data, bounds, by_words), length, k)
                row = a + r["id"]
                r["id"], r["t"] = ids[row], ts[row]
                held.append(r)
                count += len(r)
                if count >= BLOCK:
                    r, bucket = deal(np.concatenate(held), buckets, same_document)
                    yield blobs(bucket, 0, r)
                    held, count = [], 0
        if count:
            r, bucket = deal(np.concatenate(held), buckets, same_document)
            yield blobs(bucket, 0, r)

    return lean(send)


def settler(same_document: bool, length: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        r, removed, open_ = settle(np.concatenate([np.frombuffer(x, RECORD) for x in group["blob"].to_pylist()]), same_document)
        keep = removed | (open_ > 0)
        r, kind = r[keep], np.where(removed, 0, open_)[keep]
        r["k"][kind == 0], r["l"][kind == 0] = 0, 0  # only open phrases meet again
        return pa.table({
            "id": pa.array(r["id"], pa.int64()), "t": pa.array(r["t"], pa.int64()), "kind": pa.array(kind.astype(np.int32)), "at": pa.array(r["at"].astype(np.int64)),
            "n": pa.array(r["n"].astype(np.int32)), "l": pa.array(r["l"].astype(np.int32)), "k": pa.array(r["k"].view(np.int64) if r["k"].flags.c_contiguous else np.ascontiguousarray(r["k"]).view(np.int64)),
        })

    return run


def opener(length: int, by_words: bool, same_document: bool, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, t, text, open: list of kind, at, n, l, k) to blobs: kind 1 records with content, kind 2 windows by their hash, kind 3
    windows that an equal one of the block precedes."""

    def flush(recs: list, parts: list, wins: list) -> Iterator[pa.RecordBatch]:
        if recs:
            r = np.concatenate(recs)
            size = (8 if by_words else 1) * (r["n"].astype(np.int64) + length - 1)
            content, ends = np.concatenate(parts), np.cumsum(size)
            bucket = ((r["k"] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
            o = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, bucket[o][1:] != bucket[o][:-1]))
            out = []
            for a, b in zip(cuts, np.append(cuts[1:], len(o)), strict=True):
                own = o[a:b]
                out.append(np.int32(len(own)).tobytes() + r[own].tobytes() + content[spread(ends[own] - size[own], size[own])].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[o][cuts], pa.int32()), pa.array(np.ones(len(cuts)), pa.int32()), pa.array(out, pa.binary())], names=["bucket", "kind", "blob"])
        if wins:
            w, again = repeats_in(np.concatenate(wins), same_document)
            gone = w[again]
            w = w[~again]
            yield blobs(((w["h"] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32), 2, w)
            if len(gone):
                yield blobs(((mix(gone["id"].view(np.uint64) + gone["t"].view(np.uint64)) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32), 3, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recs, parts, wins, held = [], [], [], 0
        for batch in batches:
            ids, ts, lists = batch["id"].to_numpy(), batch["t"].to_numpy(), batch["open"]
            offsets, flat = lists.offsets.to_numpy(), lists.values
            fields = {f: flat.field(f).to_numpy() for f in ("kind", "at", "n", "l", "k")}
            for a, b, data, bounds in chunks(batch["text"]):
                hashed, first = symbols(data, bounds, by_words)
                own = np.arange(offsets[a], offsets[b])
                rows = np.repeat(np.arange(a, b), np.diff(offsets[a : b + 1]))
                begins = first[rows - a] + fields["at"][own]
                for lo in range(0, max(1, int(first[-1])), CHUNK):
                    here = (begins >= lo) & (begins < lo + CHUNK)
                    if not here.any():
                        continue
                    # No phrase has more than `length` windows.
                    hi = min(int(first[-1]), lo + CHUNK + 2 * length)
                    sym = hashed(lo, hi)
                    row, start = rows[here], begins[here] - lo
                    x = {f: v[own[here]] for f, v in fields.items()}
                    one = np.flatnonzero(x["kind"] == 1)
                    if len(one):
                        r = np.zeros(len(one), RECORD)
                        r["k"], r["id"], r["t"], r["at"], r["n"], r["l"] = x["k"][one].astype(np.uint64), ids[row[one]], ts[row[one]], x["at"][one], x["n"][one], x["l"][one]
                        where = spread(start[one], x["n"][one] + length - 1)
                        recs.append(r)
                        parts.append(sym[where].view(np.uint8) if by_words else data[lo:hi][where])
                        held += len(parts[-1])
                    two = np.flatnonzero(x["kind"] == 2)
                    if len(two):
                        where = spread(start[two], x["n"][two])
                        w = np.zeros(len(where), WINDOW)
                        raw = Rolling(sym).of(where, where + length)
                        other = Rolling(mix(sym + np.uint64(77))).of(where, where + length)
                        rep = np.repeat(two, x["n"][two])
                        w["h"], w["g"], w["id"], w["t"], w["at"] = mix(raw), mix(other), ids[row[rep]], ts[row[rep]], where + lo - first[row[rep] - a]
                        wins.append(w)
                        held += w.nbytes
                    if held > HELD:
                        yield from flush(recs, parts, wins)
                        recs, parts, wins, held = [], [], [], 0
        yield from flush(recs, parts, wins)

    return lean(run)


def repeats_in(w: np.ndarray, same_document: bool) -> tuple[np.ndarray, np.ndarray]:
    """Windows in order, and which of them an equal one precedes: anywhere, or else in a document with a smaller id."""
    w = w[np.lexsort((w["at"], w["t"], w["id"], w["g"], w["h"]))]
    if not len(w):
        return w, np.zeros(0, bool)
    new = heads(w, "h", "g")
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    if same_document:
        return w, ~new & ((w["id"] != w["id"][first]) | (w["t"] != w["t"][first]) | (w["at"] != w["at"][first]))
    return w, w["id"] > w["id"][first]


def spans(ids: np.ndarray, ts: np.ndarray, at: np.ndarray, length: int) -> pa.Table:
    """Runs of removed windows, from their documents and starts."""
    o = np.lexsort((at, ts, ids))
    ids, ts, at = ids[o], ts[o], at[o].astype(np.int64)
    new = np.append(True, (ids[1:] != ids[:-1]) | (ts[1:] != ts[:-1]) | (at[1:] > at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(at)) - 1 if len(a) else a
    return pa.table({"id": pa.array(ids[a], pa.int64()), "t": pa.array(ts[a], pa.int64()), "start": pa.array(at[a]), "end": pa.array(at[b] + length)})


def comparer(compare: Callable[[np.ndarray, np.ndarray], np.ndarray], same_document: bool, length: int, by_words: bool) -> Callable[[pa.Table], pa.Table]:
    """compare(records, content) gives (document rows of records, starts) of removed windows; records are whole groups of triggers."""

    def run(group: pa.Table) -> pa.Table:
        ids, ts, ats = [], [], []
        recs, parts, wins = [], [], []
        for kind, blob in zip(group["kind"].to_pylist(), group["blob"].to_pylist(), strict=True):
            if kind == 2:
                wins.append(np.frombuffer(blob, WINDOW))
            elif kind == 3:
                w = np.frombuffer(blob, WINDOW)
                ids.append(w["id"]), ts.append(w["t"]), ats.append(w["at"])
            else:
                n = int(np.frombuffer(blob, np.int32, 1)[0])
                recs.append(np.frombuffer(blob, RECORD, n, 4))
                parts.append(np.frombuffer(blob, np.uint8, -1, 4 + n * RECORD.itemsize))
        if recs:
            r, content = np.concatenate(recs), np.concatenate(parts)
            size = (8 if by_words else 1) * (r["n"].astype(np.int64) + length - 1)
            begin = np.cumsum(size) - size
            o = np.lexsort((r["at"], r["t"], r["id"], r["k"]))
            groups = np.flatnonzero(heads(r[o], "k"))
            weight = np.cumsum(r["n"][o].astype(np.int64))
            piece = weight[groups] // 400_000  # so many windows at a time
            edges = np.append(groups[np.append(True, piece[1:] != piece[:-1])], len(o))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = o[a:b]
                rec, at = compare(r[own], content[spread(begin[own], size[own])])
                ids.append(r["id"][own][rec]), ts.append(r["t"][own][rec]), ats.append(at)
        if wins:
            w, gone = repeats_in(np.concatenate(wins), same_document)
            ids.append(w["id"][gone]), ts.append(w["t"][gone]), ats.append(w["at"][gone])
        cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, ts, ats)]
        out = spans(*cat, length)
        del recs, parts, wins, ids, ts, ats, cat
        release()
        return out

    return run


def repeated(docs: DataFrame, compare: Callable, length: int, k: int, by_words: bool, same_document: bool) -> DataFrame:
    """(id, t, spans: array of start, end) of documents in which windows cover symbols that also start earlier. docs as from keyed()."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    buckets = max(4 * partitions(docs.sparkSession), size // BUCKET_BYTES)
    sent = docs.mapInArrow(sender(length, k, by_words, same_document, buckets), BLOBS)
    settled = materialize(sent.groupBy("bucket").applyInArrow(settler(same_document, length), OPEN), "phrases")
    whole = settled.where("kind = 0").select("id", "t", F.col("at").alias("start"), (F.col("at") + F.col("n") + F.lit(length - 1)).alias("end"))
    open_ = settled.where("kind > 0").groupBy("id", "t").agg(F.collect_list(F.struct("kind", "at", "n", "l", "k")).alias("open"))
    found = docs.join(open_, ["id", "t"]).select("id", "t", "text", "open").mapInArrow(opener(length, by_words, same_document, buckets), BLOBS)
    found = materialize(found.groupBy("bucket").applyInArrow(comparer(compare, same_document, length, by_words), SPANS), "windows")
    return whole.unionByName(found).groupBy("id", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
