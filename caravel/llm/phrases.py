"""Phrases of a text, cut by rolling-hash triggers: what prefix-free parsing and the automata of reference shards share.

Each window of `length` symbols has one trigger: the leftmost of its k-grams with the least rolling hash. Consecutive windows with one
trigger form a phrase; phrases overlap by length - 1 symbols, so each window lies in exactly one phrase, and equal windows have equal
triggers at equal places. Phrases are records; a window can recur only in phrases with the same trigger.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textops import CHUNK, Rolling, mix

#: k: hash of the trigger, e: hash of the phrase, id and t: the document, at: start of its first window, n: windows, l: from there to
#: the trigger, f: 0 plain, 1 dealt out by phrase because its trigger is frequent, 2 only says that, 3 settled already.
RECORD = np.dtype([("k", "<u8"), ("e", "<u8"), ("id", "<i8"), ("t", "<i8"), ("at", "<u4"), ("n", "u1"), ("l", "u1"), ("f", "u1")])
#: Distinct phrases of one trigger in one block of input, and in one bucket, from which it counts as frequent.
FREQUENT = 24


def cut(symbols: np.ndarray, bounds: np.ndarray, length: int, k: int) -> np.ndarray:
    """Records (id: row index) of the phrases of documents laid end to end."""
    n, w = len(symbols), length - k + 1
    if n < length:
        return np.zeros(0, RECORD)
    roll = Rolling(symbols)
    grams = mix(roll.grams(k))
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if w > span:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    trigger = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts here
    ok = np.zeros(len(low) + 1, np.int32)
    lengths = np.diff(bounds)
    long = lengths >= length
    np.add.at(ok, bounds[:-1][long], 1)
    np.add.at(ok, (bounds[1:] - length + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if not len(starts):
        return np.zeros(0, RECORD)
    trig = trigger[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (trig[1:] != trig[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    first, anchor = starts[heads], trig[heads]
    count = np.diff(np.append(heads, len(starts)))
    row = np.searchsorted(bounds, first, side="right") - 1
    out = np.zeros(len(heads), RECORD)
    out["k"], out["id"], out["at"], out["n"], out["l"] = grams[anchor], row, first - bounds[row], count, anchor - first
    out["e"] = mix(roll.of(first, first + count + length - 1) + count.astype(np.uint64) * np.uint64(257))
    return out


def cut_all(symbols: Callable[[int, int], np.ndarray], bounds: np.ndarray, length: int, k: int) -> np.ndarray:
    """cut() in parts of a bounded size: symbols(a, b) gives a range of them. Where a long document is parted, a phrase is two with one
    trigger, which are compared window by window like any others."""
    n = int(bounds[-1])
    if n <= 2 * CHUNK:
        return cut(symbols(0, n), bounds, length, k)
    out = []
    for a in range(0, n, CHUNK):
        own = symbols(a, min(n, a + CHUNK + length - 1))
        r = cut(own, np.array([0, len(own)]), length, k)
        r["at"] += np.uint32(a)
        out.append(r)
    return np.concatenate(out)


def order(r: np.ndarray) -> np.ndarray:
    """Sorts by trigger, phrase, document and place; a document that is there twice counts once."""
    r = r[np.lexsort((r["at"], r["t"], r["id"], r["l"], r["e"], r["k"]))]
    if len(r) > 1:
        same = np.ones(len(r) - 1, bool)
        for f in ("k", "e", "l", "n", "id", "t", "at", "f"):
            same &= r[f][1:] == r[f][:-1]
        r = r[np.append(True, ~same)]
    return r


def heads(r: np.ndarray, *fields: str) -> np.ndarray:
    """True where one of these fields differs from the row before."""
    new = np.ones(len(r), bool)
    if len(r) > 1:
        new[1:] = False
        for f in fields:
            new[1:] |= r[f][1:] != r[f][:-1]
    return new


def earlier(r: np.ndarray, by_e: np.ndarray, same_document: bool) -> np.ndarray:
    """Ordered records before which an equal phrase starts."""
    return ~by_e if same_document else r["id"] > r["id"][np.flatnonzero(by_e)[np.cumsum(by_e) - 1]]


def deal(r: np.ndarray, buckets: int, same_document: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ordered records and their buckets: by trigger, or by phrase where the block holds many phrases of one trigger. What repeats within
    the block is settled, and spread evenly, so a phrase has few records in its bucket from each block."""
    r = order(r)
    by_k, by_e = heads(r, "k"), heads(r, "k", "e", "l", "n")
    group = np.cumsum(by_k) - 1
    many = np.bincount(group, weights=by_e, minlength=1)[group] > FREQUENT if len(r) else np.zeros(0, bool)
    bucket = (r["k"] >> np.uint64(16)) % np.uint64(buckets)
    if len(r):
        gone = earlier(r, by_e, same_document)
        r["f"][gone] = 3
        bucket[gone] = mix(r["id"][gone].astype(np.uint64) + r["at"][gone]) % np.uint64(buckets)
        many &= ~gone
    if many.any():
        signs = r[many]
        signs = signs[heads(signs, "k")].copy()
        signs["f"], signs["e"], signs["at"], signs["n"], signs["l"], signs["id"], signs["t"] = 2, 0, 0, 0, 0, 0, 0
        r = r.copy()
        r["f"][many] = 1
        bucket[many] = (mix(r["k"][many] + r["e"][many]) >> np.uint64(16)) % np.uint64(buckets)
        r, bucket = np.concatenate([r, signs]), np.concatenate([bucket, (signs["k"] >> np.uint64(16)) % np.uint64(buckets)])
    return r, bucket.astype(np.int32)


def settle(r: np.ndarray, same_document: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: (ordered records without signs, removed: an equal phrase starts earlier, open: 1 or 2 if some windows may recur in
    other phrases, 2 where the trigger is frequent). With same_document false only phrases of smaller ids count as earlier."""
    signs, gone = np.unique(r["k"][r["f"] == 2]), r[r["f"] == 3]
    r = order(r[r["f"] < 2])
    if not len(r):
        return gone, np.ones(len(gone), bool), np.zeros(len(gone), np.int8)
    by_k, by_e = heads(r, "k"), heads(r, "k", "e", "l", "n")
    removed = earlier(r, by_e, same_document)
    group = np.cumsum(by_k) - 1
    kinds = np.bincount(group, weights=by_e)[group]
    open_ = np.where((kinds > FREQUENT) | (r["f"] == 1) | np.isin(r["k"], signs), 2, (kinds > 1).astype(np.int8)).astype(np.int8)
    open_[removed] = 0
    return np.concatenate([r, gone]), np.append(removed, np.ones(len(gone), bool)), np.append(open_, np.zeros(len(gone), np.int8))
