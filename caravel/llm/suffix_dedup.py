"""Removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut the corpus into overlapping phrases; equal phrases are one entry of the dictionary, and the parse is where they
stand. The order of the corpus's suffixes is needed to a depth of `length` bytes only, and each phrase reaches that far beyond each of
its starts, so the suffix array of the dictionary (sorted here to that depth, by eight bytes at a time) needs no part of the parse's
order but its first: the place where a phrase stands first. Neighbours in that order that agree in `length` bytes are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, doc_id, keyed
from .repeats import covered, repeated
from .textops import lean, spread

SCHEMA = "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def equal_windows(length: int):
    """Sorts the windows of open phrases, the dictionary's suffixes to that depth, and returns those that start earlier too."""

    def compare(r: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = r["n"].astype(np.int64)
        size = n + length - 1
        begin = np.cumsum(size) - size
        pos, rec = spread(begin, n), np.repeat(np.arange(len(r)), n)
        offset = pos - begin[rec]
        trigger = np.unique(r["k"], return_inverse=True)[1].astype(np.int64)
        cls = trigger[rec] * 512 + (r["l"][rec].astype(np.int64) - offset + 256)  # windows with one trigger at one place
        padded = np.append(content, np.zeros(8, np.uint8))
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        live = np.arange(len(pos))
        for depth in range(-8, length, 8):
            if depth >= 0:
                digits = np.ascontiguousarray(eight[pos[live] + depth]).view(">u8").ravel().astype(np.uint64)
                if depth + 8 > length:
                    digits >>= np.uint64(8 * (depth + 8 - length))
                o = np.lexsort((digits, cls[live]))
                live, digits = live[o], digits[o]
                new = np.append(True, (cls[live][1:] != cls[live][:-1]) | (digits[1:] != digits[:-1])) if len(live) else np.zeros(0, bool)
            else:
                live = live[np.argsort(cls, kind="stable")]
                new = np.append(True, cls[live][1:] != cls[live][:-1])
            number = np.cumsum(new) - 1
            shared = (np.bincount(number) > 1)[number] if len(live) else new
            cls[live] = number
            live = live[shared]
            if not len(live):
                break
        o = np.lexsort((r["at"][rec[live]] + offset[live], r["t"][rec[live]], r["id"][rec[live]], cls[live]))
        live = live[o]
        start = r["at"][rec[live]].astype(np.int64) + offset[live]
        if len(live):
            new = np.append(True, cls[live][1:] != cls[live][:-1])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]  # where these bytes start first; a document that is there twice counts once
            later = (start != start[first]) | (r["id"][rec[live]] != r["id"][rec[live[first]]]) | (r["t"][rec[live]] != r["t"][rec[live[first]]])
            live, start = live[later], start[later]
        return rec[live], start

    return compare


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"id": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        lists = batch["spans"]
        offsets, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
        start, end = lists.values.field("start").to_numpy(), lists.values.field("end").to_numpy()
        for i, (key, text) in enumerate(zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True)):
            runs, kept, gone = [], text, 0
            if valid[i] and offsets[i + 1] > offsets[i]:
                own = slice(offsets[i], offsets[i + 1])
                mask = covered(len(text), start[own], end[own])
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                runs = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                gone, kept = int(mask.sum()), np.frombuffer(text, np.uint8)[~mask].tobytes()
            for f, v in zip(rows, (key, len(text), gone, runs, kept), strict=True):
                rows[f].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["id"], pa.int64()), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(rows["kept"], pa.binary())],
            names=list(rows),
        )


def _cut_text(text: pa.Array, spans: pa.Array) -> pa.Array:
    """(n_removed, kept_text) of texts with spans; null where there are none."""
    blank = pa.array(np.zeros(len(text), np.int64))
    out = next(_cut(iter([pa.RecordBatch.from_arrays([blank, text, spans], names=["id", "text", "spans"])])))
    kept = pa.array([x.decode("utf-8", "ignore") for x in out["kept"].to_pylist()], pa.string())
    return pa.StructArray.from_arrays([out["n_removed"], kept], names=["n_removed", "kept_text"])


def suffix_array_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_columns: bool | str = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) per row of df: every byte covered by a string of `length` bytes that also starts earlier goes.

    Earlier: in a document with a smaller id, or in the same document. Strings are judged on the input. Null text: empty; null id: smaller
    than all others and null in the result; rows with one id and different texts are different documents in the order of a hash of the
    text; rows that agree in both are one document and get equal results. kept is binary, since a cut may fall inside a character.
    Other columns are ignored, unless keep_columns asks for df's rows with (n_removed, kept_text) added: kept_text is without characters
    that are cut in two and null where nothing is removed. A string asks for one struct of both under that name, null where nothing is
    removed. Columns of df that have the added names are an error. An empty table gives no rows; a long text is cut in parts.
    """
    if length < 48:
        raise ValueError("length must be at least 48")
    k = max(32, length - 200)
    docs = keyed(df, id_col, text_col)
    spans = repeated(docs, equal_windows(length), length, k, False, True)
    if keep_columns:
        clash = {keep_columns} if isinstance(keep_columns, str) else {"n_removed", "kept_text"}
        if clash & set(df.columns):
            raise ValueError(f"the input has columns that would be added: {sorted(clash & set(df.columns))}")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        own = df.withColumns({"_caravel_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_caravel_t": F.xxhash64(text)})
        spans = spans.select(F.col("id").alias("_caravel_id"), F.col("t").alias("_caravel_t"), F.col("spans").alias("_caravel_spans"))
        cut = F.arrow_udf(_cut_text, "n_removed long, kept_text string")(text, F.col("_caravel_spans"))
        own = own.join(spans, ["_caravel_id", "_caravel_t"], "left").withColumn("_caravel_cut", F.when(F.col("_caravel_spans").isNotNull(), cut)).drop("_caravel_id", "_caravel_t", "_caravel_spans")
        if isinstance(keep_columns, str):
            return own.withColumnRenamed("_caravel_cut", keep_columns)
        return own.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_caravel_cut.n_removed", F.lit(0).cast("long")).alias("n_removed"), F.col("_caravel_cut.kept_text").alias("kept_text"))
    out = docs.join(spans, ["id", "t"], "left").select("id", "text", "spans").mapInArrow(lean(_cut), SCHEMA)
    return out.select(doc_id().alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")
