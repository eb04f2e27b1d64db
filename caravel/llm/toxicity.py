"""Compression-distance classification: two zstandard dictionaries, windows compressed with both, calibrated thresholds.

Dictionaries are trained by coverage: byte d-grams get the number of training documents that hold them, and the runs of text in which all
d-grams are frequent in the own class (and, for the toxic dictionary, far more frequent than in the other) are its segments, the most
frequent nearest to the end. Every window of a whole text is compressed with each dictionary; what the toxic one saves over the ordinary
one, at its largest windows and on the whole, is calibrated to a probability by logistic regression on the training documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize

GRAM = 5
#: Occurrences of a d-gram in one document that count.
OFTEN = 4
WINDOW, STEP = 48, 32
LEVEL = 3
#: Savings that count.
LEVELS = (2, 3, 4, 5, 6, 7, 8)
#: Features of a text.
SAVED = 4 + len(LEVELS)
#: Bytes of each dictionary's content.
CONTENT = 2048


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    rates: list[float]
    weights: list[float]
    center: list[float]
    scale: list[float]


def _grams(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out << np.uint64(8) | a[i : i + n]
    return out


def _frequencies(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """d-grams, the number of texts that hold each, and the number of times they do, of which OFTEN in one text count at most."""
    found = [np.unique(_grams(t), return_counts=True) for t in texts]
    keys, which = np.unique(np.concatenate([*(k for k, _ in found), np.zeros(0, np.uint64)]), return_inverse=True)
    times = np.concatenate([*(np.minimum(n, OFTEN) for _, n in found), np.zeros(0, np.int64)])
    return keys, np.bincount(which, minlength=len(keys)), np.bincount(which, weights=times, minlength=len(keys))


def _look_up(grams: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(grams))
    i = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    return np.where(keys[i] == grams, counts[i], 0)


def train_dictionary(own: list[bytes], other: list[bytes], contrast: float) -> bytes:
    """Segments of own between d-grams that are in 3 % of its documents at least and occur `contrast` times more often than in other.

    Two such d-grams make one segment if no more than GRAM others start between them. Segments are taken by coverage: the next one is that whose
    d-grams, without those of the segments before it, are in most documents for its length. So the forms of one frequent word do not fill the
    content, and what is telling in a small part of the documents only, such as one language, has its place.
    """
    (keys, mine, times), (others, _, theirs) = _frequencies(own), _frequencies(other)
    telling = (mine >= 0.03 * len(own)) & (times / max(1, len(own)) >= contrast * (_look_up(keys, others, theirs) + 0.5) / max(1, len(other)))
    found: Counter[bytes] = Counter()
    for t in own:
        at = np.flatnonzero(_look_up(_grams(t), keys, telling))
        if len(at):
            new = np.flatnonzero(np.append(True, np.diff(at) > GRAM))
            found.update({t[a : b + GRAM][:64] for a, b in zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist(), strict=True)})
    worth = dict(zip(keys[telling].tolist(), mine[telling].tolist(), strict=True))
    held = {s: {g for g in _grams(s).tolist() if g in worth} for s in found}

    def gain(s: bytes) -> float:
        return sum(worth[g] for g in held[s] if g not in covered) / (len(s) + 1)

    covered: set[int] = set()
    todo = [(-gain(s), -n, s) for s, n in found.items()]
    heapq.heapify(todo)
    out = b""
    while todo:
        before, n, s = heapq.heappop(todo)
        now = -gain(s)
        if now == 0 or len(out) + len(s) >= CONTENT:
            continue
        if now > before:  # others have covered a part since
            heapq.heappush(todo, (now, n, s))
            continue
        out = s + b" " + out
        covered |= held[s]
    return out.rjust(16, b"\n")


def compressors(model: Model):
    import zstandard

    found = []
    for content in (model.toxic, model.ordinary):
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(LEVEL)
        found.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
    return found


def savings(text: bytes, both) -> np.ndarray:
    """For each window of the whole text the bytes that the toxic dictionary saves over the ordinary one."""
    text = text.lower()
    t, o = both[0].compress, both[1].compress
    return np.array([len(o(w)) - len(t(w)) for w in (text[a : a + WINDOW] for a in range(0, max(1, len(text) - WINDOW + STEP), STEP))] if text else [0])


def features(saved: np.ndarray, rates: list[float]) -> list[float]:
    """What all windows save, in deviations, the three best windows, and how many more windows save 2 to 8 bytes and more than the ordinary rates let expect, in deviations."""
    top = np.sort(np.append(saved, [0, 0, 0]))[::-1][:3]
    n = len(saved)
    whole = float(np.clip(saved, -10, 10).sum()) / math.sqrt(n)
    return [max(-20.0, min(20.0, whole)), *(float(min(x, 10)) for x in top), *(min(8.0, (int((saved >= k).sum()) - r * n) / math.sqrt(r * n + 0.3)) for k, r in zip(LEVELS, rates, strict=True))]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights (bias last) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """Dictionaries from one half of the rows, calibration on the other, where each half has both labels."""
    a, b = rows[::2], rows[1::2]
    if len({y for _, y in a}) < 2 or len({y for _, y in b}) < 2:
        a = b = rows
    if len({y for _, y in a}) < 2:
        return Model(b"\n" * 16, b"\n" * 16, [0.0] * len(LEVELS), [0.0] * (SAVED + 1), [0.0] * SAVED, [1.0] * SAVED)
    toxic, ordinary = [t.lower() for t, y in a if y], [t.lower() for t, y in a if not y]
    plain = train_dictionary(ordinary, toxic, 0.0)  # toxic texts are written in the same language: only the contrast differs
    model = Model(plain + train_dictionary(toxic, ordinary, 8.0), plain, [0.0] * len(LEVELS), [0.0] * (SAVED + 1), [0.0] * SAVED, [1.0] * SAVED)
    both = compressors(model)
    saved, y = [savings(t, both) for t, _ in b], np.array([y for _, y in b] or [0], float)
    usual = np.concatenate([s for s, v in zip(saved, y, strict=False) if not v] or [np.zeros(1)])
    model.rates = [float((usual >= k).mean()) for k in LEVELS]
    x = np.array([features(s, model.rates) for s in saved] or [[0.0] * SAVED])
    center, scale = x.mean(0), x.std(0) + 1e-6
    model.center, model.scale = center.tolist(), scale.tolist()
    model.weights = logistic((x - center) / scale, y).tolist()
    return model


def scorer(model: Model):
    """The score of each text of a column; the other columns of a row never reach Python."""
    ready: list = []

    def run(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.extend([compressors(model), *(np.array(v) for v in (model.weights, model.center, model.scale))])
        both, w, center, scale = ready
        x = np.array([features(savings(t or b"", both), model.rates) for t in texts.cast(pa.binary()).to_pylist()]).reshape(len(texts), len(center))
        return pa.array(1 / (1 + np.exp(-np.clip(((x - center) / scale) @ w[:-1] + w[-1], -30, 30))))

    return F.arrow_udf(run, "double")


SCORE = "_caravel_toxicity"


def learn(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, max_bytes: int) -> Model:
    """Fitted on at most per_class labelled documents of each class, of up to max_bytes each, in the order of a hash of their ids; never on
    a held-out id. The share of each class among all labels corrects the bias for the balanced sample."""
    y = labels.where(F.col(label_col).isin(0, 1) & (F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0))
    y = y.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    share = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = keyed(df, id_col, text_col).where(F.octet_length("text").between(1, max_bytes))
    keys = materialize(rows.select("id", "t").join(y, "id").distinct(), "labelled")
    present = {r["y"]: r["n"] for r in keys.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for label in (1, 0):
        # Twice the rows wanted at most, in expectation, are ordered, so that what tasks send the driver does not grow with their number.
        part = min(1.0, 2 * per_class / max(1, present.get(label, 0)))
        own = keys.where((F.col("y") == label) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30))))
        chosen += [(r["id"], r["t"], label) for r in own.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id", "t").limit(per_class).collect()]
    # The texts of the chosen only, at most twice per_class rows, are sent: no text of any other row is.
    own = F.broadcast(df.sparkSession.createDataFrame(chosen, "id long, t long, y int"))
    part = rows.join(own, ["id", "t"]).dropDuplicates(["id", "t"]).select(F.xxhash64("id").alias("h"), F.col("text").cast("binary").alias("b"), "y")
    out = [(r["h"], bytes(r["b"]), r["y"]) for r in part.collect()]
    model = fit([(t, v) for _, t, v in sorted(out)])
    taken = Counter(v for *_, v in out)
    if len(taken) == 2:
        model.weights[-1] += math.log(share[1] / share[0]) - math.log(taken[1] / taken[0])
    return model


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2500, max_bytes: int = 16_384) -> DataFrame:
    """df with a last column _caravel_toxicity (SCORE), the probability of label 1, which depends on the row's whole text only.

    The classifier is fitted on a bounded sample of labelled rows: per_class documents of each class with at most max_bytes bytes, never
    one whose crc32 of the id as text is divisible by 5. Null and empty texts count as one empty window; repeated rows get equal scores;
    without labels of both classes all scores are 0.5. Texts of any length are scored by all their windows. Null ids and other columns pass
    through; an empty table gives no rows. Documents that tie in the hash of their ids are chosen in the order of id and text hash.
    """
    model = learn(df, labels, id_col, text_col, label_col, per_class, max_bytes)
    return df.withColumn(SCORE, scorer(model)(F.col(text_col).cast("string")))
