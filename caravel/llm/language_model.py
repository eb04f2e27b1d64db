"""Language-model scoring: a causal self-attention model, trained in numpy on subword ids, and the add-0.1 unigram base.

The model predicts each subword id from those before it by a factored softmax: a branch, a class within it, and the id within its class. The
frequent ids, OWN of them, are classes of their own; the others share classes, within which they have their smoothed share of the counts over
all training documents. Texts are scored in overlapping windows, each id once, with at least LENGTH - STRIDE ids of context where there
are so many; windows go through masked attention in batches. A word's probability mixes the product over its ids, which spells any word, with
the word's own share of the training tokens, none for a word that no training document holds. Both parts sum to one over all words
and the end at most, so the score is a probability of the text.

All that is learned is learned from all training documents. They are counted. The attention weights start on the driver from START windows at
most and then learn from every window of every training document, of any length, where the windows are: tasks train apart from one another and
their weights are averaged. The weight of the mixture is the one of GRID that makes all tokens of all training documents likeliest, no token
counting itself: texts are scored with each weight, and the sums tell which score stays. Documents are scored in blocks: each block asks for the counts of its own words,
so no task and no driver holds all words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, discard, keyed, materialize
from .textops import LOWER, lean, mix, powers, release, segments, steady, word_hashes, words
from .tokens import default_path, encoder

LENGTH, STRIDE, WIDTH, HIDDEN = 128, 112, 16, 32
BRANCHES = 32
CLASSES = BRANCHES * BRANCHES
#: Ids that are classes of their own.
OWN = CLASSES - BRANCHES
IDS = 49_408
END = 49_407
#: Places of a window that attend together, and rows of a group of one branch.
ROWS, GROUP = 32, 32
LATER = np.tri(ROWS, dtype=np.float32)
#: Of each class's row in a table of twice the width.
PLACES = np.arange((CLASSES + 1) * 2 * WIDTH).reshape(CLASSES + 1, 2 * WIDTH)
#: Windows from which the driver starts the weights, and windows of one step of the tasks that go on from there.
START, TAUGHT = 10_000, 16
#: Places whose classes are looked up together.
SETTLED = 8192
#: Bytes of text whose words ask for their counts, and are scored, together; a longer document is taken alone.
TOGETHER = 16 << 20
#: Bytes of text whose words are taken at a time.
SLICE = 1 << 20
END_WORD = int(mix(np.array([0x656E64], np.uint64))[0])
BLOCK = 2_000_000
#: Weights of the shares that are tried.
GRID = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)


@dataclass
class Model:
    class_of: np.ndarray  # of each id
    share: np.ndarray  # log10 of an id's share in its class
    weights: dict[str, np.ndarray]
    mix: float | None = 0.6  # of the words' shares; None: chosen as texts are scored


def windows(n: int) -> list[tuple[int, int]]:
    """(start of the window, first place scored) so that n places are scored once each."""
    return [(0, 0)] + [(a, a + LENGTH - STRIDE) for a in range(STRIDE, n - LENGTH + STRIDE, STRIDE)] if n > LENGTH else [(0, 0)]


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    w = {"emb": 0.3 * r.standard_normal((CLASSES + 1, WIDTH)).astype(np.float32), "pos": 0.1 * r.standard_normal((LENGTH, WIDTH)).astype(np.float32)}
    w |= {"prev": 0.3 * r.standard_normal((CLASSES + 1, WIDTH)).astype(np.float32)}
    w |= {k: g(WIDTH, WIDTH) for k in ("q", "k", "v", "o")} | {"a": g(WIDTH, HIDDEN), "b": 0.5 * g(HIDDEN, WIDTH), "top": g(WIDTH, BRANCHES), "top_bias": np.zeros((1, BRANCHES), np.float32)}
    return w | {"out": g(BRANCHES, WIDTH, BRANCHES), "bias": np.zeros((BRANCHES, BRANCHES), np.float32)}


#: Sizes of the weights of each kind, by name.
SHAPES = {k: v.shape for k, v in sorted(initial().items())}


def forward(w: dict[str, np.ndarray], x: np.ndarray, skip: int = 0) -> tuple[np.ndarray, tuple]:
    """Hidden states of the places from skip on of windows of input classes; the cache for backward(), which needs skip 0.

    Places attend ROWS at a time, to keys no later than the last of them, so that what is met once more is still at hand."""
    n, size = x.shape
    before = np.concatenate([np.full((n, 1), CLASSES, x.dtype), x[:, :-1]], 1)
    e = w["emb"].take(x, axis=0)
    e += w["prev"].take(before, axis=0)
    e += w["pos"][:size]
    flat = e.reshape(-1, WIDTH)
    k, v = (flat @ w["k"]).reshape(e.shape), (flat @ w["v"]).reshape(e.shape)
    last = np.ascontiguousarray(e[:, skip:]) if skip else e
    flat = last.reshape(-1, WIDTH)
    q = (flat @ (w["q"] * np.float32(1 / np.sqrt(WIDTH)))).reshape(last.shape)
    keys, c, inverse, held = np.ascontiguousarray(k.transpose(0, 2, 1)), np.empty_like(last), np.empty((*last.shape[:2], 1), np.float32), []
    for lo, hi in spans(skip, size):
        p = powered(q[:, lo - skip : hi - skip] @ keys[:, :, :hi])
        p[:, :, lo:] *= LATER[: hi - lo, : hi - lo]
        inverse[:, lo - skip : hi - skip, 0] = (p.reshape(-1, hi) @ np.ones(hi, np.float32)).reshape(n, -1)
        np.matmul(p, v[:, :hi], out=c[:, lo - skip : hi - skip])
        held.append(p)
    inverse += np.float32(1e-30)
    np.reciprocal(inverse, out=inverse)
    c *= inverse
    y = c.reshape(-1, WIDTH) @ w["o"]
    y += flat
    h = y @ w["a"]
    np.maximum(h, 0, out=h)
    z = h @ w["b"]
    z += y
    return z.reshape(last.shape), (x, e, q, k, v, held, inverse, c, y, h)


def spans(skip: int, size: int) -> list[tuple[int, int]]:
    return [(lo, min(lo + ROWS, size)) for lo in range(skip, size, ROWS)]


def backward(w: dict[str, np.ndarray], cache: tuple, dz: np.ndarray) -> dict[str, np.ndarray]:
    x, e, q, k, v, held, inverse, c, y, h = cache
    n, size = x.shape
    flat = lambda a: a.reshape(-1, a.shape[-1])
    dz = flat(dz)
    g = {"b": h.T @ dz}
    dh = dz @ w["b"].T
    dh *= h > 0
    g["a"] = y.T @ dh
    dy = dh @ w["a"].T
    dy += dz
    g["o"] = flat(c).T @ dy
    # One more column holds what every p of a row loses: the sum over places of dp * p.
    dc, less = (dy @ w["o"].T).reshape(c.shape), np.empty((n, size, WIDTH + 1), np.float32)
    dc *= inverse
    less[:, :, :WIDTH] = dc
    np.negative(np.einsum("ijk,ijk->ij", dc, c), out=less[:, :, WIDTH])
    values = np.ones((n, WIDTH + 1, size), np.float32)
    values[:, :WIDTH] = v.transpose(0, 2, 1)
    dq = np.empty_like(q)
    for (lo, hi), p in zip(reversed(spans(0, size)), reversed(held), strict=True):
        ds = less[:, lo:hi] @ values[:, :, :hi]
        ds *= p
        np.matmul(ds, k[:, :hi], out=dq[:, lo:hi])
        to_k, to_v = ds.transpose(0, 2, 1) @ q[:, lo:hi], p.transpose(0, 2, 1) @ dc[:, lo:hi]
        if hi == size:  # the last places meet all keys
            dk, dv = to_k, to_v
        else:
            dk[:, :hi] += to_k
            dv[:, :hi] += to_v
    dq *= np.float32(1 / np.sqrt(WIDTH))
    dq, dk, dv, flat_e = flat(dq), flat(dk), flat(dv), flat(e)
    g |= {"q": flat_e.T @ dq, "k": flat_e.T @ dk, "v": flat_e.T @ dv}
    de = dy
    for name, d in (("q", dq), ("k", dk), ("v", dv)):
        de += d @ w[name].T
    de = de.reshape(e.shape)
    # A place's class is met by the place itself and by the next one.
    both = np.zeros((n, size, 2 * WIDTH), np.float32)
    both[:, :, :WIDTH], both[:, :-1, WIDTH:] = de, de[:, 1:]
    sums = np.zeros((CLASSES + 1, 2 * WIDTH), np.float32)
    np.add.at(sums.ravel(), PLACES.take(x.ravel(), axis=0).ravel(), both.ravel())
    g["emb"], g["prev"] = sums[:, :WIDTH], sums[:, WIDTH:]
    g["prev"][CLASSES] += de[:, 0].sum(0)
    g["pos"] = np.zeros_like(w["pos"])
    g["pos"][:size] = de.sum(0)
    return g


def powered(x: np.ndarray) -> np.ndarray:
    """exp() in place; values that no trained weights give, beyond 60, count as 60."""
    if x.size and x.max() > 60:
        np.minimum(x, np.float32(60), out=x)
    return np.exp(x, out=x)


def total(p: np.ndarray, axis: int) -> np.ndarray:
    return (np.ones(len(p), np.float32) @ p if axis == 0 else p @ np.ones(p.shape[1], np.float32)) + np.float32(1e-30)


def softmax(logits: np.ndarray, scale: np.ndarray, axis: int) -> np.ndarray:
    """In place, along an axis, each times its scale."""
    p = powered(logits)
    p *= np.expand_dims(scale / total(p, axis), axis)
    return p


def chosen(logits: np.ndarray, own: np.ndarray, axis: int) -> np.ndarray:
    """Natural log of the softmax along an axis, at `own` of each."""
    n, each = len(own), np.arange(len(own))
    out = np.minimum(logits.ravel()[own * n + each if axis == 0 else each * logits.shape[1] + own], np.float32(60))
    return out - np.log(total(powered(logits), axis))


class Grouped:
    """Rows of z, with a one beside each, by the branch of their class. Each branch is filled up to groups of rows, so that a few calls multiply all
    rows by their branch's matrix; classes from CLASSES on count as of the last branch."""

    def __init__(self, w: dict[str, np.ndarray], z: np.ndarray, classes: np.ndarray, group: int):
        n = len(classes)
        of = np.minimum(classes // BRANCHES, BRANCHES - 1).astype(np.uint8)
        order = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=BRANCHES)
        groups = -(-count // group)
        self.branch = np.repeat(np.arange(BRANCHES), groups)
        self.shape, self.slot = (len(self.branch), group), np.empty(n, np.int64)  # of each row
        self.slot[order] = np.arange(n) + np.repeat(group * (np.cumsum(groups) - groups) - (np.cumsum(count) - count), count)
        self.within = classes % BRANCHES
        own = np.zeros(group * len(self.branch), np.int64)
        own[self.slot] = np.arange(n)
        one = np.ones((n, WIDTH + 1), np.float32)
        one[:, :WIDTH] = z
        self.rows = one.take(own, axis=0).reshape(*self.shape, WIDTH + 1)
        self.table = np.concatenate([w["out"], w["bias"][:, None]], 1)

    def logits(self) -> np.ndarray:
        """A row for each slot."""
        return (self.rows @ self.table.take(self.branch, axis=0)).reshape(-1, BRANCHES)

    def slopes(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of out, of bias and of the rows of z, from that of the logits."""
        d, of = d.reshape(*self.shape, BRANCHES), np.zeros((BRANCHES, self.shape[0]), np.float32)
        of[self.branch, np.arange(len(self.branch))] = 1
        g = (of @ (self.rows.transpose(0, 2, 1) @ d).reshape(self.shape[0], (WIDTH + 1) * BRANCHES)).reshape(self.table.shape)
        back = np.ascontiguousarray(self.table[:, :WIDTH].transpose(0, 2, 1)).take(self.branch, axis=0)
        return g[:, :WIDTH], g[:, WIDTH], (d @ back).reshape(-1, WIDTH).take(self.slot, axis=0)


def class_log(w: dict[str, np.ndarray], z: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each row's class."""
    top = w["top"].T @ z.T
    top += w["top_bias"].T
    own = Grouped(w, z, classes, 2 * GROUP)
    within = np.zeros(own.shape[0] * own.shape[1], np.int64)
    within[own.slot] = own.within
    return chosen(top, classes // BRANCHES, 0) + chosen(own.logits(), within, 1)[own.slot]


def gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss over the places of windows whose target y is a class."""
    z, cache = forward(w, x)
    z, y = z.reshape(-1, WIDTH), y.ravel()
    scale = (y < CLASSES).astype(np.float32)
    scale /= max(1, np.count_nonzero(scale))
    d = w["top"].T @ z.T
    d += w["top_bias"].T
    softmax(d, scale, 0)
    d.ravel()[np.minimum(y // BRANCHES, BRANCHES - 1) * len(y) + np.arange(len(y))] -= scale
    g = {"top": z.T @ d.T, "top_bias": (d @ np.ones(len(y), np.float32))[None]}
    dz = d.T @ w["top"].T
    own = Grouped(w, z, y, GROUP)
    d = own.logits()
    slots = np.zeros(len(d), np.float32)
    slots[own.slot] = scale
    softmax(d, slots, 1)
    d.ravel()[own.slot * BRANCHES + own.within] -= scale
    g["out"], g["bias"], rest = own.slopes(d)
    dz += rest
    return g | backward(w, cache, dz)


def train(w: dict[str, np.ndarray], x: np.ndarray, steps: int, batch: int = 16, rate: float = 0.01, seed: int = 11) -> dict[str, np.ndarray]:
    """Adam on rows of classes, CLASSES where a document begins and beyond its end; each row's first place is only context."""
    if not len(x):
        return w
    r = np.random.default_rng(seed)
    # All weights end to end: one step is a few passes over them, not over each kind.
    own = flat(w)
    w = parts(own)
    m, s, grown = np.zeros_like(own), np.zeros_like(own), np.empty_like(own)
    order, at = r.permutation(len(x)), 0
    for t in range(1, steps + 1):
        if at >= len(x):
            order, at = r.permutation(len(x)), 0
        rows = x[order[at : at + batch]].astype(np.int64)
        at += batch
        g = flat(gradient(w, rows[:, :-1], rows[:, 1:]))
        now = rate * min(1, t / 20) * (1 - 0.95 * t / steps)
        # m and s are 10 and 100 times the moments.
        m *= 0.9
        m += g
        g *= g
        s *= 0.99
        s += g
        np.multiply(s, 0.01 / (1 - 0.99**t), out=grown)
        np.sqrt(grown, out=grown)
        grown += 1e-8
        np.divide(m, grown, out=grown)
        grown *= 0.1 * now / (1 - 0.9**t)
        own -= grown
    return w


def vocabulary(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id, and log10 of its smoothed share of the class. A branch holds ids of like frequency."""
    order = np.argsort(-counts, kind="stable")
    class_of = np.zeros(IDS, np.int64)
    class_of[order[:OWN]] = np.arange(OWN)
    mass = np.cumsum(counts[order[OWN:]] + 0.1)
    class_of[order[OWN:]] = OWN + np.minimum((mass / mass[-1] * (CLASSES - OWN)).astype(np.int64), CLASSES - OWN - 1)
    smooth = counts + 0.1
    return class_of, np.log10(smooth / np.bincount(class_of, weights=smooth, minlength=CLASSES)[class_of])


def biased(w: dict[str, np.ndarray], class_of: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights whose biases are the classes' counts."""
    c = (np.bincount(class_of, weights=counts, minlength=CLASSES) + 0.1).reshape(BRANCHES, BRANCHES)
    w["top_bias"] = np.log(c.sum(1) / c.sum())[None].astype(np.float32)
    w["bias"] = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)
    return w


def score(model: Model, ids: np.ndarray, edges: np.ndarray, at_once: int = 16) -> np.ndarray:
    """log10 probability of each id, given the ids before it in its sequence; edges bound the sequences."""
    out = model.share[ids]
    classes = model.class_of[ids]
    before = np.append(CLASSES, classes[:-1])
    before[edges[:-1][edges[:-1] < len(ids)]] = CLASSES
    w = model.weights
    start, skip, left = (np.array(x, np.int64) for x in zip(*((lo + a, b - a, hi - lo - a) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for a, b in windows(hi - lo)), strict=True)) if len(edges) > 1 else (np.zeros(0, np.int64),) * 3
    # Windows of like length go together, so that short texts are not widened to whole windows.
    wide = np.minimum(-(-left // 16) * 16, LENGTH)
    states, target = [], []
    for kind, size in np.unique(np.stack([skip, wide], 1)[left > 0], axis=0).tolist():
        rows = np.flatnonzero((skip == kind) & (wide == size))
        step = max(1, at_once * LENGTH // size)
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            at = start[own, None] + np.arange(size)
            here = np.arange(size) < left[own, None]
            x = np.where(here, before[np.minimum(at, len(ids) - 1)], CLASSES)
            z, _ = forward(w, x, kind)
            states.append(z[here[:, kind:]])
            target.append(at[:, kind:][here[:, kind:]])
            if sum(map(len, target)) > SETTLED:
                _settle(w, states, target, classes, out)
                states, target = [], []
    if target:
        _settle(w, states, target, classes, out)
    return out


def _settle(w: dict[str, np.ndarray], states: list[np.ndarray], target: list[np.ndarray], classes: np.ndarray, out: np.ndarray) -> None:
    at = np.concatenate(target)
    out[at] += class_log(w, np.concatenate(states), classes[at]) / np.log(10)


def _counted(path: str):
    """(word hash, count) and, with kind 1, (id, count) of training documents, summed within blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, np.zeros(IDS, np.int64)

        def flush() -> pa.RecordBatch:
            token, which = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return row(0, token.view(np.int64), np.bincount(which, weights=np.concatenate([n for _, n in held])).astype(np.int64))

        def row(kind: int, token: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(token), pa.array(n)], names=["kind", "token", "c"])

        for batch in batches:
            for _, _, data, bounds, last in segments(batch["text"], SLICE):
                data = LOWER[data]
                starts, ends, _ = words(data, bounds)
                ids, _, distinct, which = encoder(path).encode(data, starts, ends)
                done = last * (len(bounds) - 1)
                count += np.bincount(ids, minlength=IDS)
                count[END] += done
                held.append((np.append(distinct, np.uint64(END_WORD)), np.append(np.bincount(which, minlength=len(distinct)), done)))
                size += len(distinct)
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            out = flush()
            yield out.filter(pc.greater(out["c"], 0))
        at = np.flatnonzero(count)
        yield row(1, at.astype(np.int64), count[at])

    return lean(run)


def _windows(path: str, class_of: np.ndarray):
    """Windows (h: a hash to order by, x: classes) of streams of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds, last in segments(batch["text"], SLICE):
                data = LOWER[data]
                starts, ends, first = words(data, bounds)
                ids, size, _, _ = encoder(path).encode(data, starts, ends)
                edge = np.append(0, np.cumsum(size))[first]
                stream = np.insert(class_of[ids], np.repeat(edge[1:], 1 + last), np.tile([class_of[END], CLASSES][: 1 + last], len(edge) - 1) if last else CLASSES)
                stream = np.append(CLASSES, stream)
                n = -(-(len(stream) - 1) // LENGTH)
                full = np.full(n * LENGTH + 1, CLASSES, np.uint16)
                full[: len(stream)] = stream
                x = np.lib.stride_tricks.sliding_window_view(full, LENGTH + 1)[::LENGTH]
                h = (mix((x.astype(np.uint64) * powers(LENGTH)[0]).sum(1, dtype=np.uint64)) >> np.uint64(2)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())], names=["h", "x"])

    return lean(run)


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def parts(values: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the weights of each kind."""
    edges = np.cumsum([0, *(int(np.prod(shape)) for shape in SHAPES.values())]).tolist()
    return {k: values[a:b].reshape(shape) for (k, shape), a, b in zip(SHAPES.items(), edges[:-1], edges[1:], strict=True)}


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    return parts(values.astype(np.float32))


def _apart(weights: np.ndarray):
    """Each task goes on training on its own windows; its weights count by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n, held = shaped(weights), 0, []
        steady()

        def learn() -> None:
            nonlocal w, n, held
            x = np.concatenate(held)
            w, n, held = train(w, x, -(-len(x) // TAUGHT), TAUGHT, rate=0.002), n + len(x), []

        for batch in batches:
            held.append(np.frombuffer(b"".join(batch["x"].to_pylist()), np.uint16).reshape(-1, LENGTH + 1))
            if sum(map(len, held)) >= START:
                learn()
        if held and sum(map(len, held)):
            learn()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([n], pa.int64()), pa.array([flat(w).tobytes()], pa.binary())], names=["part", "n", "w"])

    return lean(run)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the weights by n, one row, without holding more than a batch."""
    n, total = 0, 0.0
    for batch in batches:
        for k, w in zip(batch["n"].to_pylist(), batch["w"].to_pylist(), strict=True):
            n, total = n + k, total + k * np.frombuffer(w, np.float32).astype(np.float64)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])


def averaged(found: DataFrame, weights: np.ndarray) -> np.ndarray:
    """What tasks learn from all windows, averaged; the driver gets 16 sets of weights at most."""
    own = found.select("x").mapInArrow(_apart(weights), "part int, n long, w binary")
    rows = own.repartition(16, "part").mapInArrow(_summed, "n long, w binary").collect()
    return sum(np.frombuffer(r["w"], np.float64) for r in rows) / sum(r["n"] for r in rows) if rows else weights


def _blocks(together: int):
    """Rows of documents with the number of their block, and for each block rows of its distinct words, which have no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, size, held = TaskContext.get().partitionId(), 0, 0, []

        def asked() -> pa.RecordBatch:
            own = np.unique(np.concatenate([*held, np.array([END_WORD], np.uint64)])).view(np.int64)
            return row(pa.array(own), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.string()))

        def row(ids: pa.Array, ts: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), (part << 32) + block)), ids, ts, texts], names=["block", "id", "t", "text"])

        for batch in batches:
            for a, b, data, bounds, last in segments(batch["text"], SLICE):
                if size and size + len(data) > together and last:
                    yield asked()
                    block, size, held = block + 1, 0, []
                starts, ends, _ = words(data, bounds)
                held.append(np.unique(word_hashes(data, starts, ends, lower=True)))
                if sum(map(len, held)) > BLOCK // 2:
                    held = [np.unique(np.concatenate(held))]
                size += len(data)
                if last:
                    yield row(batch["id"][a:b], batch["t"][a:b], batch["text"][a:b])
        if held:
            yield asked()

    return lean(run)


def mixture(spelled: np.ndarray, share: np.ndarray, weight: float) -> np.ndarray:
    """log10 of the mixture of each word's probability by attention and its share, which is 0 for unknown words."""
    return np.log(weight * share + (1 - weight) * spelled + 1e-300) / np.log(10)


def by_word(model: Model, texts: pa.Array, path: str, token: np.ndarray, share: np.ndarray, end: bool = True):
    """(row of the text, index of the word's share or -1, attention log10) of all words, and of each text's end, in parts of a bounded size."""
    for a, _, data, bounds, last in segments(texts, SLICE):
        data = LOWER[data]
        starts, ends, first = words(data, bounds)
        ids, size, distinct, which = encoder(path).encode(data, starts, ends)
        row = np.repeat(np.arange(a, a + len(first) - 1), np.diff(first))
        if end and last:
            stop = first[1:]
            distinct = np.append(distinct, np.uint64(END_WORD))
            size, which, row = np.insert(size, stop, 1), np.insert(which, stop, len(distinct) - 1), np.insert(row, stop, np.arange(a, a + len(stop)))
            first = first + np.arange(len(first))
            ids = np.insert(ids.astype(np.int64), (np.append(0, np.cumsum(size))[first[1:]] - np.arange(1, len(first))), END)
        edges = np.append(0, np.cumsum(size))
        places = np.append(0, np.cumsum(score(model, ids, edges[first])))
        j = np.minimum(np.searchsorted(token, distinct), max(0, len(token) - 1))
        own = np.where(token[j] == distinct, j, -1) if len(token) else np.full(len(distinct), -1)
        yield row, own[which], places[edges[1:]] - places[edges[:-1]]


def _scored(model: Model, path: str, below: float):
    """Per document of a block, given the counts of the block's words: its words and end, how many of them are known, and the sums over them of
    log10 of the base's shares and of the mixtures of attention and shares, for each weight. The first document has the sums over all tokens of
    the block's training documents too, each without its own count, by which the weight is chosen."""
    weights = GRID if model.mix is None else (model.mix,)

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        steady()
        token = counts["token"].to_numpy().view(np.uint64)
        o = np.argsort(token)
        c = counts["c"].to_numpy()[o]
        token, share, floor = token[o], (c + 0.1) / 10**below, 0.1 / 10**below
        others = np.where(c > 1, (c - 0.9) / 10**below, 0.0)
        taught = np.array([zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % 10 != 0 for i in docs["id"].to_pylist()])
        n, known, base = (np.zeros(docs.num_rows) for _ in range(3))
        totals, chosen_by = np.zeros((len(weights), docs.num_rows)), np.zeros(len(weights))
        for row, at, attention in by_word(model, docs["text"].combine_chunks(), path, token, share):
            met = at >= 0
            uni = np.where(met, share[at] if len(share) else 0.0, 0.0)
            spelled = np.exp(np.maximum(attention, -280.0) * np.log(10))
            for sums, x in ((n, None), (known, met), (base, np.log10(np.maximum(uni, floor)))):
                sums += np.bincount(row, weights=x, minlength=docs.num_rows)
            for sums, m in zip(totals, weights, strict=True):
                sums += np.bincount(row, weights=mixture(spelled, uni, m), minlength=docs.num_rows)
            if model.mix is None:
                own = taught[row]
                left, spelled = np.where(met, others[at] if len(others) else 0.0, 0.0)[own], spelled[own]
                chosen_by += [mixture(spelled, left, m).sum() for m in weights]
        release()
        best = [chosen_by.tolist() if model.mix is None else None, *[None] * (docs.num_rows - 1)][: docs.num_rows]
        return pa.table({"id": docs["id"], "t": docs["t"], "n": pa.array(n.astype(np.int64)), "known": pa.array(known.astype(np.int64)), "base": pa.array(base), "scores": pa.array(totals.T.tolist(), pa.list_(pa.float64())), "fit": pa.array(best, pa.list_(pa.float64()))})

    return run


def best_weight(out: DataFrame) -> int:
    """Place in GRID of the weight that all training documents are likeliest with; the one nearest to 0.6 where there are none."""
    sums = {r["at"]: r["s"] for r in out.where("fit is not null").select(F.posexplode("fit").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).collect()}
    return max(range(len(GRID)), key=lambda k: (sums.get(k, 0.0), -abs(GRID[k] - 0.6)))


def training(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod(F.crc32(F.coalesce(F.when(F.col("id") != -(2**63), F.col("id")).cast("string"), F.lit(""))), F.lit(10)) != 0)


def learn(docs: DataFrame, counts: DataFrame, ids: np.ndarray, below: float, path: str) -> Model:
    """The attention model, from all training documents (see the head of this file); its mixture is chosen as texts are scored."""
    class_of, share = vocabulary(ids)
    model = Model(class_of, share, biased(initial(), class_of, ids), None)
    size = training(docs).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    # The start is read from documents that hold twice START windows or more; the rest of them, and all others, are read afterwards.
    part = min(1.0, START * LENGTH / max(1.0, 0.25 * size))
    some = training(docs).where(F.pmod(F.xxhash64("t", "id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    found = lambda d: d.select("text").mapInArrow(_windows(path, class_of), "h long, x binary")
    sample = materialize(found(some), "start")
    n = sample.count()
    # Tasks send twice the limit together at most, in expectation.
    rows = sample.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1.0, 2 * START / max(1, n)) * (1 << 30)))
    x = [r["x"] for r in rows.orderBy(F.xxhash64("h"), "x").limit(START).select("x").collect()]
    discard(sample)
    if x:
        x = np.frombuffer(b"".join(x), np.uint16).reshape(-1, LENGTH + 1)
        model.weights = train(model.weights, x, max(200, min(2400, len(x) // 4)))
        if part < 1 or n > len(x):
            model.weights = shaped(averaged(found(training(docs)), flat(model.weights)))
    return model


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, t, n_tokens, n_known, train_tokens, base_score, score): one row for each distinct (id, text) of df.

    Training rows are those whose crc32 of the id as text is not divisible by 10; word and id counts, attention weights
    and the weight of the mixture come from all of them. Null texts are empty: one end token. Null ids count as an empty id
    text; other columns are ignored; an empty table gives no rows. A row that is there twice trains twice. A long text is scored in
    parts of SLICE bytes or more, cut at white space, each with no context from before it. Ids of equal count are ordered by number.
    """
    path = tokenizer or default_path()
    docs = keyed(df, id_col, text_col)
    both = training(docs).select("text").mapInArrow(_counted(path), "kind int, token long, c long").groupBy("kind", "token").agg(F.sum("c").alias("c"))
    both = materialize(both, "word-counts")
    counts = both.where("kind = 0").drop("kind")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ids = np.zeros(IDS)
    for r in both.where("kind = 1").collect():
        ids[r["token"]] = r["c"]
    below = float(np.log10(size["n"] + 0.1 * (size["v"] + 1)))
    model = learn(docs, counts, ids, below, path)
    rows = materialize(docs.mapInArrow(_blocks(TOGETHER), "block long, id long, t long, text string"), "blocks")
    asked = rows.where("text is null").select(F.col("block").alias("own"), F.col("id").alias("token")).join(counts, "token")
    texts = rows.where("text is not null")
    out = texts.groupBy("block").cogroup(asked.groupBy("own")).applyInArrow(_scored(model, path, below), "id long, t long, n long, known long, base double, scores array<double>, fit array<double>")
    best = 0
    if model.mix is None:
        out = materialize(out, "scores")
        discard(rows)
        best = best_weight(out)
    out = out.groupBy("id", "t").agg(F.first(F.struct("n", "known", "base", F.col("scores")[best].alias("score"))).alias("r"))
    return out.select("id", "t", F.col("r.n").alias("n_tokens"), F.col("r.known").alias("n_known"), F.lit(int(size["n"])).cast("long").alias("train_tokens"), F.col("r.base").alias("base_score"), F.col("r.score").alias("score"))


__all__ = ["Model", "lm_scores", "score", "train", "windows"]
