"""The corpus operators against brute force on small fixtures with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caravel.llm import language_model
from caravel.llm.common import NULL_ID, keyed
from caravel.llm.decontamination import Items, align, benchmark_hits, decontaminated, hits
from caravel.llm.jaccard import divide_skip, jaccard_join
from caravel.llm.language_model import BRANCHES, CLASSES, IDS, LENGTH, Model, forward, initial, lm_scores, score, windows
from caravel.llm.licenses import license_scan
from caravel.llm.packing import pack, patterns
from caravel.llm.quality_rules import quality, statistics
from caravel.llm.sharding import shard
from caravel.llm.stages import near_duplicates
from caravel.llm.substring_dedup import SuffixAutomaton, substring_dedup
from caravel.llm.suffix_dedup import suffix_array_dedup
from caravel.llm.tokens import default_path, encode
from caravel.llm.toxicity import SCORE, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id int, t string, score double, spans int, node string"


def corpus():
    rng = random.Random(4)
    vocabulary = ["ab", "cde", "é", "the", "of", "x" * 9, "zz", "q1"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, rows = [prose(200) for _ in range(5)], []
    for _ in range(80):
        text = ""
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            s = rng.randint(0, len(b) - 1)
            text += b[s : s + rng.choice([40, 99, 100, 101, 150, 400])] + rng.choice(["", " ", "\n", prose(5), "a" * rng.randint(0, 250)])
        rows.append((rng.randint(0, 90), text))
    line = "the very common line that many documents share, of some fifty bytes"
    rows += [(200 + i, f"{prose(20)}\n{line}\n{prose(20)}") for i in range(60)]
    return [*rows, (None, None), (1000, None), (1001, ""), (1002, prose(30_000)), rows[3], rows[3]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 0.5, 2, "n") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(d):
    return NULL_ID if d is None else d


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_suffix_array_dedup(docs, empty, rows):
    short = docs.where("doc_id is null or doc_id <> 1002")
    t_of = {(r[0], r[1]): r[2] for r in keyed(short).select("id", "text", "t").collect()}
    own = [(d, t) for d, t in rows if d != 1002]
    seen, want = set(), {}
    for d, t, b in sorted({(key(d), t_of[key(d), t or ""], (t or "").encode()) for d, t in own}):
        mask = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                mask[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        want[d, t] = (len(b), sum(mask), len(re.findall(rb"\x01+", bytes(mask))), hashlib.sha256(bytes(x for x, y in zip(b, mask, strict=True) if not y)).hexdigest())
    got = suffix_array_dedup(short).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    same(map(tuple, got.collect()), [(d, *want[key(d), t_of[key(d), t or ""]]) for d, t in own])
    assert suffix_array_dedup(empty).count() == 0


def test_substring_dedup(docs, empty, rows):
    first, want = {}, []
    split = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, 2**62), key(d))
    for d, w in split:
        mask = [0] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < key(d):
                mask[i : i + 50] = [1] * 50
        want.append((d, len(w), sum(mask), hashlib.sha256(b" ".join(x for x, y in zip(w, mask, strict=True) if not y)).hexdigest()))
    got = substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    same(map(tuple, got.collect()), want)
    assert substring_dedup(empty).count() == 0


def test_automaton_matches():
    a, rng = SuffixAutomaton(), random.Random(1)
    held = [[rng.randrange(3) for _ in range(30)] for _ in range(4)]
    for x in held:
        a.add(x)
    text = [rng.randrange(3) for _ in range(60)]
    inside = lambda s: any(s == x[i : i + len(s)] for x in held for i in range(len(x)))
    assert a.matches(text) == [max((n for n in range(j + 2) if inside(text[j + 1 - n : j + 1])), default=0) for j in range(60)]


def test_jaccard_join(spark, empty):
    rng = random.Random(2)
    prose = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows = []
    for _ in range(15):
        base = prose(rng.randint(3, 100))
        for _ in range(rng.randint(1, 10)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(["other", "W1"])
            rows.append((rng.randint(0, 300), " ".join(t)))
    rows += [(None, None), (7, ""), (None, "a b c"), (9, "a b c"), rows[0], rows[0]]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 2**62), key(d))
    got = jaccard_join(keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).select("id", "n_shingles", "component_id")
    same(map(tuple, got.collect()), [(key(d), len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)])
    assert jaccard_join(keyed(empty)).count() == 0


def test_divide_skip():
    rng = np.random.default_rng(0)
    probe = np.unique(rng.integers(0, 200, 60).astype(np.uint64))
    sets = [np.unique(rng.integers(0, 200, n).astype(np.uint64)) for n in (5, 40, 80, 150, 1)]
    for least in (1, 5, 20, 50):
        want = [len(np.intersect1d(probe, s)) for s in sets]
        assert divide_skip(probe, sets, least).tolist() == [w if w >= least else 0 for w in want]


def test_sharding(docs, empty, rows):
    got = shard(docs.coalesce(2), 7).collect()
    same([(r["doc_id"], r["text"]) for r in got], rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert shard(empty, 7).count() == 0


def test_packing(docs, empty, rows):
    got = pack(docs, 128).collect()
    own = Tokenizer.from_file(default_path())
    ids = [own.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    same([(r["doc_id"], r["start"], r["length"]) for r in got], [(d, a, min(128, len(x) + 1 - a)) for (d, _), x in zip(rows, ids, strict=True) for a in range(0, len(x) + 1, 128)])
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    assert pack(empty, 128).count() == 0
    assert sum(n * len(p) for n, p in patterns({100: 10, 20: 5, 8: 5, 60: 4}, 128)) == 24


def test_statistics(docs, rows):
    want = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c, mask = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), [0] * len(w)
        for i in range(len(w) - 4):
            if c[tuple(w[i : i + 5])] > 1:
                mask[i : i + 5] = [1] * 5
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((key(d), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(mask)))
    got = statistics(keyed(docs)).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    same(map(tuple, got.collect()), want)


def test_quality_rules_learn(spark, docs, empty):
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    rows = [(i, prose().replace(" ", "### ") if i % 4 == 0 else prose(), int(i % 4 != 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out, rules = quality(df.select("doc_id", "text"), df.where("doc_id < 300").select("doc_id", "quality"))
    assert rules.rules
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in out.select("doc_id", "kept").collect())
    out, rules = quality(docs, df.where("false").select("doc_id", "quality"))
    assert not rules.rules and out.count() == docs.count()


def test_toxicity_held_out(spark, docs, empty):
    rng = random.Random(5)
    prose = lambda: [rng.choice("the of erth onand ther ingst reath lyed ation hesh".split()) for _ in range(60)]
    rows = []
    for i in range(400):
        w = prose()
        if i % 3 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["vilegrub", "mudsnout", "rotbrain"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    assert sum((r[SCORE] >= 0.5) == (r["doc_id"] % 3 == 0) for r in got) >= 380
    unlabelled = toxicity(docs, df.where("false").select("doc_id", "toxic"))
    assert {r[SCORE] for r in unlabelled.select(SCORE).collect()} == {0.5}


def test_decontamination(spark, docs, empty):
    rng = random.Random(6)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [prose(30) for _ in range(5)]
    edited = list(items[2])
    edited[5] = edited[20] = "changed"
    del edited[12]
    texts = [prose(80), prose(20) + items[0] + prose(20), prose(9) + [w.upper() for w in edited], items[3][:8] + prose(60), items[4]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, None), (9, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark_hits(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 2), (4, 4)}
    assert (got[1, 0]["start_word"], got[1, 0]["end_word"], got[1, 0]["score"]) == (20, 50, 1.0)
    assert sorted(map(str, (r["doc_id"] for r in decontaminated(df, bench).collect()))) == ["0", "3", "9", "None"]
    assert benchmark_hits(docs.limit(0), bench).count() == 0
    assert benchmark_hits(df, bench.limit(0)).count() == 0


def test_token_ids_are_the_tokenizers():
    rng, own = random.Random(3), Tokenizer.from_file(default_path())
    letters = "etaoinshrdluETA\u00e9\u00c9\u0141\u017f\u00df"
    texts = [" ".join("".join(rng.choice(letters + "0123'.,-!") for _ in range(rng.randint(1, 12))) for _ in range(300)) for _ in range(20)]
    texts += ["It's DON'T we'LL 'sx ''s a\x01b \x1c q\x85z \u0130stanbul \u00d7 \u00f7 <|endoftext|>a <|x \u0391\u03a3 \u65e5\u672c \u00bd\u00b23 e\u0301", "", "\n \t", "x" * 5000, "\u00c0\u00c9" * 300, "ab'" * 300]
    texts += ["don't you'll <|endoftext|> b\u0301 x\u00a0y \ufb01 12345 !!??\n\n\ttab", " 'S 'LL \x1c\x85 q"]
    got = [ids[x:y].tolist() for _, _, ids, bounds in encode(pa.array([*texts, None, *texts]), default_path()) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert got == [*want, [], *want]


def place_logs(weights, class_of, ids):
    """Natural log of the probability of each class of a sequence, window by window, from the full softmax of branches and classes."""
    out = np.zeros(len(ids))
    soft = lambda v: np.exp(v) / np.exp(v).sum()
    for p in range(len(ids)):
        a = max(w for w, b in windows(len(ids)) if b <= p)
        x = np.array([[CLASSES if j == 0 else class_of[ids[j - 1]] for j in range(a, p + 1)]])
        z = forward(weights, x)[0][0, -1].astype(float)
        every = soft(z @ weights["top"] + weights["top_bias"][0])[:, None] * np.array([soft(z @ weights["out"][b] + weights["bias"][b]) for b in range(BRANCHES)])
        assert abs(every.sum() - 1) < 1e-6
        out[p] = np.log(every.ravel()[class_of[ids[p]]])
    return out


def test_every_place_is_scored_once_and_sums_to_one():
    rng = np.random.default_rng(2)
    model = Model(rng.integers(0, CLASSES, IDS), np.zeros(IDS), initial())
    ids, edges = rng.integers(0, IDS, 500), np.array([0, 0, 7, 31, 71, 500])
    got = score(model, ids, edges)
    want = np.concatenate([place_logs(model.weights, model.class_of, ids[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)])
    assert np.abs(got - want / np.log(10)).max() < 1e-4


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(6)
    w = initial()
    x = rng.integers(0, CLASSES + 1, (3, 9))
    loss = lambda v: -np.concatenate([language_model.class_log(v, forward(v, r[None, :-1])[0][0][r[1:] < CLASSES], r[1:][r[1:] < CLASSES]) for r in x]).astype(float).mean()
    got = language_model.gradient(w, x[:, :-1], x[:, 1:])
    for name in w:
        at = np.unravel_index(np.abs(got[name]).argmax(), got[name].shape)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - got[name][at]) < 0.05 * abs(got[name][at]) + 1e-4, name


def test_training_lowers_the_loss_and_averages():
    rng = np.random.default_rng(7)
    x = np.tile(rng.integers(0, 40, 13), (64, 12))[:, : LENGTH + 1]
    x = np.stack([np.roll(r, k) for k, r in enumerate(x)])
    before = language_model.initial()
    after = language_model.train({k: v.copy() for k, v in before.items()}, x, 120)
    loss = lambda w: -language_model.class_log(w, forward(w, x[:4, :-1])[0].reshape(-1, language_model.WIDTH), x[:4, 1:].ravel()).mean()
    assert loss(after) < 0.5 * loss(before)
    w = language_model.flat(after)
    assert all((language_model.shaped(w)[k] == after[k]).all() for k in after)
    rows = pa.RecordBatch.from_pydict({"n": [1, 3], "w": [w.tobytes(), (2 * w).tobytes()]})
    got = next(language_model._summed(iter([rows])))
    assert np.allclose(np.frombuffer(got["w"][0].as_py(), np.float64) / got["n"][0].as_py(), 1.75 * w, rtol=1e-5)


def test_attention_meets_no_keys_beyond_a_block_of_places():
    """Attention of 128 places holds at most two thirds of their pairs, and its states are those of the plain form, whatever the places left out."""
    rng = np.random.default_rng(15)
    w = initial()
    for size in (1, 31, 32, 33, 100, LENGTH):
        x = rng.integers(0, CLASSES + 1, (3, size))
        z, cache = forward(w, x)
        before = np.concatenate([np.full((3, 1), CLASSES), x[:, :-1]], 1)
        e = w["emb"][x] + w["prev"][before] + w["pos"][:size]
        p = np.exp((e @ w["q"]) @ (e @ w["k"]).transpose(0, 2, 1) / np.sqrt(language_model.WIDTH)) * np.tri(size)
        y = e + (p / p.sum(-1, keepdims=True)) @ (e @ w["v"]) @ w["o"]
        want = y + np.maximum(y @ w["a"], 0) @ w["b"]
        assert np.abs(z - want).max() < 1e-4
        for skip in (16, 40):
            assert skip >= size or np.abs(forward(w, x, skip)[0] - want[:, skip:]).max() < 1e-4
        held = [p.size for kept in cache if isinstance(kept, list) for p in kept]
        assert held and (size < LENGTH or sum(held) < 2 / 3 * 3 * LENGTH * LENGTH)


def test_training_is_adam_of_each_kind_of_weights():
    rng = np.random.default_rng(16)
    x = rng.integers(0, CLASSES + 1, (12, LENGTH + 1))
    got = language_model.train(initial(), x, 5, 4, rate=0.002)
    w, r = initial(), np.random.default_rng(11)
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order, at = r.permutation(12), 0
    for t in range(1, 6):
        if at >= 12:
            order, at = r.permutation(12), 0
        own = x[order[at : at + 4]]
        at += 4
        g = language_model.gradient(w, own[:, :-1], own[:, 1:])
        for k in w:
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * s[k] + 0.01 * g[k] ** 2
            w[k] = w[k] - 0.002 * t / 20 * (1 - 0.95 * t / 5) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    assert all(got[k].dtype == np.float32 and np.abs(got[k] - w[k]).max() < 2e-5 for k in w)


def test_score_mixes_words_that_attention_spells(spark, monkeypatch):
    """The whole score against brute force: every word by its ids and by its share, none for words that no training document holds."""
    rng = np.random.default_rng(8)
    model = Model(rng.integers(0, CLASSES, IDS), np.log10(rng.random(IDS) / 50), initial(), 0.3)
    monkeypatch.setattr(language_model, "learn", lambda *_: model)
    texts = ["the cat sat on the mat", "", "The CAT zzyzx", "a\u00e9 b " * 90, "cat"]
    got = {r["id"]: r for r in lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    own = Tokenizer.from_file(default_path())
    lower = [t.translate({c: c + 32 for c in range(65, 91)}).split() for t in texts]
    count = Counter(w for i, ws in enumerate(lower) if zlib.crc32(str(i).encode()) % 10 for w in [*ws, None])
    below = sum(count.values()) + 0.1 * (len(count) + 1)
    for i, ws in enumerate(lower):
        ids = [[language_model.END] if w is None else own.encode(w, add_special_tokens=False).ids for w in [*ws, None]]
        flat = np.array([x for w in ids for x in w])
        logs = place_logs(model.weights, model.class_of, flat) / np.log(10) + model.share[flat]
        want, at = 0.0, 0
        for w, own_ids in zip([*ws, None], ids, strict=True):
            share = (count[w] + 0.1) / below if count[w] else 0.0
            want += math.log10(0.3 * share + 0.7 * 10 ** logs[at : at + len(own_ids)].sum())
            at += len(own_ids)
        assert abs(got[i]["score"] - want) < 1e-3 * max(1, abs(want))


def test_long_texts_are_scored_in_parts(monkeypatch):
    rng = np.random.default_rng(9)
    model = Model(rng.integers(0, CLASSES, IDS), np.zeros(IDS), initial())
    texts = pa.array(["one two three", "long words here and there " * 400, None, "end"])
    rows = lambda: [np.concatenate(x) for x in zip(*language_model.by_word(model, texts, default_path(), np.zeros(0, np.uint64), np.zeros(0)), strict=True)]
    whole = rows()
    monkeypatch.setattr(language_model, "SLICE", 700)
    parts = rows()
    assert (np.bincount(whole[0]) == [4, 2001, 1, 2]).all() and sorted(whole[0]) == sorted(parts[0])
    assert not np.allclose(whole[2], parts[2])  # the parts' first words have no context


def test_lm_scores(spark, docs, empty):
    for n in (0, 1, 15, 16, 47, 48, 49, 111, 112, 113, 127, 128, 129, 224, 239, 240, 241, 255, 256, 257, 1000):
        seen = [p for a, b in windows(n) for p in range(b, min(n, a + LENGTH))]
        assert seen == list(range(n)) or n == 0
    got = lm_scores(docs).collect()
    assert all(r["score"] < 0 and r["base_score"] < 0 and 0 <= r["n_known"] <= r["n_tokens"] for r in got)
    train = [r for r in docs.collect() if zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 10]
    tokens = lambda t: [*WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}).encode()), None]
    count = Counter(w for r in train for w in tokens(r["text"]))
    total = sum(count.values())
    base = {(r["doc_id"], r["text"] or ""): (sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in tokens(r["text"])), len(tokens(r["text"]))) for r in docs.collect()}
    assert sorted((NULL_ID if r["id"] is None else r["id"], round(r["base_score"], 4), r["n_tokens"], r["train_tokens"]) for r in got) == sorted((NULL_ID if i is None else i, round(v, 4), n, total) for (i, _), (v, n) in base.items())
    assert lm_scores(empty).count() == 0


def test_license_scan(spark):
    rows = [(1, "a/b/x.py", "def f(x, y):\n    total = x + y * 3\n    while total > 10:\n        total = total - 4\n    return total\nReleased under the MIT License."), (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "a/b/c/y.py", "code only"), (4, "z/y.py", "nothing"), (5, None, None), (None, "a/q", "")]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert got[1]["license"] == "MIT" and got[2]["is_license_file"]
    assert (got[3]["license"], got[3]["effective_license"]) == (None, "Apache-2.0") and got[3]["inherited_from"] == "a"
    assert got[4]["effective_license"] is None and got[5]["effective_license"] is None
    assert got[None]["effective_license"] == "Apache-2.0"


def test_texts_with_one_id_are_different_documents(spark):
    """600 texts without an id: with 16 bits of the text's hash about three pairs of them were one document."""
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(30)) for _ in range(600)]
    df = spark.createDataFrame([(None, t, "x", "y", len(t)) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    low = {}
    for t, h in keyed(df).select("text", F.pmod(F.xxhash64("text"), F.lit(65536))).collect():
        low.setdefault(h, []).append(t)
    assert any(len(x) > 1 for x in low.values())
    assert keyed(df).select("id", "t").distinct().count() == len(texts)
    same([r["text"] for r in near_duplicates(spark, df, "").collect()], texts)
    a, b = max(low.values(), key=len)[:2]
    cut = suffix_array_dedup(spark.createDataFrame([(None, a), (-5, a), (-5, b)], "doc_id long, text string"), keep_columns=True)
    same([(r["doc_id"], r["text"]) for r in cut.where("n_removed > 0").collect()], [(-5, a)])


def test_decontamination_finds_common_passages(spark):
    """A passage that many documents copied is found beside a full copy, whose own n-grams are the rarest; so is one with words put in."""
    rng = random.Random(9)
    prose = lambda n: [f"p{rng.randrange(4000)}" for _ in range(n)]
    item = [f"i{k}" for k in range(40)]
    spread = [*item[:20], *prose(30), *item[20:]]
    texts = [prose(30) + item[:24] + prose(30) for _ in range(6)] + [item, spread, item[:19] + prose(60)] + [prose(60) for _ in range(51)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["score"], r["start_word"], r["end_word"]) for r in benchmark_hits(df, bench).collect()}
    assert got == {**dict.fromkeys(range(6), (0.6, 30, 54)), 6: (1.0, 0, 40), 7: (0.625, 0, 70)}
    same([r["doc_id"] for r in decontaminated(df, bench).collect()], range(8, 60))


def test_decontamination_equals_aligning_everything():
    rng = np.random.default_rng(10)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(2, 30))).encode()) for k in range(30)]
    items = Items(rows, 3)
    for _ in range(60):
        parts = [rng.permutation(items.words[k])[: rng.integers(0, 3)] if rng.random() < 0.2 else items.words[k][rng.random(len(items.words[k])) < 0.9] for k in rng.integers(0, 30, 4)]
        w = np.concatenate(parts)
        want = {}
        for k, item in enumerate(items.words):
            score = align(item, w)[0] / len(item)
            grams = {tuple(item[i : i + 3]) for i in range(max(1, len(item) - 2))}
            if score >= 0.5 and any(tuple(w[i : i + len(x)]) == x for x in grams for i in range(len(w))):
                want[k] = score
        got = {k: v[0] for k, v in hits(items, w, 0.5).items()}
        assert all(want[k] >= v for k, v in got.items())
        for k in set(want) - set(got):  # only where the best alignment has no three words in a row
            best, end = align(items.words[k], w)
            back = align(items.words[k][::-1], w[:end][::-1])[1]
            assert not any(tuple(w[end - back : end][i : i + 3]) == tuple(items.words[k][j : j + 3]) for i in range(back - 2) for j in range(len(items.words[k]) - 2))


def test_lm_scores_give_every_known_word_its_share(spark, monkeypatch):
    """Blocks of a few documents each, and no list of the most frequent words: a rare word's own count is in the score."""
    rng = random.Random(12)
    monkeypatch.setattr(language_model, "COMMON", 5, raising=False)
    monkeypatch.setattr(language_model, "TOGETHER", 2000, raising=False)
    rows = [(i, " ".join(f"w{min(rng.randrange(200), rng.randrange(200))}" for _ in range(60))) for i in range(120)] + [(500, None), (501, "nowhere seen w1")]
    # the weight of the shares is fixed at one, so the score is the sum over the shares themselves
    monkeypatch.setattr(language_model, "GRID", (1.0,))
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    # words that no training document holds are left to attention, which has no weight here
    assert all((abs(r["score"] - r["base_score"]) < 1e-6) == (r["n_known"] == r["n_tokens"]) for r in got)
    assert all(r["score"] < r["base_score"] - 100 for r in got if r["n_known"] < r["n_tokens"])
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in [*(t or "").split(), None])
    same([(r["id"], r["n_tokens"], r["n_known"]) for r in got], [(i, len((t or "").split()) + 1, sum(train[w] > 0 for w in [*(t or "").split(), None])) for i, t in rows])


def test_license_scan_compares_long_texts(spark):
    """Whole texts of over 4,000 characters: a file of repeated notices, and a long template with some words changed."""
    rng = random.Random(13)
    body = "\n".join(" ".join(f"term{rng.randrange(300)}" for _ in range(12)) for _ in range(80))
    rows = [(1, "a/x.txt", "Licensed under the Apache License, Version 2.0.\n" * 120), (2, "a/b/y.py", "code only"), (3, "c/z.txt", body.replace("term7", "other")), (4, "c/w.py", "more code"), (5, "d/v.txt", "Released under the MIT License.\n" + "unlike words here\n" * 400), (6, "d/u.py", "x")]
    templates = {"Apache-2.0": ("Licensed under the Apache License, Version 2.0.",), "Long-1.0": (body, body.split("\n")[0]), "MIT": ("Released under the MIT License.",)}
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path"), templates=templates).collect()}
    assert all(len(rows[i][2]) > 4000 for i in (0, 2, 4))
    assert [got[i]["is_license_file"] for i in range(1, 7)] == [True, False, True, False, False, False]
    assert [got[i]["effective_license"] for i in (2, 4, 6)] == ["Apache-2.0", "Long-1.0", None]


def test_toxic_dictionary_covers_rare_forms():
    """The contexts of one frequent word must not crowd out a root that a tenth of the toxic texts hold, and that a few others hold once."""
    from caravel.llm import toxicity as module

    rng = random.Random(8)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rare = lambda: "vequ" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    prose = lambda: [word() for _ in range(60)]
    own, other = [], []
    for i in range(600):
        w = prose()
        for _ in range(5):
            w[rng.randrange(60)] = rng.choice(["worthless", "pathetic", "disgusting"]) if i % 10 else rare()
        own.append(" ".join(w).encode())
    for i in range(1200):
        w = prose()
        if i % 60 == 0:
            w[rng.randrange(60)] = rare()
        other.append(" ".join(w).encode())
    content = module.train_dictionary(own, other, 8.0)
    assert all(x in content for x in (b"worthless", b"pathetic", b"disgusting")) and b" vequ" in content
    assert len(content) <= module.CONTENT


def test_toxicity_finds_toxic_documents_of_every_kind(spark):
    """Held-out documents of sf0.1: area under the curve 0.82 at least; it was 0.76 while few segments filled the dictionary."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    rows = toxicity(docs, labels).where(held_out).join(labels.select("doc_id", "toxic"), "doc_id").where("toxic is not null").collect()
    bad, good = [r[SCORE] for r in rows if r["toxic"]], [r[SCORE] for r in rows if not r["toxic"]]
    order = np.argsort(np.argsort(np.array(bad + good), kind="stable")) + 1
    assert (order[: len(bad)].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good)) >= 0.82
    assert np.mean(np.array(good) < 0.5) >= 0.98


def test_lm_learns_from_every_training_document(spark, monkeypatch):
    """Every id of every training document is a target of the attention weights, and the mixture is the likeliest of all their tokens."""
    rng = random.Random(14)
    texts = [" ".join(rng.choice(["the", "of", "cat", "mat", "stone", "river", f"x{rng.randrange(10**6)}"]) for _ in range(rng.choice([0, 3, 90, 700]))) for _ in range(60)]
    taught = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    own = Tokenizer.from_file(default_path())
    ids = lambda t: [*(own.encode(w, add_special_tokens=False).ids for w in t.split()), [language_model.END]]
    learned, chosen = [], []
    averaged, best = language_model.averaged, getattr(language_model, "best_weight", None)

    def spied(found, weights):
        learned.append(sum(int((np.frombuffer(r["x"], np.uint16)[1:] < CLASSES).sum()) for r in found.collect() if r["x"] is not None))
        return averaged(found, weights)

    monkeypatch.setattr(language_model, "averaged", spied)
    monkeypatch.setattr(language_model, "START", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert lm_scores(df).count() == len(texts)
    assert learned == [sum(len(x) for t in taught for x in ids(t))]

    model = Model(np.arange(IDS) % CLASSES, np.log10(np.full(IDS, 0.02)), initial(), None)
    monkeypatch.setattr(language_model, "learn", lambda *_: model)
    monkeypatch.setattr(language_model, "best_weight", lambda out: chosen.append(best(out)) or chosen[-1])
    assert lm_scores(df).count() == len(texts)
    count = Counter(w for t in taught for w in [*t.split(), None])
    below = sum(count.values()) + 0.1 * (len(count) + 1)
    sums = np.zeros(len(language_model.GRID))
    for t in taught:
        parts = ids(t)
        flat = np.array([x for w in parts for x in w])
        logs = place_logs(model.weights, model.class_of, flat) / np.log(10) + model.share[flat]
        edges = np.append(0, np.cumsum([len(w) for w in parts]))
        spelled = np.array([10 ** logs[a:b].sum() for a, b in zip(edges[:-1], edges[1:], strict=True)])
        left = np.array([(count[w] - 0.9) / below if count[w] > 1 else 0.0 for w in [*t.split(), None]])
        sums += [np.log(m * left + (1 - m) * spelled).sum() for m in language_model.GRID]
    assert chosen == [int(np.argmax(sums))]
