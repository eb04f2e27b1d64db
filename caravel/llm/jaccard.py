"""N-gram Jaccard join by T-occurrence search.

Two sets with Jaccard similarity of at least t share T >= t / (1 + t) * (|x| + |y|) shingles. Shingles are ordered from rare to frequent;
the lists of frequent shingles are the long ones. Short lists only are merged across the corpus: those of the first
|x| - ceil(t |x|) + 1 shingles of each set, one of which any linked pair shares. Candidates are then searched in blocks: the lists that a
block has for the shingles of one document are merged where they are short, and its long lists are probed by binary search for what
reached T minus their number (DivideSkip). Links are unions of classes of equal sets, so exact copies are one node.

Candidates are not all pairs of a list. First each list's hub, in which the list's shingle stands earliest, is searched against the
others. Whatever that leaves in different components is then searched across components, so no link between two texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, discard, materialize, partitions
from .textops import chunks, lean, mix, release, shingles, word_hashes, words

FREQUENT_LIMIT = 65_536
#: Shingles that a task holds before it sends them on.
BLOCK = 500_000
#: Sets that a task remembers to have sent, as 8 bytes each: it may send others twice, which grouping them takes back.
REMEMBERED = 1 << 18
MEMBER = np.dtype([("token", "<u8"), ("h", "<u8"), ("g", "<u8"), ("n", "<u4"), ("pos", "<u4"), ("f", "u1")])
#: Distinct sets with one shingle in a block from which its list is dealt out by set.
MANY = 24


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for a, _, data, bounds in chunks(batch["text"]):
            starts, ends, first = words(data, bounds)
            for i, s in enumerate(shingles(word_hashes(data, starts, ends, lower=True), first, n)):
                yield batch, a + i, s


def _node(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def _bins(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of equal ranges of hashes, about four to a range; 255: that many or more."""
    bits = min(16, max(4, (len(s) // 4).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _most(x: bytes, y: bytes) -> int:
    """No two sets with these bins share more; a large number where that cannot be told."""
    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    if (a == 255).any() or (b == 255).any():
        return 1 << 40
    if len(a) != len(b):
        a, b = (v.astype(np.int64).reshape(min(len(a), len(b)), -1).sum(1) for v in (a, b))
    return int(np.minimum(a, b).sum())


def _bytes(h: int, g: int) -> bytes:
    return h.to_bytes(8, "big") + g.to_bytes(8, "big")


def _surveyed(n: int):
    """kind 0: one row per document; kind 1: shingles that are in eight documents of a block or more, with the count in n."""

    def heavy(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        keep = count >= 8
        k = int(keep.sum())
        return _rows([1] * k, [0] * k, [0] * k, token[keep].view(np.int64), count[keep], [None] * k, [None] * k)

    def _rows(kind, ids, ts, token, count, node, bins) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(ids, pa.int64()), pa.array(ts, pa.int64()), pa.array(token, pa.int64()), pa.array(count, pa.int64()), pa.array(node, pa.binary()), pa.array(bins, pa.binary())],
            names=["kind", "id", "t", "token", "n", "node", "bins"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, []
        for batch, i, s in _sets(batches, n):
            bins = _bins(s)
            rows.append((0, batch["id"][i].as_py(), batch["t"][i].as_py(), 0, len(s), _bytes(*_node(s)) if len(s) else None, bins.tobytes() if len(s) else None))
            held.append(s)
            size += len(s)
            if len(rows) >= 2000 or size >= BLOCK:
                yield _rows(*zip(*rows, strict=True))
                rows = []
                if size >= BLOCK:
                    yield heavy(held)
                    held, size = [], 0
        if rows:
            yield _rows(*zip(*rows, strict=True))
        if held:
            yield heavy(held)

    return lean(run)


def _dealt(n: int, percent: int, frequent: np.ndarray, rank: np.ndarray, buckets: int):
    """Prefixes of all sets as blobs of members per bucket of the shingle."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        m = np.concatenate(held)
        m = m[np.lexsort((m["g"], m["h"], m["token"]))]
        same = (m["token"][1:] == m["token"][:-1]) & (m["h"][1:] == m["h"][:-1]) & (m["g"][1:] == m["g"][:-1])
        m = m[np.append(True, ~same)]
        new = np.append(True, m["token"][1:] != m["token"][:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > MANY
        m["f"][many] = 1
        bucket = (mix(m["token"]) % np.uint64(buckets)).astype(np.int32)
        bucket[many] = (mix(m["h"][many]) % np.uint64(buckets)).astype(np.int32)
        signs = m[many & new].copy()
        signs["f"] = 2
        m, bucket = np.concatenate([m, signs]), np.concatenate([bucket, (mix(signs["token"]) % np.uint64(buckets)).astype(np.int32)])
        o = np.argsort(bucket, kind="stable")
        m, bucket = m[o], bucket[o]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([m[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(m)), strict=True)], pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, s in _sets(batches, n):
            if not len(s):
                continue
            length = len(s) - (len(s) * percent + 99) // 100 + 1
            place = np.zeros(len(s), np.int64)
            if len(frequent):
                i = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                place = np.where(frequent[i] == s, rank[i] + 1, 0)
            own = s[np.argsort(place, kind="stable")[:length]]
            m = np.zeros(len(own), MEMBER)
            m["token"], m["n"], m["pos"] = own, len(s), np.arange(len(own))
            m["h"], m["g"] = _node(s)
            held.append(m)
            size += len(m)
            if size >= BLOCK // 2:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return lean(run)


def _shared(group: pa.Table) -> pa.Table:
    """Members of lists with two sets or more."""
    m = np.concatenate([np.frombuffer(x, MEMBER) for x in group["blob"].to_pylist()])
    signs, sure = np.unique(m["token"][m["f"] == 2]), m[m["f"] == 1]
    m = m[m["f"] == 0]
    m = m[np.lexsort((m["g"], m["h"], m["token"]))]
    if len(m):
        same = (m["token"][1:] == m["token"][:-1]) & (m["h"][1:] == m["h"][:-1]) & (m["g"][1:] == m["g"][:-1])
        m = m[np.append(True, ~same)]
        group_of = np.cumsum(np.append(True, m["token"][1:] != m["token"][:-1])) - 1
        m = m[(np.bincount(group_of)[group_of] > 1) | np.isin(m["token"], signs)]
    m = np.concatenate([m, sure])
    nodes = np.stack([m["h"], m["g"]], 1).astype(">u8").tobytes()
    return pa.table({"token": pa.array(np.ascontiguousarray(m["token"]).view(np.int64)), "node": pa.array([nodes[i : i + 16] for i in range(0, len(nodes), 16)], pa.binary()), "n": pa.array(m["n"].astype(np.int64)), "pos": pa.array(m["pos"].astype(np.int64))})


def divide_skip(probe: np.ndarray, sets: list[np.ndarray], least: int) -> np.ndarray:
    """How many shingles each set of a block shares with probe, exactly where that is `least` or more (else 0)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token = np.concatenate(sets) if sets else probe[:0]
    i = np.minimum(np.searchsorted(probe, token), len(probe) - 1)
    hit = probe[i] == token
    list_of, member = i[hit], owner[hit]
    o = np.lexsort((member, list_of))
    list_of, member = list_of[o], member[o]
    size = np.bincount(list_of, minlength=len(probe))
    long_count = min(int(least / (np.log2(max(2, size.max(initial=1))) + 1)), least - 1, len(probe))
    long_lists = np.argsort(-size, kind="stable")[:long_count]
    is_long = np.zeros(len(probe), bool)
    is_long[long_lists] = True
    count = np.bincount(member[~is_long[list_of]], minlength=len(sets))  # merge of the short lists
    alive = np.flatnonzero(count >= least - long_count)
    begin = np.cumsum(size) - size
    for j in long_lists:
        own = member[begin[j] : begin[j] + size[j]]
        if len(own) and len(alive):
            at = np.minimum(np.searchsorted(own, alive), len(own) - 1)
            count[alive[own[at] == alive]] += 1
    keep = np.zeros(len(sets), bool)
    keep[alive] = True
    return np.where(keep & (count >= least), count, 0)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a column of sets, without copying, and the bounds of each set."""
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint64, int(offsets[-1]) // 8) if data is not None and len(column) else np.zeros(0, np.uint64)), offsets // 8


def _search(percent: int):
    """Rows (a, b, sa, sb) to links (a, b); rows with one a that follow each other are one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (va, oa), (vb, ob) = _values(batch["sa"]), _values(batch["sb"])
            node = batch["a"].to_pylist()
            found, i = [], 0
            while i < len(node):
                j = i + 1
                while j < len(node) and node[j] == node[i] and ob[j + 1] - ob[i] <= BLOCK // 4:
                    j += 1
                probe, sets = va[oa[i] : oa[i + 1]], [vb[x:y] for x, y in zip(ob[i:j], ob[i + 1 : j + 1], strict=True)]
                total = len(probe) + np.diff(ob[i : j + 1])
                count = divide_skip(probe, sets, max(1, int(-(-percent * total.min() // (100 + percent)))))
                found.append(i + np.flatnonzero((count > 0) & (100 * count >= percent * (total - count))))
                i = j
            at = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(at), batch["b"].take(at)], names=["a", "b"])

    return lean(run)


def _contents(n: int, mask: np.ndarray):
    """(node, set) of the documents whose node may be asked for: mask is a bit table of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, size, seen = [], [], 0, np.zeros(REMEMBERED, np.uint64)
        for _, _, s in _sets(batches, n):
            if not len(s):
                continue
            h, g = _node(s)
            bit = g % (len(mask) * 64)
            if not int(mask[bit >> 6]) >> (bit & 63) & 1 or int(seen[h % REMEMBERED]) == h ^ g:
                continue
            seen[h % REMEMBERED] = h ^ g
            nodes.append(_bytes(h, g)), sets.append(s.tobytes())
            size += len(s)
            if size >= BLOCK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "s"])
                nodes, sets, size = [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "s"])

    return lean(run)


def _similar(percent: int):
    """Drops pairs whose sets cannot share enough by the sizes of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch["xn"].to_numpy() + batch["yn"].to_numpy()
            ok = pa.array([(100 + percent) * _most(x.as_py(), y.as_py()) >= percent * t for x, y, t in zip(batch["xbins"], batch["ybins"], total.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(ok), batch["b"].filter(ok)], names=["a", "b"])

    return lean(run)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that link."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("xn"), F.col("bins").alias("xbins"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("yn"), F.col("bins").alias("ybins"))
    pairs = materialize(pairs.join(x, "a").join(y, "b").mapInArrow(_similar(percent), "a binary, b binary"), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    bits = 1 << 24  # 2 MB, whatever the input; a fuller table lets more sets pass
    bit = F.pmod(F.conv(F.hex(F.substring("node", 15, 2)), 16, 10).cast("long") + F.conv(F.hex(F.substring("node", 13, 2)), 16, 10).cast("long") * 65536, F.lit(bits))
    table = asked.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v"))
    mask = np.zeros(bits // 64, np.uint64)
    for r in table.collect():
        mask[r["w"]] = r["v"] & (2**64 - 1)
    sets = docs.mapInArrow(_contents(n, mask), "node binary, s binary").groupBy("node").agg(F.first("s").alias("s"))
    sets = materialize(sets, "sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    found = both.mapInArrow(_search(percent), "a binary, b binary")
    return materialize(found, "links")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node with a link, comp the least node of its component, by alternating large and small stars."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    now = print_of(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(old)
        before, now = now, print_of(edges)
        if before == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def _possible(percent: int) -> str:
    """Two members of a list whose shingle is the first they share can still reach the overlap."""
    return f"100 * least(xn, yn) >= {percent} * greatest(xn, yn) and {100 + percent} * least(xn - xpos, yn - ypos) >= {percent} * (xn + yn)"


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(id, t, n_shingles, component_id, first) per row of docs, which is (id, t, text) as from common.keyed().

    Sets are the distinct n-word shingles of the whole text with A-Z lower-cased; fewer words are one shingle, no words the empty set,
    linked with nothing. Documents link at a Jaccard similarity of percent / 100 or more; component_id is the smallest id that links
    reach (NULL_ID where that row's id is null). first marks the rows that are the component's one document, the least (id, t): repeated
    rows all carry it. Ties of frequency are ordered by hash; nothing is capped: the frequent shingles, 65,536 at most, only order the
    lists, which changes no result.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    survey = materialize(docs.mapInArrow(_surveyed(n), "kind int, id long, t long, token long, n long, node binary, bins binary"), "survey")
    heavy = survey.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT_LIMIT).collect()
    token, rank = np.array([r["token"] for r in heavy], np.int64).view(np.uint64), np.arange(len(heavy), 0, -1)
    o = np.argsort(token)
    own = survey.where("kind = 0").select("id", "t", "n", "node", "bins")
    nodes = own.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "t")).alias("least"), F.first("n").alias("n"), F.first("bins").alias("bins"))
    nodes = materialize(nodes, "nodes")
    lists = docs.mapInArrow(_dealt(n, percent, token[o], rank[o], buckets), "bucket int, blob binary")
    lists = materialize(lists.groupBy("bucket").applyInArrow(_shared, "token long, node binary, n long, pos long"), "lists")
    hub = lists.groupBy("token").agg(F.min(F.struct(F.col("pos").alias("xpos"), F.col("node").alias("a"), F.col("n").alias("xn"))).alias("hub")).select("token", "hub.*")
    member = lists.select("token", F.col("node").alias("b"), F.col("n").alias("yn"), F.col("pos").alias("ypos"))
    stars = member.join(hub, "token").where("a <> b").where(_possible(percent)).select("a", "b").distinct()
    links = _verified(docs, nodes, stars, n, percent)
    comps = materialize(components(links), "components")
    # What different components still share: the largest component of a list is not searched against itself.
    labelled = lists.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = labelled.groupBy("token", "comp").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("token").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("top")).where("comps > 1").select("token", "top")
    mixed = materialize(labelled.join(largest, "token"), "mixed")
    few = mixed.where("comp <> top").select("token", F.col("node").alias("a"), F.col("n").alias("xn"), F.col("pos").alias("xpos"), F.col("comp").alias("ca"))
    rest = mixed.select("token", F.col("node").alias("b"), F.col("n").alias("yn"), F.col("pos").alias("ypos"), F.col("comp").alias("cb"), "top")
    more = few.join(rest, "token").where("ca <> cb and (cb = top or a < b)").where(_possible(percent)).select("a", "b").distinct()
    more = more.join(stars, ["a", "b"], "left_anti")
    comps = materialize(components(links.unionByName(_verified(docs, nodes, more, n, percent))), "components")
    named = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("node", "comp", "least")
    by_comp = named.groupBy("comp").agg(F.min("least").alias("first"))
    label = named.select("node", "comp").join(by_comp, "comp").select("node", "first")
    out = own.select("id", "t", F.col("n").alias("n_shingles"), "node").join(label, "node", "left")
    return out.select("id", "t", "n_shingles", F.coalesce("first.id", "id").alias("component_id"), F.coalesce((F.col("first.id") == F.col("id")) & (F.col("first.t") == F.col("t")), F.lit(True)).alias("first"))


__all__ = ["NULL_ID", "components", "divide_skip", "jaccard_join"]
