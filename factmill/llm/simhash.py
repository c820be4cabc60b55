"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and connected components.

fingerprints(): every shingle counts, repeats included; a bit is 1 if it is set in over half of the hashes of the word
shingles. Equal fingerprints are joined first (one row for each, with its least doc_id), so copies cost nothing
further. A tree of all fingerprints, sent to all tasks, would cost their square. So the bits are parted in blocks, of which any RADIUS
differing bits leave some as they are; a shard is the fingerprints that agree on (the first bits of) these blocks, and each pair of near
fingerprints meets in a shard. The key is as long as keeps some SHARD fingerprints in a shard, whatever their number; a shard
with over TREE of them is dealt out in pairs of parts. A shard's tree goes to the shard's own task alone.

In a shard a BK-tree is built (children are keyed by the Hamming distance to their parent) and every fingerprint is
looked up: from a node at distance d only edges d - 3 to d + 3 are followed. Whole levels of (query, node) pairs are
handled at once. Links are folded into the shard's components on the spot, so a shard of m fingerprints returns fewer
than m links and not their square. Components over all shards come from alternating star contractions, each round
written to the shared folder; nothing is collected.

Null and empty texts have no words and fingerprint 0, which links like any other. Rows with equal doc_id are rows of
their own. A null doc_id is no candidate for the least one; a component of such rows alone has a null id. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, small_side, texts, tidy

RADIUS = 3
_NO_ID = (1 << 63) - 1
#: Distinct fingerprints of a shard on average, and of a part of a shard at most.
SHARD, TREE = 1024, 4096
#: (query, node) pairs that a lookup handles at once.
PAIRS = 1 << 18


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of one text."""
    return int(_prints([text], words)[0])


_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SPACES = bytes([9, 10, 11, 12, 13])


def shingles(items: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, as uint64, and how many each text has. Words are split on UTF-8 bytes: the
    separators are ASCII, so no character is cut."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    table = bytes.maketrans(_UPPER + _SPACES, _LOWER + b" " * 5)
    hashes, counts = [], np.zeros(len(items), np.int64)
    for k, text in enumerate(items):
        w = [x for x in text.encode("utf-8", "surrogatepass").translate(table).split(b" ") if x]
        if not w:
            continue
        if len(w) <= words:
            own = [digest(b" ".join(w), 42)]
        else:
            line = b" ".join(w)
            size = np.fromiter(map(len, w), np.int64, len(w))
            ends = np.cumsum(size + 1) - 1
            starts = ends - size
            view = memoryview(line)
            own = [digest(view[a:b], 42) for a, b in zip(starts[: 1 - words].tolist() if words > 1 else starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
        hashes += own
        counts[k] = len(own)
    return np.array(hashes, np.uint64), counts


def _prints(items: list[str], words: int) -> np.ndarray:
    """Fingerprints, as uint64."""
    out = np.zeros(len(items), np.uint64)
    h, counts = shingles(items, words)
    at = 0
    for lo, hi in _blocks(counts):
        n = counts[lo:hi]
        some = h[at : at + int(n.sum())]
        at += len(some)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        bits = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, np.cumsum(n[full]) - n[full], axis=0, dtype=np.int64)
        set_ = (2 * sums > n[full][:, None]).astype(np.uint8)
        out[lo + full] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _blocks(counts: np.ndarray, limit: int = 1 << 17):
    """Ranges of documents with at most limit shingles together, or one document."""
    done = np.cumsum(counts)
    lo, base = 0, 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(done, base + limit, side="right")))
        yield lo, hi
        base, lo = int(done[hi - 1]), hi


def _fingerprint_batches(words: int, batches):
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 20):
            prints = _prints(texts(piece), words)
            yield pa.record_batch([piece.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(partial(_fingerprint_batches, words)), "doc_id long, fp long")


class BKTree:
    """Over n items with an integer distance. Node 0 is the root; a node's children are keyed by their distance to it.

    distance takes two arrays of items and returns their distances one by one. The tree is built level by level: the first node
    of a group becomes the parent, and the rest are grouped by their distance to it. A node's children stand together, ordered by key.
    pairs: (query, node) pairs that a lookup handles at once.
    """

    def __init__(self, n: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], pairs: int = PAIRS):
        self.n, self.distance, self.pairs = n, distance, pairs
        self.order = np.zeros(n, np.int64)  # the item of each node
        self.key = np.zeros(n, np.int64)
        self.first = np.zeros(n, np.int64)  # first child
        self.children = np.zeros(n, np.int64)
        if not n:
            return
        members = np.arange(n)  # all that are in no node yet, by group
        sizes = np.array([n])
        nodes, level = 1, np.array([0])  # the groups' nodes
        while len(members):
            heads = np.cumsum(sizes) - sizes
            self.order[level] = members[heads]
            parent = np.repeat(np.arange(len(sizes)), sizes)
            rest = np.ones(len(members), bool)
            rest[heads] = False
            members, parent, head = members[rest], parent[rest], members[heads]
            d = self._between(members, head[parent])
            width = int(d.max(initial=0)) + 1
            by = np.argsort(parent * width + d, kind="stable")
            members, code = members[by], (parent * width + d)[by]
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(start, len(code)))
            group = code[start] // width
            new = nodes + np.arange(len(start))
            self.key[new] = code[start] % width
            self.children[level] = np.bincount(group, minlength=len(level))
            self.first[level] = nodes + np.cumsum(self.children[level]) - self.children[level]
            nodes, level = nodes + len(start), new

    @classmethod
    def of_prints(cls, prints: np.ndarray) -> BKTree:
        """Over fingerprints, by Hamming distance."""
        return cls(len(prints), lambda a, b: np.bitwise_count(prints[a] ^ prints[b]))

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parts = [self.distance(a[lo : lo + self.pairs], b[lo : lo + self.pairs]) for lo in range(0, len(a), self.pairs)]
        return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)

    def within(self, radius: int | np.ndarray):
        """(query, item, distance) arrays of all pairs of items within the radius, or within that of the query, block by block."""
        radius = np.broadcast_to(np.asarray(radius, np.int64), self.n)
        step = max(1, self.pairs // 64)
        for lo in range(0, self.n, step):
            stack = [(np.arange(lo, min(lo + step, self.n)), np.zeros(min(step, self.n - lo), np.int64))]
            while stack:
                q, node = stack.pop()
                d = self._between(q, self.order[node])
                near = d <= radius[q]
                if near.any():
                    yield q[near], self.order[node[near]], d[near]
                n = self.children[node]
                open_ = n > 0
                q, node, d, n = q[open_], node[open_], d[open_], n[open_]
                if not len(q):
                    continue
                ends = np.cumsum(n)
                for a, b in _blocks(n, self.pairs):
                    m = n[a:b]
                    each = np.repeat(np.arange(a, b), m)
                    child = self.first[node[each]] + np.arange(len(each)) - np.repeat(ends[a:b] - m - (ends[a] - n[a]), m)
                    follow = np.abs(self.key[child] - d[each]) <= radius[q[each]]
                    if follow.any():
                        stack.append((q[each[follow]], child[follow]))


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least index of each index's component under the links (a, b), going on from label if given."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def _links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each of a shard's fingerprints to the first of its component in the shard."""
    label = np.arange(len(prints))
    for a, b, _ in BKTree.of_prints(prints).within(radius):
        far = label[a] != label[b]
        if far.any():
            label = components(len(prints), a[far], b[far], label)
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return prints[linked], prints[label[linked]]


def grouped(batches):
    """(start, stop, table) of each run of equal values in the first column of sorted rows, whole, though it spans batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield from _runs(held)
            held = []
        cut_ = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
        if cut_:
            yield from _runs([*held, batch.slice(0, cut_)])
            held = []
        held.append(batch.slice(cut_))
    if held:
        yield from _runs(held)


def _runs(parts: list[pa.RecordBatch]):
    table = pa.Table.from_batches(parts).combine_chunks()
    key = table.column(0).to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield a, b, table


def _shard_links(radius: int, batches):
    """Takes rows (deal, fp) sorted by deal."""
    found, size = [], 0
    for a, b, table in grouped(batches):
        if b - a > 1:
            found.append(_links(table.column(1).to_numpy()[a:b].view(np.uint64), radius))
            size += len(found[-1][0])
        if size > 1 << 16:
            yield pa.record_batch([pa.array(np.concatenate([x[i] for x in found]).view(np.int64)) for i in (0, 1)], names=["a", "b"])
            found, size = [], 0
    if found:
        yield pa.record_batch([pa.array(np.concatenate([x[i] for x in found]).view(np.int64)) for i in (0, 1)], names=["a", "b"])


def dealt(rows: DataFrame, shard: str, member: str, most: int, weight: Column | None = None) -> DataFrame:
    """rows with a column `deal`: the shard, or for shards that weigh over `most` a key for each pair of parts, in which every two
    of its members meet. Rows are parted by their member; a row is copied once for each other part."""
    weight = F.lit(1) if weight is None else weight
    heavy = cut(rows.groupBy(shard).agg(F.sum(weight).alias("m")).where(F.col("m") > most))
    if not heavy.head(1):
        return rows.withColumn("deal", F.col(shard))
    parts = rows.join(small_side(heavy), shard, "left").withColumn("g", F.coalesce(F.ceil(2 * F.col("m") / most), F.lit(1)).cast("int")).withColumn("p", F.pmod(F.xxhash64(member), F.col("g")).cast("int"))
    others = F.when(F.col("g") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda x: x != F.col("p")))
    each = parts.withColumn("o", F.explode(others))
    deal = F.when(F.col("g") == 1, F.col(shard)).otherwise(F.xxhash64(F.col(shard), F.least("p", "o"), F.greatest("p", "o")))
    return each.withColumn("deal", deal).drop("m", "g", "p", "o")


def layout(n: int, radius: int = RADIUS, shard: int = SHARD) -> tuple[int, int, int]:
    """(blocks, how many of them make a key, bits of each that count) for n fingerprints: any `radius` differing bits leave so many equal."""
    need = max(0, (max(n, 1) - 1).bit_length() - (shard.bit_length() - 1))
    agreed = next((k for k in range(1, 64 - radius) if 64 // (radius + k) * k >= need), 64 - radius)
    return radius + agreed, agreed, -(-need // agreed)


def near_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, most: int = TREE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join what lies within the radius."""
    blocks, agreed, bits = layout(prints.count(), radius, shard)
    width = 64 // blocks
    shards = []
    for k, some in enumerate(combinations(range(blocks), agreed) if bits else [()]):
        value = F.lit(k)
        for x in some:
            value = F.xxhash64(value, F.shiftrightunsigned(F.col("fp"), x * width).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        shards.append(value.cast("long"))
    rows = prints.select(F.explode(F.array(*shards)).alias("shard"), "fp")
    sorted_ = dealt(rows, "shard", "fp", most).select("deal", "fp").repartition("deal").sortWithinPartitions("deal")
    return sorted_.mapInArrow(tidy(partial(_shard_links, radius)), "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for nodes that have links; by alternating stars.

    Large star: each node's larger neighbours are linked to its least one. Small star: its smaller neighbours are. Both
    keep the components; when neither changes the links, every link goes to its component's least node.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def total(e):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    before = total(edges)
    while before["n"]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = cut(small)
        after = total(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that links reach)."""
    prints = cut(fingerprints(docs, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(connected(near_links(distinct.select("fp"), radius)))
    roots = roots.union(roots.select("root", "root").distinct())
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    least = linked.where("root is not null").groupBy("root").agg(F.min("least").alias("of_root"))
    of = linked.join(least, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("of_root")).alias("component_id"))
    return prints.join(of, "fp")


def op7_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
