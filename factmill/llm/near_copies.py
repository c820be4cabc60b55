"""Near copies for the pipeline: SimHash over five-word shingles, BK-trees over its fingerprints, components, and an exact check of the sets: a
Jaccard similarity of 0.8 or more.

Of 64 bits a pair at 0.8 differs in some ten, give or take three, which no radius parts well from what is less similar. So a fingerprint has
BITS bits: there such a pair differs in 39, give or take six, unlike texts in half of them, and RADIUS lies between. Copies of a few
shingles swing more; FEW of them have a radius of their own.

A shard is the fingerprints that agree on some of their bits, drawn at random: as many as keep some SHARD of them in a
shard, whatever their number, drawn as often as leaves a pair at 0.8 apart with a chance of MISSED at most (missed()). In a shard a
BK-tree is built and every fingerprint looked up; links are folded into the shard's components on the spot, and a shard of over
TREE is dealt out in pairs of parts. The components of these links, by alternating stars, are the candidates.

What goes is decided by the sets, in whole numbers, within each of these components. First its members meet HEADS of them. Components that
this does not join are searched again by BK-trees over fingerprints, now with the sets beside them, and a pair links if its sets are as similar as NEAR.
A component with many members, or long ones, is dealt out in pairs of parts; each task returns fewer links than it has members. So every two
members of a component are looked up or joined by links that are, and no task holds a group without a bound.

Equal sets are one node. Null and empty texts have the empty set and are copies of each other. A text of fewer words than five is one
shingle; sets of fewer shingles than LEAST are as similar as 0.8 to equal ones alone. Rows with equal doc_id are rows of their own. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few_files, fresh, pieces, quoted, small_side, texts, tidy
from .simhash import TREE, BKTree, components, connected, dealt, grouped, shingles

WORDS = 5
#: Least Jaccard similarity, as a fraction.
NEAR = (4, 5)
#: Bits of a fingerprint, and how many of them near copies differ in at most: sets of FEW shingles or more, and smaller ones.
BITS, RADIUS, FEW, RADIUS_OF_FEW = 256, 60, 16, 70
#: Shingles of the least set that has near copies other than itself.
LEAST = NEAR[0]
#: Fingerprints of a shard on average; share of the pairs at NEAR that may be missed (missed()), and the share of bits in which they agree.
SHARD, MISSED = 128, 1e-3
AGREED = 1 - math.acos(2 * NEAR[0] / sum(NEAR)) / math.pi
#: Members of a candidates' component that all others meet first.
HEADS = 4
#: Members of a part of a component at most, and the shingles that count as one member.
PART, SHINGLES = 256, 4096
_NO_ID = (1 << 63) - 1
#: Shingles whose bits are counted at once.
_STEP = 1 << 15
_WORDS = BITS // 64
_PRINT = [f"f{i}" for i in range(_WORDS)]
_SEEDS = np.random.default_rng(5).integers(0, 1 << 64, _WORDS, np.uint64)
_M = np.uint64(0xFF51AFD7ED558CCD)
#: What a bit gets for which as many shingles vote as against it.
_TIES = np.random.default_rng(6).integers(0, 2, BITS, np.uint8)
#: A byte's eight bits as eight counters.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _sets(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in order, one text after another, and the place where each text's begin."""
    h, counts = shingles(items, WORDS)
    document = np.repeat(np.arange(len(items)), counts)
    by = np.lexsort((h, document))
    h, document = h[by], document[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (document[1:] != document[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(document[new], minlength=len(items)))]).astype(np.int64)


def _keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), 7) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SimHash of each set: a row of BITS bits, as uint64. A bit is 1 if it is set in over half of the set's hashes; _TIES tells for half."""
    n = np.diff(bounds)
    votes = np.zeros((len(n), BITS), np.int32)
    full = np.flatnonzero(n)
    starts = bounds[:-1][full]
    for lo in range(0, len(h), _STEP):
        part = h[lo : lo + _STEP]
        first = max(0, int(np.searchsorted(starts, lo, side="right")) - 1)
        last = int(np.searchsorted(starts, lo + len(part)))
        at = np.maximum(starts[first:last] - lo, 0)
        runs = np.unique(np.concatenate([at, np.arange(0, len(part), 255)]))  # a counter has eight bits
        of = np.searchsorted(runs, at)
        for j in range(_WORDS):
            mixed = (part ^ _SEEDS[j]) * _M
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _M
            mixed ^= mixed >> np.uint64(29)
            counted = np.add.reduceat(_COUNTERS[mixed.view(np.uint8)].reshape(-1, 8), runs, axis=0)
            votes[full[first:last], 64 * j : 64 * j + 64] += np.add.reduceat(counted.view(np.uint8).reshape(len(runs), 64), of, axis=0, dtype=np.int32)
    more = 2 * votes - n[:, None]
    return np.packbits((more > 0) | ((more == 0) & (_TIES == 1)), axis=1).view(np.uint64)


def _radius(n: np.ndarray) -> np.ndarray:
    return np.where(n < FEW, RADIUS_OF_FEW, RADIUS)


def _tree(prints: np.ndarray) -> BKTree:
    """Over fingerprints, by Hamming distance."""
    return BKTree(len(prints), lambda a, b: np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64))


def missed(bits: int, draws: int) -> float:
    """Share of the pairs at NEAR, large sets of equal size, that no shard holds or that the radius leaves out."""
    total = 0.0
    for x in range(BITS + 1):
        share = math.comb(BITS, x) * (1 - AGREED) ** x * AGREED ** (BITS - x)
        together = math.prod(max(0, BITS - x - i) / (BITS - i) for i in range(bits))
        total += share * ((1 - together) ** draws if x <= RADIUS else 1)
    return total


def layout(n: int, shard: int = SHARD) -> tuple[int, int]:
    """(bits that a shard agrees on, how often they are drawn) for n fingerprints."""
    bits = max(0, (max(n, 1) - 1).bit_length() - (shard.bit_length() - 1))
    return bits, next(draws for draws in range(1, 1 << 15) if not bits or missed(bits, draws) <= MISSED)


def shards(prints: np.ndarray, bits: int, draws: int) -> np.ndarray:
    """A key for each fingerprint and draw."""
    out = np.tile(np.arange(1, draws + 1, dtype=np.uint64) << np.uint64(48), (len(prints), 1))
    r = np.random.default_rng(7)
    for k in range(draws):
        for i, bit in enumerate(r.choice(BITS, bits, replace=False).tolist()):
            out[:, k] |= (prints[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)) << np.uint64(i)
    return out.view(np.int64)


def _sketch_batches(batches):
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 20):
            h, bounds = _sets(texts(piece))
            prints = fingerprints(h, bounds).view(np.int64)
            yield pa.record_batch([piece.column(0), piece.column(1), pa.array(_keys(h, bounds)), pa.array(np.diff(bounds)), *map(pa.array, prints.T.copy())], names=["doc_id", "t", "k", "n", *_PRINT])


def _prints(columns) -> np.ndarray:
    return np.stack([x.to_numpy(zero_copy_only=False) for x in columns], axis=1).view(np.uint64)


def _shard_batches(bits: int, draws: int, batches):
    for batch in batches:
        keys = shards(_prints([batch.column(batch.schema.get_field_index(x)) for x in _PRINT]), bits, draws)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * draws), pa.array(keys.ravel()))
        yield pa.record_batch([*batch.columns, lists], names=[*batch.schema.names, "shards"])


def _shard_links(batches):
    """Takes rows (deal, k, n, words of the fingerprint) sorted by deal."""
    found, size = [], 0

    def batch():
        return pa.record_batch([pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1)], names=["a", "b"])

    table, columns = None, ()
    for lo, hi, now in grouped(batches):
        if hi - lo < 2:
            continue
        if now is not table:
            table, columns = now, (now.column("k").to_numpy(), now.column("n").to_numpy(), _prints([now.column(x).combine_chunks() for x in _PRINT]))
        k, n, prints = (x[lo:hi] for x in columns)
        label = np.arange(len(k))
        for a, b, _ in _tree(prints).within(_radius(n)):
            far = (label[a] != label[b]) & (np.minimum(n[a], n[b]) * NEAR[1] >= np.maximum(n[a], n[b]) * NEAR[0])
            if far.any():
                label = components(len(k), a[far], b[far], label)
        linked = np.flatnonzero(label != np.arange(len(k)))
        if len(linked):
            found.append((k[linked], k[label[linked]]))
            size += len(linked)
        if size > 1 << 16:
            yield batch()
            found, size = [], 0
    if found:
        yield batch()


def candidates(nodes: DataFrame, shard: int = SHARD, most: int = TREE) -> DataFrame:
    """node, root: components of fingerprints (k, n and its words) under links within the radius, of two nodes or more."""
    some = nodes.where(F.col("n") >= LEAST).select("k", "n", *_PRINT)
    schema = f"k long, n long, {', '.join(f'{x} long' for x in _PRINT)}, shards array<long>"
    keyed = cut(some.mapInArrow(tidy(partial(_shard_batches, *layout(some.count(), shard))), schema))
    rows = keyed.select(F.explode("shards").alias("shard"), "k", "n", *_PRINT)
    heavy = dealt(rows, "shard", "k", most).select("deal", "k", "n", *_PRINT)
    links = cut(heavy.repartition("deal").sortWithinPartitions("deal").mapInArrow(tidy(_shard_links), "a long, b long"))
    roots = cut(connected(links))
    return roots.union(roots.select("root", "root").distinct())


def _set_batches(batches):
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 20):
            h, bounds = _sets(texts(piece))
            yield pa.record_batch([pa.array(_keys(h, bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))], names=["k", "s"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _sized(n: str, m: str):
    """Sets of n and m shingles can be as similar as NEAR at all."""
    return F.least(n, m) * NEAR[1] >= F.greatest(n, m) * NEAR[0]


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """k, s: the sets of these nodes (columns k and least), from the whole texts of one document of each."""
    wanted = cut(nodes.select("k", "least").distinct())
    texts_ = _rows(docs).join(small_side(wanted.select(F.col("least").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = texts_.select("text").mapInArrow(tidy(_set_batches), "k long, s array<long>")
    return cut(sets.join(small_side(wanted.select("k")), "k", "left_semi").dropDuplicates(["k"]))


def near_pairs(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are as similar as NEAR."""
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(nodes, "k"))
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * sum(NEAR) >= (F.size("x") + F.size("y")) * NEAR[0]).select("a", "b")


def _vectors(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characteristic vectors over the shingles that several of the sets have, as rows of packed bits; and how many others each set has."""
    of = np.repeat(np.arange(len(n)), n)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count > 1
    number = np.cumsum(several) - 1
    shared = several[column]
    of_, at = of[shared], number[column[shared]]
    width = int(several.sum())
    bits = np.zeros((len(n), -(-max(width, 1) // 64) * 8), np.uint8)
    by = np.argsort(at, kind="stable")
    of_, at = of_[by], at[by]
    for lo in range(0, width, 1 << 16):
        a, b = np.searchsorted(at, [lo, lo + (1 << 16)])
        part = np.zeros((len(n), min(width - lo, 1 << 16)), bool)
        part[of_[a:b], at[a:b] - lo] = True
        packed = np.packbits(part, axis=1)
        bits[:, lo // 8 : lo // 8 + packed.shape[1]] = packed
    return bits.view(np.uint64), np.bincount(of[~shared], minlength=len(n))


def set_links(k: np.ndarray, root: np.ndarray, values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the nodes k into components of near sets, going on from the components that root tells: what lies within the
    radius of a fingerprint is held against its set."""
    bits, alone = _vectors(values, n)
    prints = fingerprints(values.view(np.uint64), np.concatenate([[0], np.cumsum(n)]))
    step = max(64, (1 << 22) // bits.shape[1])
    _, first, label = np.unique(root, return_index=True, return_inverse=True)
    label = known = first[label]
    for a, b, _ in _tree(prints).within(_radius(n)):
        for lo in range(0, len(a), step):
            x, y = a[lo : lo + step], b[lo : lo + step]
            far = label[x] != label[y]
            x, y = x[far], y[far]
            # as similar as NEAR: common shingles, (sizes - distance) / 2, against the rest
            d = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) + alone[x] + alone[y]
            near = d * sum(NEAR) <= (n[x] + n[y]) * (sum(NEAR) - 2 * NEAR[0])
            if near.any():
                label = components(len(k), x[near], y[near], label)
    linked = np.flatnonzero(label != known)
    return k[linked], k[label[linked]]


def _part_links(batches):
    """Takes rows (deal, k, root, s) sorted by deal."""
    for a, b, table in grouped(batches):
        own = table.slice(a, b - a)
        s = own.column("s").combine_chunks()
        root = own.column("root").to_numpy()
        if b - a > 1 and (root != root[0]).any():
            found = set_links(own.column("k").to_numpy(), root, s.flatten().to_numpy(), s.value_lengths().to_numpy().astype(np.int64))
            yield pa.record_batch(list(map(pa.array, found)), names=["a", "b"])


def near_copies(docs: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, k: row and node of each document), (node, root of nodes that have near copies)."""
    prints = ", ".join(f"{x} long" for x in _PRINT)
    sketch = cut(_rows(docs).mapInArrow(tidy(_sketch_batches), f"doc_id long, t long, k long, n long, {prints}"))
    nodes = cut(sketch.groupBy("k").agg(F.min("doc_id").alias("least"), F.first(F.struct("n", *_PRINT)).alias("p")).select("k", "least", "p.*"))
    left = cut(candidates(nodes).select(F.col("node").alias("k"), F.col("root").alias("c")).join(nodes.select("k", "n"), "k"))
    heads = left.groupBy("c").agg(*[F.min_by(F.struct("k", "n"), F.xxhash64("k", F.lit(i))).alias(f"h{i}") for i in range(HEADS)])
    heads = cut(heads.select("c", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(HEADS)]))).alias("h")))
    met = left.join(small_side(heads), "c").where("k != h.k").where(_sized("n", "h.n"))
    links = cut(near_pairs(docs, cut(met.select(F.least("k", "h.k").alias("a"), F.greatest("k", "h.k").alias("b")).distinct()), nodes))
    roots = cut(connected(links))
    left = left.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    parted = left.groupBy("c").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("c")
    left = cut(left.join(small_side(cut(parted)), "c"))
    weight = F.greatest(F.lit(1), F.ceil(F.col("n") / SHINGLES))
    deals = dealt(left, "c", "k", part, weight).select("deal", "k", "root")
    rows = deals.join(_sets_of(docs, left.select("k").distinct().join(nodes, "k")), "k").select("deal", "k", "root", "s")
    more = rows.repartition("deal").sortWithinPartitions("deal").mapInArrow(tidy(_part_links), "a long, b long")
    return sketch.select("doc_id", "t", "k"), cut(connected(cut(links.union(more))))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, of each component of near copies only one: that of the least doc_id.

    Rows are told apart by doc_id and text; what goes is taken out by an anti-join, and only rows that are equal in both are
    shuffled to keep one of them.
    """
    key, print_ = fresh(docs, "key", "print")
    rows, roots = near_copies(docs)
    of = rows.join(roots.withColumnRenamed("node", "k"), "k", "left").groupBy(F.coalesce("root", "k").alias("c"))
    kept = cut(of.agg(F.min(F.struct("doc_id", "t")).alias("r")).select("r.*"))
    gone = cut(rows.select("doc_id", "t").distinct().join(kept, ["doc_id", "t"], "left_anti"))
    twins = cut(rows.groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t").join(kept, ["doc_id", "t"], "left_semi"))
    given = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), print_: F.xxhash64(F.col("text").cast("string"))})

    def named(keys):
        return small_side(keys.select(F.col("doc_id").alias(key), F.col("t").alias(print_)))

    left = given.join(named(gone), [key, print_], "left_anti")
    if twins.head(1):
        again = left.join(named(twins), [key, print_], "left_semi").dropDuplicates([key, print_])
        left = left.join(named(twins), [key, print_], "left_anti").unionByName(again)
    return few_files(left.select(*quoted(docs.columns)))
