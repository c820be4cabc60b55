import random
import re

import numpy as np
import pytest
import xxhash

from factmill.llm import simhash


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted(((rows[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(rows))), key=str)


def corpus():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß", "A\x0bB"]
    rows = []
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.randint(1, 400))]
        for _ in range(r.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(vocab)
            rows.append(" ".join(own).replace("w1", "W1\t") + r.choice(["", " ", "\n"]))
    r.shuffle(rows)
    rows = [(i * 3 - 20, t) for i, t in enumerate(rows)]
    return rows + [(900, None), (901, ""), (-900, " \n\t"), (5, "one"), (5, "One"), (None, "two words"), (None, None), (None, rows[0][1]), (7777, "x y z " * 40000)]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((tuple(r) for r in simhash.op7_simhash(docs).collect()), key=str)
    want = plain_components(rows)
    assert got == want
    assert len({r[2] for r in want}) < len(want) - 5


def test_empty_table(spark):
    assert simhash.op7_simhash(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("bits", [6, 12, 64])
def test_tree_finds_all_pairs(bits):
    r = np.random.default_rng(bits)
    prints = np.unique(r.integers(0, 1 << min(bits, 63), 700).astype(np.uint64))
    prints = np.unique(np.concatenate([prints, prints[:50] ^ np.uint64(5), prints[:50] ^ np.uint64(1 << 3)]))
    found = [np.stack(x[:2], 1) for x in simhash.BKTree.of_prints(prints).within(3)]
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    assert sorted(map(tuple, np.concatenate(found).tolist())) == sorted(zip(*np.nonzero(near), strict=True))


def test_components_of_a_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 999)], "a long, b long")
    got = {r.node: r.root for r in simhash.connected(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1000: 999}


@pytest.mark.parametrize("n,shard,most", [(0, 4, 8), (700, 1024, 4096), (700, 16, 4096), (700, 1, 8), (700, 64, 20)])
def test_links_join_all_near_pairs(spark, n, shard, most):
    """Short and long keys, and shards that are dealt out in parts."""
    r = np.random.default_rng(n)
    prints = r.integers(0, 1 << 63, n).astype(np.uint64)
    some = prints[:120]
    for _ in range(3):
        some = some ^ (np.uint64(1) << r.integers(0, 64, len(some)).astype(np.uint64))
        prints = np.unique(np.concatenate([prints, some]))
    rows = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = simhash.near_links(rows, shard=shard, most=most).collect()
    at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    a, b = ([at[x[i]] for x in links] for i in (0, 1))
    got = simhash.components(len(prints), np.array(a, int), np.array(b, int))
    want = simhash.components(len(prints), *np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 3)) if n else got
    assert got.tolist() == want.tolist()


def test_layout_leaves_blocks_equal():
    for n in (0, 1, 1024, 1025, 10**5, 10**7, 10**9, 10**11, 10**13):
        blocks, agreed, bits = simhash.layout(n)
        assert blocks - agreed == simhash.RADIUS and bits <= 64 // blocks and n >> bits * agreed <= 2 * simhash.SHARD


def test_tree_prunes():
    """From 1,000 fingerprints on a lookup meets a part of the nodes only."""
    prints = np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64)
    seen = 0

    def distance(a, b):
        nonlocal seen
        seen += len(a)
        return np.bitwise_count(prints[a] ^ prints[b])

    tree = simhash.BKTree(len(prints), distance)
    seen = 0
    assert sum(len(q) for q, _, _ in tree.within(3)) >= 4000
    assert seen < 0.5 * 4000**2
