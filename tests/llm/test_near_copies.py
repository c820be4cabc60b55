import random

import numpy as np
import pytest

import corpus_pipeline
from factmill.llm import common, near_copies


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def corpus():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(2000)] + ["É", "ß"]
    rows = []
    for _ in range(40):
        base = [r.choice(vocab) for _ in range(r.randint(3, 300))]
        for _ in range(r.choice([1, 2, 3])):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 6, 12])):  # changed words: some copies within 0.8, some beyond
                own[r.randrange(len(own))] = r.choice(vocab)
            rows.append(" ".join(own).replace("w1", "W1\t") + r.choice(["", " ", "\n"]))
    base = [r.choice(vocab) for _ in range(200)]
    for _ in range(60):  # one large group; a member is near to some of the others only
        own = list(base)
        for _ in range(2):
            own[r.randrange(len(own))] = r.choice(vocab)
        rows.append(" ".join(own))
    r.shuffle(rows)
    return [(i * 3 - 20, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One")]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")


def test_stage_on_planted_copies(spark, tmp_path):
    """Three changed words of 200 lie beyond three bits of the fingerprint and within 0.8."""
    rows = corpus()
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key"]
    want = kept(rows)
    assert sorted(r.doc_id for r in got.collect()) == want
    assert 30 < len(want) < len(rows) - 60  # the group and some pairs went


def test_edges_of_similarity(spark):
    words = [f"v{i}" for i in range(44)]  # 40 shingles: ten more give 40 of 50, eleven 40 of 51
    rows = [(1, " ".join(words)), (2, " ".join(words + [f"x{i}" for i in range(10)])), (3, " ".join(words + [f"y{i}" for i in range(11)]))]
    assert [r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [1, 3]


def test_odd_rows(spark):
    rows = [(5, "one two"), (5, "one two"), (5, "three"), (None, "one two"), (None, "four"), (None, None), (7, "")]
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("5", "one two"), ("5", "three"), ("7", ""), ("None", "four")]
    assert near_copies.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("part", [4, 16, 256])
def test_groups_dealt_out_in_parts(spark, part):
    """Copies of one text, each near to some of the others only: components as by all pairs, though a band's members stand in many parts."""
    r = random.Random(part)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(r.choice([1, 2, 3, 5, 9])):
            own[r.randrange(150)] = f"x{r.randrange(3000)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids, roots = near_copies.near_copies(docs, part)
    of = ids.join(roots.withColumnRenamed("node", "k"), "k", "left").selectExpr("doc_id", "coalesce(root, k) c").collect()
    least = {c: min(x.doc_id for x in of if x.c == c) for c in {x.c for x in of}}
    assert sorted(least.values()) == kept(rows)


def test_set_links_against_all_pairs():
    r = random.Random(6)
    sets = []
    for _ in range(30):
        base = {r.randrange(1 << 40) for _ in range(r.randint(1, 90))}
        sets += [{x for x in base if r.random() > 0.1} | {r.randrange(1 << 40) for _ in range(r.randint(0, 6))} or {1} for _ in range(4)]
    n = np.array([len(x) for x in sets])
    k = np.arange(1000, 1000 + len(sets))
    a, b = near_copies.set_links(k, k.copy(), np.array([x for s in sets for x in s]), n)
    got = near_copies.components(len(k), a - 1000, b - 1000)
    pairs = [(i, j) for i in range(len(k)) for j in range(i) if similar(sets[i], sets[j])]
    want = near_copies.components(len(k), *np.array(pairs).T)
    assert got.tolist() == want.tolist() and len(set(want.tolist())) < len(k)


def test_fingerprints_against_a_plain_count():
    """A bit is 1 if over half of a set's hashes have it; sets of one shingle, of hundreds beyond a counter's 255, of an even number, and none."""
    r = np.random.default_rng(3)
    sizes = [1, 0, 2, 3, 700, 0, 254, 255, 256, 4, 40000, 1]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    h = r.integers(0, 1 << 64, bounds[-1], np.uint64)
    got = near_copies.fingerprints(h, bounds)
    assert got.shape == (len(sizes), near_copies.BITS // 64)
    for i in (i for i, n in enumerate(sizes) if n):
        votes = np.zeros(near_copies.BITS, int)
        for j, seed in enumerate(near_copies._SEEDS):
            x = (h[bounds[i] : bounds[i + 1]] ^ seed) * near_copies._M
            x = (x ^ (x >> np.uint64(32))) * near_copies._M
            x ^= x >> np.uint64(29)
            votes[64 * j : 64 * j + 64] = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=int)
        want = (2 * votes > sizes[i]) | ((2 * votes == sizes[i]) & (near_copies._TIES == 1))
        assert (np.unpackbits(got[i].view(np.uint8)).astype(bool) == want).all()


def test_candidates_come_from_fingerprints(spark):
    """Over many shards, and with shards that are dealt out, every pair of sets at 0.8 or more is in one component of fingerprints, and unlike ones are not."""
    r = random.Random(8)
    sets, base = [], []
    for i in range(300):
        own = [r.randrange(1 << 62) for _ in range(r.choice([4, 8, 40, 90, 400]))]
        for _ in range(3):
            n = r.randint(0, len(own) // 9)  # so many of each are changed: 0.8 or more between any two, or a little less
            sets.append(own[: len(own) - n] + [r.randrange(1 << 62) for _ in range(n)])
            base.append(i)
    n = np.array([len(x) for x in sets])
    f = near_copies.fingerprints(np.array([x for s in sets for x in s], np.uint64), np.concatenate([[0], np.cumsum(n)])).view(np.int64).tolist()
    nodes = spark.createDataFrame([(i, int(n[i]), *f[i]) for i in range(len(sets))], f"k long, n long, {', '.join(f'{x} long' for x in near_copies._PRINT)}")
    assert near_copies.layout(len(sets), 16)[0] == 6
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if base[i] == base[j] and similar(set(sets[i]), set(sets[j]))]
    assert len(pairs) > 500
    for most in (10, 4096):
        root = {x.node: x.root for x in near_copies.candidates(nodes, 16, most).collect()}
        assert all(root[i] == root[j] for i, j in pairs)
        assert all(base[i] == base[j] for i, j in root.items())


def test_share_of_pairs_that_may_be_missed():
    for n in (0, 1, 128, 129, 10_000, 200_000, 10_000_000):
        bits, draws = near_copies.layout(n)
        assert near_copies.missed(bits, draws) <= near_copies.MISSED and n <= near_copies.SHARD << bits


def test_files_do_not_grow_with_the_input(spark, tmp_path):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id % 400) AS text").repartition(300, "doc_id")
    near_copies.one_of_each(docs).write.parquet(f"{tmp_path}/kept")
    assert 0 < len(list((tmp_path / "kept").glob("part-*"))) <= common.WAVES * spark.sparkContext.defaultParallelism < 250
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == list(range(400))
