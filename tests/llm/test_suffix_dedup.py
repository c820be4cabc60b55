import hashlib
import random

import numpy as np
import pytest

from factmill.llm import suffix_dedup as s


def brute(rows, length):
    first = {}
    raw = [(k, (t or "").encode()) for k, t in rows]
    inf = float("inf")
    for k, b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, inf), inf if k is None else k)
    out = []
    for k, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (inf if k is None else k):
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeé nst") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(8, 60)) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [text(r.randint(0, 60))]
        if r.random() < 0.7:
            p = r.choice(passages)
            if r.random() < 0.5:
                k = r.randrange(len(p))
                p = p[:k] + r.choice("xyzé") + p[k + 1 :]
            parts += [p, text(r.randint(0, 20))]
        rows.append((r.randint(-5, 300), "".join(parts)))
    whole = max((t for _, t in rows), key=len)
    rows += [(1000 + i, whole) for i in range(10)] + [(2000, whole[:49]), (2001, whole[:50]), (2002, None), (2003, ""), (None, whole), (None, "only here " * 20)]
    rows += [(3000, "ab" * 200), (3001, "b" + "ab" * 60), (3002, "a" * 300), (3003, "a" * 49), (2999, "a" * 51)]
    return rows + rows[:5]


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 2000])
def test_against_brute_force(spark, chunk_bytes):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, kept string, n_bytes int")
    want = brute(rows, 50)
    spans = s.remove_repeats(docs, chunk_bytes=chunk_bytes).collect()
    got = sorted(((r.doc_id, r.n_bytes, sum(x.stop - x.start for x in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in spans), key=str)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 50


def test_query_and_empty(spark):
    rows = corpus(2)[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in s.op2_suffix_dedup(docs).collect()), key=str) == brute(rows, 50)
    assert s.op2_suffix_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet,shallow", [("ab", 8), ("ab", 24), ("abcdefgh", 16), ("a", 24)])
def test_deep_shallow_order(alphabet, shallow):
    r = random.Random(len(alphabet) + shallow)
    base = "".join(r.choice(alphabet) for _ in range(90))
    text = "".join(base[a:] + r.choice(["", "b"]) for a in (r.randrange(60) for _ in range(80))).encode()
    data = np.frombuffer(text, np.uint8)
    start = np.array(sorted(r.sample(range(len(text) - 50), 1500)))
    order, new = s.deep_shallow_sort(data, start, 50, shallow)
    got = [text[start[i] : start[i] + 50] for i in order]
    assert sorted(order.tolist()) == list(range(len(start)))
    assert got == sorted(got)
    assert new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def test_blind_trie():
    r = random.Random(4)
    values = {r.getrandbits(200) >> r.randrange(200) << r.randrange(8) for _ in range(500)}
    trie = s.BlindTrie()
    for v in [*values, *values]:
        trie.insert(v)
    assert trie.ordered() == sorted(values)
