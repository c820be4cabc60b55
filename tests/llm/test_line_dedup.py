import hashlib
import random

import duckdb
import pandas as pd
import pytest

from factmill.llm import line_dedup as d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(rows, min_words=d.MIN_WORDS, near_words=d.NEAR_WORDS):
    inf = float("inf")
    lines = [(inf if k is None else k, i, x.encode().split()) for k, t in rows if t for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= min_words]
    out = []
    for k, t in rows:
        kept, n = [], 0
        for i, x in enumerate(t.split("\n") if t else ()):
            w = x.encode().split()
            here = (inf if k is None else k, i)
            near = lambda v: w == v or (min(len(w), len(v)) >= near_words and abs(len(w) - len(v)) <= 1 and distance(w, v) <= 1)  # noqa: B023, E731
            if len(w) >= min_words and any((a, b) < here and near(v) for a, b, v in lines):
                n += 1
            else:
                kept.append(x)
        out.append((k, t.count("\n") + 1 if t else 0, n, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1, null=True):
    r = random.Random(seed)
    vocab = ["a", "be", "cé", "d.", "e,", "x", "数"] + [f"w{i}" for i in range(6)]
    pool = [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 9, 10, 11, 12, 30]))] for _ in range(25)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(r.randint(0, 7)):
            w = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(w) + 1)
                w[k : k + r.choice([0, 1])] = [r.choice(vocab)] * r.choice([0, 1])
            lines.append(r.choice([" ", " ", "  \t"]).join(w) + r.choice(["", " "]))
        rows.append((r.randint(0, 500) if i % 9 else i // 9, "\n".join(lines)))
    rows = list(dict(rows).items())
    rows += [(900, "x y x y x y x y x y"), (901, "x x y x y x y x y x y"), (902, "y x y x y x y x y x"), (903, ""), (904, None), (905, "w " * 5000)]
    return rows + ([rows[3], (None, rows[2][1]), (None, "left alone here")] if null else [])


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 300])
def test_against_all_pairs(spark, chunk_bytes):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 7, "b") for k, t in rows], "doc_id long, text string, chunk int, bucket string")
    found = d.dedup_lines(docs, chunk_bytes).collect()
    got = sorted(((r.doc_id, r.n_lines, len(r.removed_lines), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in found), key=str)
    assert got == plain(rows)
    assert {(r.chunk, r.bucket) for r in found} == {(7, "b")} and sum(r[2] for r in got) > 40
    assert [r.text for r in found if r.doc_id == 904] == [None]


def test_query_and_sql(spark):
    rows = corpus(2, null=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in d.op5_line_dedup(docs).collect()), key=str)
    assert got == plain(rows)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert sorted(con.execute(d.ORACLE_SQL).fetchall(), key=str) == got
    assert d.op5_line_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        d.dedup_lines(docs.selectExpr("*", "1 as n_lines"))


@pytest.mark.parametrize("least", [(3, 2), (1, 2), (2, 5)])
def test_other_least_numbers_of_words(spark, least):
    rows = corpus(4)
    found = d.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 600, min_words=least[0], near_words=least[1]).collect()
    got = sorted(((r.doc_id, r.n_lines, len(r.removed_lines), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in found), key=str)
    assert got == plain(rows, *least)
