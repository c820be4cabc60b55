import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from factmill.llm import decontaminate as d

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, window=13):
    out = []
    for key, text in rows:
        w, hit, who = plain_words(text), set(), set()
        for item, t in items:
            q = plain_words(t)
            for a in range(max(1, len(q) - window + 1) if q else 0):
                p = q[a : a + window]
                for i in range(len(w) - len(p) + 1):
                    if w[i : i + len(p)] == p:
                        hit.update(range(i, i + len(p)))
                        who.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(who), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data():
    r = random.Random(5)
    vocab = ["a", "b", "Ab", "été", "9", "x1", "数字"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([0, 2, 5, 13, 14, 40]))) for i in range(30)] + [(10, text(20)), (None, text(15)), (7, None), (8, "x1"), (11, "solo word")]
    rows = [(i, text(r.randint(0, 200))) for i in range(60)]
    rows += [(100 + i, text(30) + " | " + (t or "").upper() + " " + text(i * 20)) for i, (_, t) in enumerate(items)]
    return [*rows, (3, None), (3, ""), (None, "Solo WORD"), (500, text(3000) + " " + items[20][1])], items


def test_against_brute_force(spark):
    rows, items = data()
    docs = spark.createDataFrame([(k, t, 0, "") for k, t in rows], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, doc_id int")
    want = plain(rows, items)
    assert sorted((tuple(r) for r in d.op3_decontaminate(docs, bench).collect()), key=str) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)

    def digest(found):
        return sorted(((r.doc_id, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in d.contamination(found).collect()), key=str)

    once = digest(d.phrase_matches(docs, bench))
    assert digest(d.phrase_matches(docs, bench, block_bytes=300)) == once
    assert digest(d.index_matches(d.build_index(docs, shard_bytes=500), bench)) == once
    index = d.stored(d.build_index(docs, shard_bytes=2000), "t")
    assert digest(d.index_matches(index, bench, block_bytes=400)) == once
    assert sorted(r.doc_id for r in d.clean_documents(docs, bench).collect() if r.doc_id is not None) == sorted(r[0] for r in want if not r[5] and r[0] is not None)


def test_empty(spark):
    rows, items = data()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.op3_decontaminate(docs.limit(0), bench).count() == 0
    clean = d.op3_decontaminate(docs, bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.contaminated or r.n_items for r in clean)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x fox y quick"), (2, "red fox quick"), (3, "quick red a b c fox"), (4, "red red fox"), (5, "fox quick z red")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "quick red fox")], "item_id string, text string")
    near = lambda slop: {r.doc_id for r in d.proximity_matches(docs, q, slop).collect() if r["items"]}
    assert near(0) == {2} and near(1) == {2, 5} and near(2) == {1, 2, 5} and near(3) == {1, 2, 3, 5}
    assert {r.doc_id for r in d.phrase_matches(docs, q).collect() if r["items"]} == set()


def test_few_candidates_at_once(monkeypatch):
    rows, items = data()
    phrases = d.Phrases.of(items)
    shard = d.Shard.build(range(len(rows)), [k for k, _ in rows], [0] * len(rows), pa.array([t for _, t in rows], pa.string()))
    opened = d.Shard.opened(shard.stored(), 0)

    def pairs():
        return sorted((int(p), int(a)) for x in opened.phrases(phrases) for p, a in zip(*x, strict=True))

    every = pairs()
    flat = np.full(int(shard.positions.max()) + 20, -1)
    for t, w in enumerate(shard.terms.to_pylist()):
        flat[shard.postings(t)] = phrases.terms.get(w, -2)
    want = [(k, a) for k, row in enumerate(phrases.rows) for a in range(len(flat) - 13) if (flat[a : a + phrases.width[k]] == row[: phrases.width[k]]).all()]
    assert every == want
    monkeypatch.setattr(d, "CANDIDATES", 7)
    assert pairs() == every


def test_slop_beyond_the_gap(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        d.proximity_matches(docs, docs.withColumnRenamed("doc_id", "item_id"), d.GAP)


def test_long_text(spark):
    """A text of megabytes with an item's words at its end."""
    text = "word other " * 300000 + "the very last words of all"
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    item = spark.createDataFrame([(7, "The VERY last words, of all")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in d.op3_decontaminate(docs, item).collect()}
    assert got == {1: (600006, 6, False), 2: (1, 0, False)}


def test_words_of_a_column():
    texts = ["A b", None, "", "c", "d-e ", " fé数", "x"]
    found, n = d.split(pa.array(texts, pa.string()))
    assert found.to_pylist() == [w for t in texts for w in d.words(t)] and n.tolist() == [len(d.words(t)) for t in texts]
    sliced, n = d.split(pa.array(["zz", *texts], pa.string()).slice(1))
    assert sliced.to_pylist() == found.to_pylist()
    assert d.split(pa.array([], pa.string()))[0].to_pylist() == []


def test_files_do_not_grow_with_the_input(spark, tmp_path):
    """300 partitions of documents become a bounded number of files, of index and of kept documents, and keep all rows."""
    import glob

    import pyarrow.parquet as pq

    from factmill.llm import common

    docs = spark.range(600).selectExpr("id AS doc_id", "concat('some words of document ', id) AS text").repartition(300, "doc_id")
    item = spark.createDataFrame([(7, "Words of document 17")], "item_id long, text string")
    most = common.WAVES * spark.sparkContext.defaultParallelism
    assert most < 250
    before = set(glob.glob(f"{common.shared_dir(spark)}/factmill-index-*"))
    d.clean_documents(docs, item).write.parquet(f"{tmp_path}/kept")
    (index,) = set(glob.glob(f"{common.shared_dir(spark)}/factmill-index-*")) - before
    for at in (f"{tmp_path}/kept", index):
        assert 0 < len(glob.glob(f"{at}/part-*")) <= most
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [i for i in range(600) if i != 17]
    path = f"{tmp_path}/index"
    common.few_files(d.build_index(docs.coalesce(1), 1 << 10)).write.option("parquet.block.row.count.limit", d.GROUP).parquet(path)
    files = [pq.ParquetFile(x).metadata for x in glob.glob(f"{path}/part-*")]
    assert sum(m.num_rows for m in files) > d.GROUP
    assert all(m.row_group(i).num_rows <= d.GROUP for m in files for i in range(m.num_row_groups))
