import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_line_dedup, test_simhash, test_tokens

LINES = test_line_dedup.d


def corpus(tmp_path, spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, line(20)) for i in range(6)]
    shared = [line(15) for _ in range(4)]
    rows, labels = [], []
    for i in range(260):
        lines = [line(r.randint(5, 40)) for _ in range(r.randint(1, 5))]
        if i % 7 == 0:
            lines.insert(0, r.choice(shared))
        toxic = int(i % 5 == 1)
        if toxic:
            lines[-1] += " vilest grimscum hateful"
        if i % 11 == 0:
            lines.append(items[i % 6][1])
        rows.append((i, "\n".join(lines)))
        labels.append((i, 1, toxic))
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(1100 + i, rows[i][1].replace(" ", "  ", 1) + "\nand " + line(4)) for i in range(10)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "ok")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, {k: y for k, _, y in labels}, items


def plain_lines(rows):
    seen, out = [], []
    for k, t in sorted(rows):
        kept, lost = [], False
        for i, x in enumerate(t.split("\n") if t else ()):
            w = x.encode().split()
            if len(w) >= LINES.MIN_WORDS:
                near = any(w == v or (min(len(w), len(v)) >= LINES.NEAR_WORDS and abs(len(w) - len(v)) <= 1 and test_line_dedup.distance(w, v) <= 1) for v in seen if abs(len(v) - len(w)) <= 1 and (w[0] == v[0] or w[-1] == v[-1]))
                seen.append(w)
                if near:
                    lost = True
                    continue
            kept.append(x)
        t = "\n".join(kept) if t else t
        if not lost or (t or "").split():
            out.append((k, t))
    return out


def test_run_against_plain_stages(spark, tmp_path):
    rows, toxic, items = corpus(tmp_path, spark)
    at = str(tmp_path)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.dtypes
    kept = corpus_pipeline.drop_toxic(spark, docs, at)
    assert kept.dtypes == columns
    ids = {r.doc_id for r in kept.collect()}
    held = [k for k in toxic if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(k not in ids) == bool(toxic[k]) for k in held]) > 0.9
    rows = [r for r in rows if r[0] in ids]
    rows = plain_lines(rows)
    part = test_simhash.plain_components(rows)
    text = dict(rows)
    rows = [(k, text[k]) for k, _, root in part if k == root]
    verdict = {r[0]: r[-1] for r in test_decontaminate.plain(rows, items)}
    rows = sorted((k, t) for k, t in rows if not verdict[k])
    assert any(verdict.values()) and len(rows) < len(text) < len(ids)
    want, n = [], 0
    for k, t in rows:
        own, i = test_tokens.library_ids(t) + [1], 0
        while i < len(own):
            cut = own[i : i + 2048 - n % 2048]
            want.append((k, i, len(cut), test_tokens.crc(cut), len(own), n // 2048, n % 2048))
            i, n = i + len(cut), n + len(cut)
    got = corpus_pipeline.run(spark, at)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[1:]])
def test_stages_on_odd_rows(spark, tmp_path, stage):
    spark.createDataFrame([(1, "a b c"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, "one two three four", None, "a", 1), (5, "one two three four", None, "a", 1), (None, "p q r", "x", None, 5), (None, None, None, None, None), (6, "", "e", "s", 0), (7, "x a B c y", "e", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = stage(spark, docs, str(tmp_path))
    assert found.count() >= 3
    if stage is not corpus_pipeline.pack:
        assert found.dtypes == docs.dtypes
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


NAMES = ["n_lines", "removed_lines", "Score", "Print", "KEY", "a.b", "row", "carried", "Chunk", "label", "k`q", "_key", "deal"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_hand_clashing_columns_through(spark, tmp_path, name, stage):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(6, 40))) + (" vilest grimscum" if i % 3 == 0 else "")) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, None), (201, "")]
    spark.createDataFrame([(1, rows[1][1]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], schema)
    wide = spark.createDataFrame([(k, t, "en", "s", len(t or ""), *[f"{n} {k}" for n in NAMES]) for k, t in rows], schema + "".join(", `" + n.replace("`", "``") + "` string" for n in NAMES))
    want, got = stage(spark, plain, str(tmp_path)), stage(spark, wide, str(tmp_path))
    assert sorted(map(str, (tuple(x)[:5] for x in got.collect()))) == sorted(map(str, (tuple(x)[:5] for x in want.collect())))
    if name != "packing":
        assert got.dtypes == wide.dtypes
        for x in got.collect():
            assert [v for v in tuple(x)[5:]] == [f"{n} {x.doc_id}" for n in NAMES]
