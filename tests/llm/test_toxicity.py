import math
import random
import zlib

import numpy as np

from factmill.llm import toxicity as t


def rows(n=500):
    r = random.Random(1)
    vocab = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        toxic = int(r.random() < 0.25)
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["Vilest", "grimscum", "HATEFUL"]))
        out.append((i, " ".join(w), toxic))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    docs = spark.createDataFrame([(k, x, 3.0) for k, x, _ in data] + [(None, "vilest", 1.0), (9001, None, 0.0), (9002, "", 0.0), (9003, "gentle " * 30000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in data] + [(None, 1), (3, None), (4, 7), (123456, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in t.op1_toxicity(docs, labels).collect()}
    assert len(got) == len(data) + 4
    truth = {k: y for k, _, y in data}
    for k, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0)
    held = [k for k in truth if got[k].held_out]
    assert np.mean([got[k].predicted == truth[k] for k in held]) > 0.97
    # held-out labels and other columns are no input
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in t.op1_toxicity(docs.withColumnRenamed("score", "lang"), flipped).collect()}
    assert all(abs(again[k] - got[k].score) < 1e-9 for k in got)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in t.op1_toxicity(docs, none).collect()} <= {0, 1}
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in t.op1_toxicity(docs, one).collect()} == {0}
    assert t.op1_toxicity(docs.limit(0), one).count() == 0


def test_bounded_sample(spark):
    data = rows(300)
    docs = spark.createDataFrame([(k, x) for k, x, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, toxic int")
    picked, counts = t.training_rows(docs, labels, 20)
    assert picked.count() == 40 and counts[0] > 20


def plain_bucket(gram):
    h = 0
    for c in gram:
        h = (h + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
    return h * 0x9E3779B97F4A7C15 % 2**64 >> 46


def plain_grams(text):
    """Every n-gram, one at a time."""
    s = " " + " ".join((text or "").lower().split()) + " "
    return {plain_bucket(s[i : i + n]) for n in range(t.MIN_N, t.MAX_N + 1) for i in range(len(s) - n + 1)} if text else set()


def test_buckets_against_plain_grams():
    for text in ["", "a", "ab", "A  b\tc\n", "été 数字 x" * 5, "vilest grimscum", " "]:
        assert set(t.buckets(text).tolist()) == (plain_grams(text) if text else set())


def test_model_against_brute_force(spark):
    """Counts, log-count ratios and chosen features as a plain loop has them; the fitted weights minimise the penalised loss; scores are sums over n-grams."""
    data = rows(160)
    docs = spark.createDataFrame([(k, x) for k, x, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    learnt = [(plain_grams(x), y) for k, x, y in data if zlib.crc32(str(k).encode()) % 5]
    n = [sum(y == c for _, y in learnt) for c in (0, 1)]
    count = [{}, {}]
    for grams, y in learnt:
        for b in grams:
            count[y][b] = count[y].get(b, 0) + 1
    total = [sum(count[c].values()) for c in (0, 1)]
    ratio = {b: math.log((count[1].get(b, 0) + t.SMOOTHING) / (total[1] + t.SMOOTHING * t.BUCKETS)) - math.log((count[0].get(b, 0) + t.SMOOTHING) / (total[0] + t.SMOOTHING * t.BUCKETS)) for b in {*count[0], *count[1]}}

    def statistic(b):
        out = 0.0
        for present in (True, False):
            seen = [count[c].get(b, 0) if present else n[c] - count[c].get(b, 0) for c in (0, 1)]
            for c in (0, 1):
                if seen[c]:
                    out += 2 * seen[c] * math.log(seen[c] / (n[c] * sum(seen) / sum(n)))
        return out

    g = {b: statistic(b) for b in ratio}
    chosen = {b for b in g if g[b] > t.LEAST + 1e-9}
    assert len(chosen) < t.FEATURES and {*np.flatnonzero(model.weights).tolist()} <= {b for b in g if g[b] > t.LEAST - 1e-9}
    # the gradient of the weighted, penalised loss nearly vanishes at the weights, in units of the scaled features
    class_weight = [math.sqrt(n[c]) / n[c] for c in (0, 1)]
    norm = sum(class_weight[c] * n[c] for c in (0, 1))
    slope, at_start = dict.fromkeys(chosen, 0.0), dict.fromkeys(chosen, 0.0)
    for grams, y in learnt:
        p = 1 / (1 + math.exp(-(model.intercept + sum(float(model.weights[b]) for b in grams))))
        for b in grams & chosen:
            slope[b] += class_weight[y] / norm * (p - y) * ratio[b]
            at_start[b] += class_weight[y] / norm * (0.5 - y) * ratio[b]
    for b in chosen:
        slope[b] += t.PENALTY * float(model.weights[b]) / ratio[b]
    assert max(map(abs, slope.values())) < 0.02 * max(map(abs, at_start.values()))
    for _, text, _ in data[:20]:
        z = model.intercept + sum(float(model.weights[b]) for b in plain_grams(text))
        assert abs(model.score([text])[0] - 1 / (1 + math.exp(-z))) < 1e-6
