"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (MIN_N to MAX_N characters, lower case, white space runs as one space, a space at either end) that a
text has, hashed into BUCKETS. fit() takes labelled rows outside the held-out fifth: at most MAX_ROWS of each class,
those with the least hash of doc_id. From them it counts, per bucket and class, the texts that have it; the counts give each
bucket's log-count ratio r. At most FEATURES buckets that tell the classes apart best (greatest likelihood ratio statistic, above LEAST)
are kept, each scaled by its r, and a logistic regression with an L2 penalty is fitted to them by accelerated gradient descent.
Counts come to the driver as one dense pair of vectors for each of TASKS tasks, and the training matrix as one bit for
each row and feature: both have a fixed bound. A class
weighs as the square root of its labelled rows, so a rare class is not drowned.

score() reads each whole text once, in a map without shuffle; its broadcast is one float for each bucket.

Null and empty texts have no n-grams: their score is that of the intercept. A label that is null, neither 0 nor 1, or without
a document is not learnt from; rows with the same doc_id count each. With labels of one class only, or none, every score is the (smoothed)
share of label 1. An empty table gives an empty result. Only doc_id, text and the label are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, pieces, plainly_named, stored, texts, tidy

MIN_N, MAX_N = 3, 5
BUCKETS = 1 << 18
#: Labelled rows of each class that the classifier is fitted on at most.
MAX_ROWS = 4000
FEATURES = 4096
#: Likelihood ratio statistic that a feature needs: chance alone exceeds it in about one of 600 cases.
LEAST = 10.0
TASKS = 8
SMOOTHING, PENALTY, ROUNDS = 1.0, 1e-3, 150
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str, scratch: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text's n-grams."""
    chars = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(chars) < MIN_N or not text:
        return np.zeros(0, np.int64)
    seen = np.zeros(BUCKETS, bool) if scratch is None else scratch
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, MAX_N + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = (h[:m] + chars[n - 1 :]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
        if n >= MIN_N:
            seen[(h * _MULTIPLIER >> np.uint64(46)).astype(np.int64)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@dataclass
class Model:
    weights: np.ndarray  # float32 of BUCKETS; 0 where no feature is
    intercept: float

    def score(self, items: list[str]) -> np.ndarray:
        scratch = np.zeros(BUCKETS, bool)
        z = np.array([float(self.weights[buckets(t, scratch)].sum(dtype=np.float64)) for t in items]) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _count(batches):
    """Per bucket, the texts of either class that have it: one row for each task."""
    n, scratch = np.zeros((2, BUCKETS), np.int32), np.zeros(BUCKETS, bool)
    for batch in batches:
        for text, y in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
            n[y][buckets(text, scratch)] += 1
    yield pa.record_batch([pa.array([n.tobytes()], pa.binary())], names=["counts"])


def _design(chosen: np.ndarray, batches):
    """Per text, a bit for each chosen bucket."""
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    scratch = np.zeros(BUCKETS, bool)
    for batch in batches:
        rows = []
        for text in texts(batch):
            row = np.zeros(len(chosen), np.uint8)
            at = place[buckets(text, scratch)]
            row[at[at >= 0]] = 1
            rows.append(np.packbits(row).tobytes())
        yield pa.record_batch([pa.array(rows, pa.binary()), batch.column(1)], names=["bits", "label"])


def _statistic(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Likelihood ratio statistic of each bucket's presence against the class. k: (2, buckets) counts; n: texts of either class."""
    share = k.sum(0) / n.sum()
    out = np.zeros(k.shape[1])
    for c in (0, 1):
        for x, e in ((k[c], n[c] * share), (n[c] - k[c], n[c] * (1 - share))):
            out += 2 * np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0)
    return out


def _logistic(x: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Minimises the weighted log loss plus the penalty by Nesterov's method; x holds 0/1 bytes, feature j counts as scale[j].

    A constant feature stands for the intercept; the step is 1 / (greatest eigenvalue), found by power iteration.
    """
    rows, blocks = len(x), [slice(i, min(i + 1024, len(x))) for i in range(0, len(x), 1024)]

    def forward(v, b):
        u = (v * scale).astype(np.float32)
        return np.concatenate([x[s].astype(np.float32) @ u for s in blocks]) + b

    def backward(e):
        g = np.zeros(len(scale))
        for s in blocks:
            g += x[s].astype(np.float32).T @ e[s].astype(np.float32)
        return g * scale, e.sum()

    v, b = np.full(len(scale), 1 / np.sqrt(len(scale) + 1)), 1 / np.sqrt(len(scale) + 1)
    top = 1.0
    for _ in range(8):
        g, gb = backward(weight * forward(v, b))
        top = float(np.sqrt((g**2).sum() + gb**2))
        v, b = g / top, gb / top
    step = 1 / (0.3 * top + PENALTY)
    w, c = np.zeros(len(scale)), 0.0
    pw, pc, t = w, c, 1.0
    for _ in range(ROUNDS):
        e = weight * (1 / (1 + np.exp(-np.clip(forward(pw, pc), -60, 60))) - y)
        g, gb = backward(e)
        nw, nc = pw - step * (g + PENALTY * pw), pc - step * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pc = nw + (t - 1) / nt * (nw - w), nc + (t - 1) / nt * (nc - c)
        w, c, t = nw, nc, nt
    del rows
    return w, float(c)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of the rows to fit on, and the number of labelled rows of each class that may be learnt from."""
    y = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    counts = {r.label: r["count"] for r in y.groupBy("label").count().collect()}
    picked = None
    for c in sorted(counts):
        some = y.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        picked = y.limit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(picked), "doc_id").select("text", "label"), counts


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    rows, counts = training_rows(docs, labels, max_rows)
    if len(counts) < 2:
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1) if counts else 0.5
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rows = stored(rows.repartition(TASKS), "toxicity")
    k = np.zeros((2, BUCKETS))
    for r in rows.repartition(TASKS).mapInArrow(tidy(_count), "counts binary").toLocalIterator():
        k += np.frombuffer(r.counts, np.int32).reshape(2, BUCKETS)
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n = np.array([sizes.get(0, 0), sizes.get(1, 0)], float)
    if not n.all():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((n[1] + 0.5) / (n[0] + 0.5))))
    p = (k + SMOOTHING) / (k.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    r = np.log(p[1] / p[0])
    g = _statistic(k, n)
    chosen = np.sort(np.argsort(-g, kind="stable")[:FEATURES])
    chosen = chosen[g[chosen] > LEAST]
    if not len(chosen):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(counts[1] / counts[0])))
    bits, y = [], []
    for row in rows.mapInArrow(tidy(partial(_design, chosen)), "bits binary, label int").toLocalIterator():
        bits.append(np.frombuffer(row.bits, np.uint8))
        y.append(row.label)
    y = np.array(y, float)
    x = np.unpackbits(np.stack(bits), axis=1, count=len(chosen))
    class_weight = np.sqrt([counts[0], counts[1]]) / n
    weight = class_weight[y.astype(int)] / (class_weight * n).sum()
    w, c = _logistic(x, r[chosen], y, weight)
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = w * r[chosen]
    return Model(weights, c)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and, last, `score`: the probability of label 1. Where docs has a column of that name, underscores stand before it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    (column,) = fresh(docs, "score")
    rows = plainly_named(docs)
    at = len(rows.columns)

    def go(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                arrays = [piece.column(i) for i in range(at)] + [pa.array(sent.value.score(texts(piece)))]
                yield pa.record_batch(arrays, names=[*piece.schema.names, column])

    return rows.mapInArrow(tidy(go), StructType([*rows.schema.fields, StructField(column, DoubleType())])).toDF(*docs.columns, column)


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
