import math
import re
from collections import Counter

import pytest

from factmill.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [
    (1, "The cat sat on the mat. " * 30),
    (2, " ".join(f"word{i}" for i in range(80)) + ".\nNext line here.\nAnother one there."),
    (3, None),
    (4, ""),
    (5, "## a | b ** c\n" * 20),
    (5, "same line of words\nsame line of words\n\n \nother\tline"),
    (6, "a b c a b c x a b c"),
    (7, "x x x x"),
    (8, "été  nbsp\x85 ÉTÉ ABC DEF"),
    (None, " ".join("SHOUT!!" if i % 7 else f"W{i}!!" for i in range(200))),
    (9, " ".join(f"w{i % 997}" for i in range(20000))),
    *[(100 + i, " ".join(f"nice{i}n{j}" for j in range(60 + i)) + ".\nSecond line.") for i in range(20)],
]


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(k, t, 1, False) for k, t in rows], "doc_id long, text string, n_words int, kept boolean")


def test_counts(spark):
    got = sorted((tuple(r) for r in q.op9_quality_rules(frame(spark)).collect()), key=str)
    want = []
    for k, t in TEXTS:
        s = plain(t)
        want.append((k, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert sorted((r[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r[6] and r[7] for r in got)
    kept = {r[0] for r in got if r[7]}
    assert {2, *range(100, 120)} <= kept and 5 not in kept and None not in kept


def votes_frame(spark, rows):
    """rows: (rule that votes: its vote, number of documents); rules not named vote as their key "rest" says, or good."""
    out = []
    for given, n in rows:
        out += [[given.get(r.name, given.get("rest", 1)) for r in q.RULES]] * n
    return spark.createDataFrame(out, ", ".join(f"v_{r.name} int" for r in q.RULES))


def plain_em(rows, prior, on_good, on_bad):
    acc = [(on_good, on_bad)] * len(q.RULES)
    for _ in range(q.ROUNDS):
        p = []
        for r in rows:
            z = math.log(prior / (1 - prior))
            for v, (g, b) in zip(r, acc, strict=True):
                z += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0
            p.append(1 / (1 + math.exp(-z)))
        new = []
        for j in range(len(q.RULES)):
            s = {(v, y): sum((x if y else 1 - x) for r, x in zip(rows, p, strict=True) if r[j] == v) for v in (1, -1) for y in (0, 1)}
            (a, b), (e, f) = q.GOOD_VOTES, q.BAD_VOTES
            new.append(((s[1, 1] + a) / (s[1, 1] + s[-1, 1] + a + b), (s[-1, 0] + e) / (s[-1, 0] + s[1, 0] + e + f)))
        acc, prior = new, (sum(p) + q.SEEN[0]) / (len(p) + sum(q.SEEN))
    return prior, acc


def test_em_against_plain(spark):
    voted = q.votes(q.document_statistics(frame(spark))).cache()
    rows = [[r[f"v_{n.name}"] for n in q.RULES] for r in voted.collect()]
    for start in [(q.PRIOR, q.ON_GOOD, q.ON_BAD), (0.6, 0.8, 0.5)]:
        got = q.estimate(voted, start=start)
        prior, acc = plain_em(rows, *start)
        assert got["prior"] == pytest.approx(prior, rel=1e-6)
        for r, a in zip(q.RULES, acc, strict=True):
            assert got[r.name] == pytest.approx(a, rel=1e-6)


SYMBOLS = {"symbols": -1, "symbol_share": -1, "symbol_runs": -1}
CORPUS = [({}, 4000), (SYMBOLS, 150), (SYMBOLS | {"letters": -1}, 150), ({"repeated_lines": -1}, 90), ({"symbols": -1, "symbol_share": -1, "letters": 0}, 30), ({"repeated_words": -1, "rest": 1}, 120)]


def test_rules_are_weighed(spark):
    """A lone vote of a rule that errs often is outvoted; rules that agree are not, though as many documents have the lone vote."""
    model = q.estimate(votes_frame(spark, CORPUS))
    assert model["repeated_lines"][1] < 0.3 < 0.9 < model["symbols"][1]
    cases = [{}, {"repeated_lines": -1}, {"repeated_words": -1}, {"repeated_words": -1, "repeated_lines": -1}, SYMBOLS, {"symbols": -1, "symbol_share": -1}]
    got = votes_frame(spark, [(x, 1) for x in cases]).withColumn("p", q.posterior(model))
    by = {tuple(r)[:-1]: r.p for r in got.collect()}
    p = [by[tuple(x.get(r.name, 1) for r in q.RULES)] for x in cases]
    assert p[0] > 0.99 and p[1] > 0.9 and p[2] > 0.9 and p[4] < 0.01 and p[5] < 0.5
    assert any(x < 0.5 for x in p) and any(x >= 0.5 for x in p[1:])  # no function of "a rule voted bad"


def test_one_fixed_point_from_several_starts(spark):
    voted = votes_frame(spark, CORPUS)
    found = [q.estimate(voted, start=s) for s in [(0.8, 0.9, 0.6), (0.7, 0.999, 0.25), (0.5, 0.7, 0.7), (0.95, 0.95, 0.5)]]
    for other in found[1:]:
        assert other["prior"] == pytest.approx(found[0]["prior"], abs=1e-4)
        for r in q.RULES:
            assert other[r.name] == pytest.approx(found[0][r.name], abs=1e-3)


def test_estimates_are_not_bounded(spark):
    """A rule that votes bad on a third of the good documents gets no accuracy above what it shows."""
    model = q.estimate(votes_frame(spark, [({}, 2000), ({"upper_case": -1}, 1000), (SYMBOLS | {"letters": -1}, 200)]))
    assert model["upper_case"][0] == pytest.approx(2 / 3, abs=0.02)


def test_base_failed_rows_are_not_fitted_on(spark):
    texts = [(i, " ".join(f"nice{i}n{j}" for j in range(60 + i % 9)) + ".\nSecond line.") for i in range(60)]
    texts += [(1000 + i, " ".join(f"w{i}n{j}%%% |" for j in range(70))) for i in range(12)]
    junk = [(2000 + i, "x x x x") for i in range(300)]
    kept = [{r.doc_id for r in q.op9_quality_rules(frame(spark, rows)).collect() if r.kept} for rows in (texts, texts + junk)]
    assert kept[0] == kept[1] == set(range(60))
    assert q.op9_quality_rules(frame(spark, junk[:3])).where("kept").count() == 0


def test_empty(spark):
    assert q.op9_quality_rules(frame(spark).limit(0)).count() == 0
