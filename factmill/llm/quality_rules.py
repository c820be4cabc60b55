"""Quality by weak supervision: rules vote or abstain, EM weighs them, and a posterior probability decides.

Only DataFrame functions run. document_statistics() computes everything inside a row (no shuffle), votes() turns the
statistics into votes of +1 (good), -1 (bad) or 0 (abstains). Documents that pass the base rules are counted by their votes, at most
3 ** len(RULES) rows whatever the input; EM for a two-coin model (each rule has an accuracy on good documents and one on bad documents, since a rule
knows one kind of fault and passes the others; abstentions carry no evidence) is a fold over that frame's single row of
counts. The result, a prior and two accuracies for each rule, becomes literals of the plan that scores each document.

Several rules look at one kind of fault from different sides, so that their agreement tells EM whom to believe: a rule whose bad votes the
others do not share is taken to err on good documents, and its lone vote is outvoted. What is known beforehand enters as a weak Beta prior on
each accuracy, a few votes against a corpus; no bound holds an estimate. Documents that fail the base rules are not fitted on: they are dropped
anyway, and as the bad class they would make each rule for another fault look wrong.

Null and empty texts have no words: all counts 0, base_failed, not kept. Ties at posterior 0.5 are kept. Copies count as
often as they occur. Very long texts cost n log n in their number of words. Over an empty table nothing is estimated
and the result is empty; where no document passes the base rules, the priors stand. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rounds of EM; where it starts: share of good documents, a rule's accuracy on good and on bad documents.
ROUNDS, PRIOR, ON_GOOD, ON_BAD = 50, 0.8, 0.9, 0.6
#: Beta priors as votes cast beforehand, (right, wrong): of each rule on good and on bad documents; and documents seen, (good, bad).
GOOD_VOTES, BAD_VOTES, SEEN = (9, 1), (5, 5), (8, 2)
_SPACE = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """bad and good: SQL conditions over the statistics, in whole numbers; where neither holds, the rule abstains."""

    name: str
    bad: str
    good: str


c = F.col
RULES = [
    # symbols: per word, among the words' characters, runs of them per word; and what is left for letters
    Rule("symbols", "n_symbols * 10 > n_words", "n_symbols * 100 <= n_words"),
    Rule("symbol_share", "n_symbols * 100 > word_chars * 3", "n_symbols * 200 <= word_chars"),
    Rule("symbol_runs", "n_symbol_runs * 20 > n_words", "n_symbol_runs * 100 <= n_words"),
    Rule("letters", "n_letters * 100 < word_chars * 85", "n_letters * 100 >= word_chars * 93"),
    # repetition: of windows, of lines, of words (distinct ones grow with the root of the length, so no length is exempt)
    Rule("repeated_words", "n_repeat_words * 10 > n_words", "n_repeat_words * 50 <= n_words"),
    Rule("repeated_lines", "n_dup_lines * 5 > n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    Rule("variety", "n_distinct_words * n_distinct_words < n_words * 15", "n_distinct_words * n_distinct_words >= n_words * 25"),
    # form
    Rule("word_length", "word_chars > n_words * 10 OR word_chars * 2 < n_words * 5", "word_chars * 2 <= n_words * 15 AND word_chars * 2 >= n_words * 7"),
    Rule("upper_case", "n_upper * 100 > word_chars * 15", "n_upper * 100 <= word_chars * 12"),
    Rule("line_ends", "n_ended_lines * 2 < n_lines AND n_lines > 4", "n_ended_lines * 10 >= n_lines * 8"),
]


def _repeated(h: Column, n: Column) -> Column:
    """Words that lie in a window whose hash occurs more than once; h holds the windows' hashes in text order.

    (hash, place) pairs are sorted, so equal windows meet; the places that have an equal neighbour are sorted again,
    and each adds the words up to the next place, three at most.
    """
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(pairs)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts of each document; see the rules for their use."""
    t = docs.select("doc_id", F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    t = t.select("doc_id", "text", F.filter(F.split("text", _SPACE), lambda w: w != "").alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)).alias("l"))
    t = t.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
        F.char_length(F.regexp_replace("text", "\\P{L}+", "")).cast("long").alias("n_letters"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.filter("l", lambda x: F.rtrim(x).rlike("[.!?]$"))).cast("long").alias("n_ended_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).alias("h"),
    )
    t = t.withColumn("s", _repeated(c("h"), c("n_words"))).drop("h")
    near = F.filter("s", lambda x, k: (F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"]))
    t = t.withColumn("p", F.sort_array(F.transform(near, lambda x: x["i"]))).drop("s")
    gaps = F.transform("p", lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get("p", k - 1))))
    return t.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("p")


def base_failed() -> Column:
    return (c("n_words") < 50) | (c("n_repeat_words") * 100 > c("n_words") * 50)


def votes(statistics: DataFrame) -> DataFrame:
    """The statistics with a column v_<rule> for each rule: -1, 0 or +1."""
    return statistics.withColumns({f"v_{r.name}": F.when(F.expr(r.bad), F.lit(-1)).when(F.expr(r.good), F.lit(1)).otherwise(F.lit(0)).cast("int") for r in RULES})


def _weight(v: Column, on_good: Column, on_bad: Column) -> Column:
    """Log odds for good that a vote gives."""
    return F.when(v == 1, F.log(on_good / (1 - on_bad))).when(v == -1, F.log((1 - on_good) / on_bad)).otherwise(F.lit(0.0))


def estimate(voted: DataFrame, rounds: int = ROUNDS, start: tuple[float, float, float] = (PRIOR, ON_GOOD, ON_BAD)) -> dict:
    """EM over the counts of vote patterns of all rows: {"prior": share of good documents, rule: (accuracy on good, on bad), ...}."""
    names = [f"v_{r.name}" for r in RULES]
    at = range(len(names))
    patterns = voted.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct(F.array(*names).alias("v"), "n"))).alias("p"))

    def zeros() -> Column:
        return F.array(*[F.lit(0.0) for _ in at])

    def step(state: Column, _: Column) -> Column:
        def with_posterior(x: Column) -> Column:
            z = reduce(lambda a, b: a + b, [_weight(F.get(x["v"], F.lit(j)), state["g"][j], state["b"][j]) for j in at], F.log(state["prior"] / (1 - state["prior"])))
            return F.struct(x["n"].alias("n"), x["v"].alias("v"), (x["n"] / (1 + F.exp(-z))).alias("good"))

        def add(s: Column, x: Column) -> Column:
            bad = x["n"] - x["good"]

            def each(name: str, vote: Column, share: Column) -> Column:
                return F.array(*[s[name][j] + F.when(F.get(x["v"], F.lit(j)) == vote, share).otherwise(F.lit(0.0)) for j in at]).alias(name)

            return F.struct((s["n"] + x["n"]).alias("n"), (s["good"] + x["good"]).alias("good"), each("gg", F.lit(1), x["good"]), each("gb", F.lit(-1), x["good"]), each("bg", F.lit(1), bad), each("bb", F.lit(-1), bad))

        def updated(s: Column) -> Column:
            g = [(s["gg"][j] + GOOD_VOTES[0]) / (s["gg"][j] + s["gb"][j] + sum(GOOD_VOTES)) for j in at]
            b = [(s["bb"][j] + BAD_VOTES[0]) / (s["bb"][j] + s["bg"][j] + sum(BAD_VOTES)) for j in at]
            return F.struct(((s["good"] + SEEN[0]) / (s["n"] + sum(SEEN))).alias("prior"), F.array(*g).alias("g"), F.array(*b).alias("b"))

        empty = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("good"), *[zeros().alias(x) for x in ("gg", "gb", "bg", "bb")])
        return F.aggregate(F.transform("p", with_posterior), empty, add, updated)

    first = F.struct(F.lit(start[0]).alias("prior"), F.array(*[F.lit(start[1]) for _ in at]).alias("g"), F.array(*[F.lit(start[2]) for _ in at]).alias("b"))
    state = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step).alias("s")).first()["s"]
    return {"prior": state["prior"]} | {r.name: (state["g"][j], state["b"][j]) for j, r in enumerate(RULES)}


def posterior(model: dict) -> Column:
    """Probability that a voted document is good."""
    z = [_weight(c(f"v_{r.name}"), F.lit(model[r.name][0]), F.lit(model[r.name][1])) for r in RULES]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, z, F.log(F.lit(model["prior"] / (1 - model["prior"]))))))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, votes, base_failed, quality (posterior) and kept."""
    voted = stored(votes(document_statistics(docs)).withColumn("base_failed", base_failed()), "votes")
    scored = voted.withColumn("quality", posterior(estimate(voted.where(~c("base_failed")))))
    return scored.withColumn("kept", ~c("base_failed") & (F.round("quality", 9) >= 0.5))


def op9_quality_rules(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same counts, votes and EM in DuckDB SQL: EM is a recursive query over the counts of vote patterns."""
    at = range(len(RULES))
    cast = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v{j}" for j, r in enumerate(RULES))
    vs = ", ".join(f"v{j}" for j in at)
    z = "ln(prior / (1 - prior))" + "".join(f" + CASE v{j} WHEN 1 THEN ln(g{j} / (1 - b{j})) WHEN -1 THEN ln((1 - g{j}) / b{j}) ELSE 0 END" for j in at)
    g = ", ".join(f"(coalesce(sum(n * q) FILTER (v{j} = 1), 0) + {GOOD_VOTES[0]}) / (coalesce(sum(n * q) FILTER (v{j} <> 0), 0) + {sum(GOOD_VOTES)}) AS g{j}" for j in at)
    b = ", ".join(f"(coalesce(sum(n * (1 - q)) FILTER (v{j} = -1), 0) + {BAD_VOTES[0]}) / (coalesce(sum(n * (1 - q)) FILTER (v{j} <> 0), 0) + {sum(BAD_VOTES)}) AS b{j}" for j in at)
    start = ", ".join([f"CAST({ON_GOOD} AS DOUBLE) AS g{j}" for j in at] + [f"CAST({ON_BAD} AS DOUBLE) AS b{j}" for j in at])
    words = "list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT r, doc_id, t, {words} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
windows AS (SELECT r, i, array_to_string(w[i:i + 2], chr(1)) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts WHERE len(w) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM again) GROUP BY r),
stats AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(regexp_extract_all(t, '[#*$%&|<>]+')) AS n_symbol_runs, length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS n_letters,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper,
  len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '[.!?]$'))) AS n_ended_lines, len(list_distinct(w)) AS n_distinct_words, coalesce(n_repeat_words, 0) AS n_repeat_words FROM parts LEFT JOIN covered USING (r)),
cast_ AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {cast} FROM stats),
patterns AS (SELECT {vs}, CAST(count(*) AS DOUBLE) AS n FROM cast_ WHERE NOT base_failed GROUP BY ALL),
em AS (SELECT 0 AS round, CAST({PRIOR} AS DOUBLE) AS prior, {start}
  UNION ALL
  SELECT round + 1, (sum(n * q) + {SEEN[0]}) / (sum(n) + {sum(SEEN)}) AS prior, {g}, {b}
  FROM (SELECT em.round, n, {vs}, 1 / (1 + exp(-({z}))) AS q FROM em, patterns WHERE em.round < {ROUNDS}) GROUP BY round),
model AS (SELECT * FROM em WHERE round = {ROUNDS}),
judged AS (SELECT c.*, 1 / (1 + exp(-({z}))) AS quality FROM cast_ c, model)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND round(quality, 9) >= 0.5 AS kept FROM judged
"""


ORACLE_SQL = _oracle()
