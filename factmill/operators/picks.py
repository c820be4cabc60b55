"""Group-wise picks, dedup, caps and pair statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_match


def keep_best(df: DataFrame, keys: Sequence[str], best: str, order: Sequence[str]) -> DataFrame:
    """One row for each key: the greatest `best`; of equal ones the first in the order."""
    return first_match(df, keys, [F.col(best).desc(), *order])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return first_match(df, keys, order)


def union_by_priority(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Several producers' rows, of equal keys those of the first producer (and of its own the first)."""
    every = None
    for i, f in enumerate(frames):
        f = f.withColumn("priority", F.lit(i))
        every = f if every is None else every.unionByName(f, allowMissingColumns=True)
    return first_match(every, keys, ["priority", *order])


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], most: int) -> DataFrame:
    """At most so many rows for each key: for reports whose length is the feature."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def top(df: DataFrame, key: str, count: str, most: int = 10) -> DataFrame:
    """The most frequent keys, ties by name."""
    return df.orderBy(F.col(count).desc(), F.col(key)).limit(most)


def set_union(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """The union of an array column over each group, sorted."""
    return df.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(out))


def argmax(df: DataFrame, keys: Sequence[str], value: str, by: str, tie: str) -> DataFrame:
    """For each group the value with the greatest `by`; ties go to the least `tie`."""
    return first_match(df, keys, [F.col(by).desc(), F.col(tie)]).select(*keys, value, by)


def shared_pairs(members: DataFrame, uses: DataFrame, keys: Sequence[str], member: str, item: str) -> DataFrame:
    """Per key: n (members), p (pairs without a common item) and q (pairs with one).

    q counts distinct pairs from an equi-join on the item; p is what is left of n (n - 1) / 2: no list of all pairs is made.
    """
    n = members.select(*keys, member).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    u = uses.select(*keys, member, item).distinct()
    a, b = u.withColumnRenamed(member, "a"), u.withColumnRenamed(member, "b")
    q = a.join(b, [*keys, item]).where("a < b").select(*keys, "a", "b").distinct().groupBy(*keys).agg(F.count("*").alias("q"))
    return n.join(q, list(keys), "left").withColumn("q", F.coalesce("q", F.lit(0))).withColumn("p", F.expr("n * (n - 1) div 2 - q"))


def lcom(pairs: DataFrame) -> DataFrame:
    """Lack of cohesion: max(p - q, 0)."""
    return pairs.withColumn("lcom", F.greatest(F.col("p") - F.col("q"), F.lit(0)))


def lcom2(pairs: DataFrame) -> DataFrame:
    """(p - q) over all pairs, within 0 and 1; 0 for a single member."""
    every = F.expr("n * (n - 1) / 2")
    return pairs.withColumn("lcom2", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("p") - F.col("q")) / every))))


def vote(conditions: Sequence[Column], least: int) -> Column:
    """At least so many of the conditions hold."""
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c.cast("int"), F.lit(0))
    return total >= least
