"""Join shapes beyond equality: containment, as-of, band, suffix, prefix and probing joins.

Each is an equi-join with a residual, so Spark can hash or sort-merge it; none is a bare theta join. Where one key (a file, a user)
may have many rows on both sides, the containment and band joins also bin the ordered column, which bounds the
rows that meet to those in neighbouring bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fresh(df: DataFrame, *others: DataFrame, stem: str) -> str:
    used = {c for x in (df, *others) for c in x.columns}
    return next(n for i in range(1000) if (n := f"{stem}{i}") not in used)


def range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, start: str, end: str, bin_size: int | None = None, how: str = "inner") -> DataFrame:
    """All pairs with equal keys and start <= point <= end. Ranges without an end are open; columns must differ but for keys.

    bin_size: width of bins for long key groups; every range is listed under each bin it touches, so it must have an end.
    """
    inside = (F.col(point) >= F.col(start)) & (F.col(end).isNull() | (F.col(point) <= F.col(end)))
    on = list(keys)
    if bin_size:
        b = _fresh(points, ranges, stem="bin")
        points = points.withColumn(b, F.floor(F.col(point) / bin_size))
        ranges = ranges.where(F.col(start) <= F.col(end)).withColumn(b, F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
        on.append(b)
        joined = points.alias("p").join(ranges.alias("r"), on, "inner").where(inside).drop(b)
        if how == "inner":
            return joined
        raise ValueError("binned joins are inner joins")
    left, right = points.alias("p"), ranges.alias("r")
    condition = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on]
    joined = left.join(right, [*condition, inside], how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select("p.*", *[f"r.{c}" for c in ranges.columns if c not in on])


def first_match(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """Of each group the row that comes first in the order."""
    n = _fresh(df, stem="rank")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


#: Lines of a bin in which points and ranges of one key meet.
BIN = 1024


def enclosing(points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, start: str, end: str, order: Sequence[str], id_columns: Sequence[str], how: str = "inner", bin_size: int = BIN) -> DataFrame:
    """range_join, where the first range in the given order wins for each point (points are told apart by keys and id_columns).

    Ranges are listed under the bins that they touch, so a point of a long file meets the ranges around it and not all of the file. Points
    without a range stay with how="left". Ranges without an end hold nothing.
    """
    found = first_match(range_join(points, ranges, keys, point, start, end, bin_size), [*keys, *id_columns], list(order))
    if how == "inner":
        return found
    if how != "left":
        raise ValueError(how)
    ids = [*keys, *id_columns]
    points = points.dropDuplicates(ids)
    of = found.select(*ids, *[c for c in ranges.columns if c not in keys])
    missing = [c for c in ids if points.schema[c].nullable]
    if not missing:
        return points.join(of, ids, "left")
    of = of.select(*[F.col(c).alias(f"_m_{c}") for c in ids], *[c for c in of.columns if c not in ids])
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in ids]
    return points.join(of, same, "left").drop(*[f"_m_{c}" for c in ids])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, values: Sequence[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """Each left row with the nearest right row before (or after) it: one union and one window, no pairs.

    values: right columns to bring, prefixed `asof_`. Of right rows at the same place the greatest values win. strict: equal places do not match.
    """
    v = F.struct(F.col(right_on).alias("_at"), *[F.col(c) for c in values])
    null = F.lit(None).cast(right.select(v.alias("v")).schema["v"].dataType)
    side = 1 if direction == "backward" else -1
    # at equal places right rows come before left rows when they may match
    l = left.select("*", F.col(left_on).alias("_o"), F.lit(1 if not strict else 0).alias("_s"), null.alias("_v"), F.lit(True).alias("_left"))  # noqa: E741
    r = right.select(*keys, F.col(right_on).alias("_o"), F.lit(0 if not strict else 1).alias("_s"), v.alias("_v"), F.lit(False).alias("_left"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = [F.col("_o").asc(), F.col("_s").asc(), F.col("_v").asc_nulls_last()] if side == 1 else [F.col("_o").desc(), F.col("_s").asc(), F.col("_v").asc_nulls_last()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where("_left")
    return found.select(*left.columns, F.col("_f._at").alias(f"asof_{right_on}"), *[F.col(f"_f.{c}").alias(f"asof_{c}") for c in values])


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, distance: float) -> DataFrame:
    """Pairs with equal keys and |left_on - right_on| <= distance. Columns must differ but for keys."""
    b = _fresh(left, right, stem="band")
    width = distance if distance > 0 else 1
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width))
    l = left.withColumn(b, bin_of(left_on))  # noqa: E741
    r = right.withColumn(b, F.explode(F.array(bin_of(right_on) - 1, bin_of(right_on), bin_of(right_on) + 1)))
    return l.join(r, [*keys, b]).where(F.abs(F.col(left_on) - F.col(right_on)) <= distance).drop(b)


def ordered_pairs(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """All pairs i < j of a group's rows; columns get the suffixes _a and _b."""
    a = df.select(*keys, *[F.col(c).alias(f"{c}_a") for c in {order: 0} | dict.fromkeys(columns, 0)])
    b = df.select(*keys, *[F.col(c).alias(f"{c}_b") for c in {order: 0} | dict.fromkeys(columns, 0)])
    return a.join(b, list(keys)).where(F.col(f"{order}_a") < F.col(f"{order}_b"))


def simple_name(qualified: Column | str) -> Column:
    """What follows the last dot: a suffix join `.endswith('.' + name)` is an equi-join on it."""
    return F.substring_index(F.col(qualified) if isinstance(qualified, str) else qualified, ".", -1)


def longest_prefix(points: DataFrame, roots: DataFrame, path: str, root: str, id_columns: Sequence[str]) -> DataFrame:
    """Each point with the deepest root folder that holds it; root '' holds all. Equi-join on every ancestor folder of the path."""
    up = F.split(F.col(path), "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(up) - 1), lambda i: F.array_join(F.slice(up, 1, i), "/"))
    listed = points.withColumn("_root", F.explode(folders))
    joined = listed.join(roots.withColumnRenamed(root, "_root"), "_root")
    return first_match(joined, list(id_columns), [F.length("_root").desc()]).withColumnRenamed("_root", root)


def first_probe(points: DataFrame, candidates: Column, existing: DataFrame, name: str, id_columns: Sequence[str]) -> DataFrame:
    """Each point with the first of its candidate names that exists (column `name`); points without any are left out."""
    listed = points.select("*", F.posexplode(candidates).alias("_k", name))
    return first_match(listed.join(existing.select(name).distinct(), name), list(id_columns), ["_k"]).drop("_k")


def coalesced(points: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str], str]], out: str) -> DataFrame:
    """The first non-null of several lookups, tried in order. lookups: (frame unique by its keys, keys, value column)."""
    found = []
    for i, (frame, keys, value) in enumerate(lookups):
        points = points.join(frame.select(*keys, F.col(value).alias(f"_v{i}")), list(keys), "left")
        found.append(f"_v{i}")
    return points.withColumn(out, F.coalesce(*found)).drop(*found)


def identifiers(text: Column | str) -> Column:
    """Distinct identifiers of a text: joining on them replaces a search for each name by a regular expression made from data."""
    return F.array_distinct(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))


def mentions(texts: DataFrame, text: str, names: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Pairs of a text and a name that occurs in it as an identifier, within equal keys."""
    return texts.withColumn(name, F.explode(identifiers(text))).join(names, [*keys, name])


def reach_pairs(sources: DataFrame, sinks: DataFrame, reach: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source-sink pairs within equal keys, source_type to sink_type allowed by the reach matrix; the matrix joins first, so pairs that it forbids are never made."""
    return sources.join(F.broadcast(reach), "source_type").join(sinks, [*keys, "sink_type"])
