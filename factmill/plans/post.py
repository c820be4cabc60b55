"""After the passes: filters, downgrades, profiles, coalescing, caps and suppressions, in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .findings import SEVERITIES

CAP = 1000
#: Rules that a library profile lowers to notes.
LIBRARY_RULES = ["missing-public-doc", "unused-interface-method", "naming-convention", "stale-doc-ref"]


def rank(severity: Column | str = "severity") -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity) if isinstance(severity, str) else severity)


def by_severity(df: DataFrame, wanted: str) -> DataFrame:
    """One severity is the least that stays; a comma-separated list is exactly what stays."""
    names = [x.strip().lower() for x in wanted.split(",") if x.strip()]
    bad = [x for x in names if x not in SEVERITIES]
    if bad or not names:
        raise ValueError(f"unknown severity: {', '.join(bad) or wanted}")
    if "," not in wanted:
        return df.where(rank() >= SEVERITIES.index(names[0]) + 1)
    return df.where(F.col("severity").isin(names))


def without_cwe(df: DataFrame, excluded: list[str]) -> DataFrame:
    return df.where(F.col("cwe").isNull() | ~F.upper("cwe").isin([x.upper() for x in excluded]))


def by_category(df: DataFrame, categories: list[str]) -> DataFrame:
    return df.where(F.col("category").isin(categories))


def confident(df: DataFrame, speculative: bool = False) -> DataFrame:
    return df if speculative else df.where(F.coalesce("confidence", F.lit("high")) == "high")


def not_suppressed(df: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Anti-join; a suppression without a file or a line holds for all of them. Each kind is an equi-join of its own."""
    for keys in (["pass"], ["pass", "file"], ["pass", "file", "line"]):
        own = suppressions
        for k in ("file", "line"):
            own = own.where(F.col(k).isNotNull() if k in keys else F.col(k).isNull())
        df = df.join(own.select(*keys).distinct(), keys, "left_anti")
    rest = suppressions.where("file is null and line is not null").select("pass", "line").distinct()
    return df.join(rest, ["pass", "line"], "left_anti")


def api_surface_downgrade(df: DataFrame, tag: str = "library-api-surface") -> DataFrame:
    """Severe findings with the tag become warnings; what they were is kept."""
    hit = F.coalesce(F.array_contains("tags", tag), F.lit(False)) & F.col("severity").isin("high", "critical")
    return df.withColumn("original_severity", F.when(hit, F.coalesce("original_severity", "severity")).otherwise(F.col("original_severity"))).withColumn("level", F.when(hit, "warning").otherwise(F.col("level"))).withColumn("severity", F.when(hit, "medium").otherwise(F.col("severity")))


def profile_transform(df: DataFrame, files: DataFrame) -> DataFrame:
    """Libraries: critical becomes medium, and some rules become notes. Applications: the original severity comes back."""
    p = df.join(files.select("file", F.split_part("project_profile", F.lit("/"), F.lit(1)).alias("shape")), "file", "left")
    lib, app = F.col("shape") == "library", F.col("shape") == "application"
    low = lib & F.col("rule_id").isin(LIBRARY_RULES)
    mid = lib & (F.col("severity") == "critical")
    back = app & F.col("original_severity").isNotNull()
    out = p.withColumn("new", F.when(low, "low").when(mid, "medium").when(back, F.col("original_severity")).otherwise(F.col("severity")))
    out = out.withColumn("original_severity", F.when(F.coalesce(low | mid, F.lit(False)), F.coalesce("original_severity", "severity")).otherwise(F.col("original_severity")))
    return out.withColumn("level", F.when(F.coalesce(low, F.lit(False)), "note").otherwise(F.col("level"))).withColumn("severity", F.col("new")).drop("new", "shape")


def coalesce_notes(df: DataFrame) -> DataFrame:
    """Notes of two rules or more on one line, with nothing worse there, become one finding that lists the other rules as labels.

    The primary is the severest; of equally severe ones that with the least rule.
    """
    at = Window.partitionBy("file", "line")
    order = at.orderBy(rank().desc(), "rule_id", "id")
    d = df.withColumn("_notes", F.min((F.col("level") == "note").cast("int")).over(at) == 1).withColumn("_rules", F.array_sort(F.collect_set("rule_id").over(at))).withColumn("_n", F.row_number().over(order))
    merge = F.col("_notes") & (F.size("_rules") >= 2)
    d = d.where(~merge | (F.col("_n") == 1))
    return d.withColumn("labels", F.when(merge, F.array_except("_rules", F.array("rule_id"))).otherwise(F.col("labels"))).drop("_notes", "_rules", "_n")


def cap_per_file(df: DataFrame, most: int = CAP) -> DataFrame:
    """Files with more findings than the cap get one advisory instead, which counts them by rule and severity; 0 or less: no cap."""
    if most <= 0:
        return df
    n = df.groupBy("file").agg(F.count("*").alias("n"))
    over = n.where(F.col("n") > most)
    by = lambda c: df.join(over, "file", "left_semi").groupBy("file", c).agg(F.count("*").alias("k")).groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "k")))).alias(f"by_{c}"))
    note = over.join(by("rule_id"), "file").join(by("severity"), "file")
    from .findings import findings

    advisory = findings(note.withColumn("line", F.lit(1)), "finding-cap", "maintainability", None, "low", "note", F.concat(F.col("n").cast("string"), F.lit(" findings in this file are left out")), evidence={"suppressed_count": "n", "by_rule": "by_rule_id", "by_severity": "by_severity"})
    return df.join(over, "file", "left_anti").unionByName(advisory)


def chain(df: DataFrame, files: DataFrame, suppressions: DataFrame | None = None, speculative: bool = False, most: int = CAP) -> DataFrame:
    out = cap_per_file(coalesce_notes(profile_transform(api_surface_downgrade(confident(df, speculative)), files)), most)
    return out if suppressions is None else not_suppressed(out, suppressions)
