"""Rows of the findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["file", "id", "pass", "category", "rule_id", "cwe", "severity", "level", "message", "line", "end_line", "snippet", "fix", "evidence", "confidence", "tags", "original_severity", "labels"]
SEVERITIES = ["low", "medium", "high", "critical"]


def col(c: str | Column | None, kind: str = "string") -> Column:
    return (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(kind)


def findings(df: DataFrame, rule: str, category: str, cwe: str | Column | None, severity: str | Column, level: str | Column, message: Column, line: str | Column = "line", end_line=None, snippet=None, fix: str | Column | None = None, evidence: dict[str, str | Column] | None = None, name: str | None = None, id_suffix: str | Column = "") -> DataFrame:
    """df's rows as findings. Strings for cwe, severity, level and fix are texts; for line, end_line and snippet column names."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    at = col(line, "int")
    detail = F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in evidence.items()])) if evidence else F.lit(None).cast("string")
    empty = F.lit(None).cast("array<string>")
    return df.select(
        "file",
        F.concat(F.lit(f"{rule}-"), F.col("file"), F.lit("-"), at.cast("string"), text(id_suffix)).alias("id"),
        F.lit(name or rule).alias("pass"),
        F.lit(category).alias("category"),
        F.lit(rule).alias("rule_id"),
        text(cwe).alias("cwe"),
        text(severity).alias("severity"),
        text(level).alias("level"),
        message.alias("message"),
        at.alias("line"),
        col(end_line, "int").alias("end_line"),
        col(snippet).alias("snippet"),
        text(fix).alias("fix"),
        detail.alias("evidence"),
        F.lit(None).cast("string").alias("confidence"),
        empty.alias("tags"),
        F.lit(None).cast("string").alias("original_severity"),
        empty.alias("labels"),
    )
