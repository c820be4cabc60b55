"""The operators' queries over whole tables, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, line_dedup, packing, quality_rules, simhash, suffix_dedup, token_counts, token_files, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda s, d: toxicity.op1_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op2_suffix_dedup": lambda s, d: suffix_dedup.op2_suffix_dedup(table(s, d, "documents")),
        "op3_decontaminate": lambda s, d: decontaminate.op3_decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_token_files": lambda s, d: token_files.op4_token_files(s, table(s, d, "documents")),
        "op5_line_dedup": lambda s, d: line_dedup.op5_line_dedup(table(s, d, "documents")),
        "op6_token_counts": lambda s, d: token_counts.op6_token_counts(table(s, d, "documents")),
        "op7_simhash": lambda s, d: simhash.op7_simhash(table(s, d, "documents")),
        "op8_packing": lambda s, d: packing.op8_packing(s, table(s, d, "documents")),
        "op9_quality_rules": lambda s, d: quality_rules.op9_quality_rules(table(s, d, "documents")),
        "op10_html_extract": lambda s, d: html_extract.op10_html_extract(table(s, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": suffix_dedup.ORACLE_SQL, "op3_decontaminate": decontaminate.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, "op9_quality_rules": quality_rules.ORACLE_SQL}
