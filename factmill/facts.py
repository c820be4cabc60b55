"""The fact tables: schemas, loading, and the joins that most passes share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, joins

#: Table name to DDL; `file` is the key that all tables of a code base share.
SCHEMAS = {
    "files": "file string, language string, loc int, hash string, package string, project_profile string",
    "source_lines": "file string, line int, text string",
    "types": "file string, type_ord int, name string, kind string, package string, extends string, implements array<string>, annotations array<string>, start_line int, end_line int",
    "methods": "file string, type_ord int, method_ord int, type_name string, name string, return_type string, annotations array<string>, modifiers array<string>, start_line int, end_line int",
    "params": "file string, type_ord int, method_ord int, position int, name string, type string, annotations array<string>, line int",
    "fields": "file string, type_ord int, name string, type string, modifiers array<string>, annotations array<string>",
    "calls": "file string, call_id int, method_name string, receiver string, receiver_type string, receiver_type_fqn string, line int, `column` int, in_method string, is_constructor boolean, resolution struct<status:string,target:string,candidates:array<string>>",
    "call_args": "file string, call_id int, position int, expression string, variable string, literal string, value string",
    "cfg_blocks": "file string, id int, type string, start_line int, end_line int",
    "cfg_edges": "file string, `from` int, `to` int, type string",
    "dfg_defs": "file string, id int, variable string, line int, `column` int, kind string, expression string",
    "dfg_uses": "file string, id int, variable string, line int, `column` int, def_id int",
    "dfg_chains": "file string, from_def int, to_def int, via string",
    "imports": "file string, imported_name string, from_package string, alias string, is_wildcard boolean, line_number int",
    "exports": "file string, symbol string, kind string, visibility string",
    "taint_sources": "file string, src_ord int, type string, location string, severity string, line int, confidence double, variable string, in_method string, code string, constant boolean, spi boolean, demo_path boolean",
    "taint_sinks": "file string, sink_ord int, type string, cwe string, location string, line int, confidence double, method string, arg_positions array<int>, class string, code string, tags array<string>",
    "taint_sanitizers": "file string, san_ord int, type string, method string, line int, sanitizes array<string>",
    "taint_flows": "file string, source_line int, sink_line int, source_type string, sink_type string, hops int, confidence double, sanitized boolean, tags array<string>",
    "findings": "file string, id string, pass string, category string, rule_id string, cwe string, severity string, level string, message string, line int, end_line int, snippet string, fix string, evidence string, confidence string, tags array<string>, original_severity string, labels array<string>",
    "metrics": "file string, name string, category string, value double, unit string, iso_25010 string, description string",
    "dependencies": "name string, version string, ecosystem string, scope string, purl string, license string",
    "build_modules": "root string, build_system string, build_file string, plugins array<string>, packaging string, distribution_urls array<string>, has_jpms boolean, has_spi boolean, has_main boolean, parent_relative_path string",
    "suppressions": "pass string, file string, line int, reason string",
}


class Facts:
    """Fact tables by name; a table that was not given is empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self._tables = dict(tables or {})

    @classmethod
    def load(cls, spark: SparkSession, folder: str, kind: str = "parquet") -> Facts:
        """Tables stored as folder/<name>.<kind>; those that are not there are empty."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = {s.getPath().getName() for s in fs.listStatus(path)}
        return cls(spark, {n: spark.read.schema(ddl).format(kind).load(f"{folder}/{n}.{kind}") for n, ddl in SCHEMAS.items() if f"{n}.{kind}" in names})

    def save(self, folder: str) -> None:
        for n, df in self._tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{n}.parquet")

    def with_tables(self, **tables: DataFrame) -> Facts:
        """A new version: passes never change tables in place."""
        return Facts(self.spark, self._tables | tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._tables:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self._tables[name]

    def of_language(self, df: DataFrame, *languages: str, but: bool = False) -> DataFrame:
        """Rows whose file has (or, with but, has not) one of the languages."""
        chosen = self.files.where(F.col("language").isin(*languages)).select("file")
        return df.join(chosen, "file", "left_anti" if but else "left_semi")

    @cached_property
    def loops(self) -> DataFrame:
        return graph.natural_loops(self.cfg_blocks, self.cfg_edges)

    @cached_property
    def exception_pairs(self) -> DataFrame:
        """file, try_start, catch_start, catch_end: blocks that an exception edge joins."""
        b = self.cfg_blocks
        tries = b.select("file", F.col("id").alias("from"), F.col("start_line").alias("try_start"))
        catches = b.select("file", F.col("id").alias("to"), F.col("start_line").alias("catch_start"), F.col("end_line").alias("catch_end"))
        return self.cfg_edges.where("type = 'exception'").join(tries, ["file", "from"]).join(catches, ["file", "to"]).select("file", "try_start", "catch_start", "catch_end").distinct()

    def in_method(self, points: DataFrame, line: str, ids: list[str], how: str = "inner") -> DataFrame:
        """Each point with the first method, in order of types and methods, whose lines hold it: m_type, m_name, m_start, m_end."""
        m = self.methods.select("file", F.col("type_name").alias("m_type"), F.col("name").alias("m_name"), F.col("start_line").alias("m_start"), F.col("end_line").alias("m_end"), F.col("type_ord").alias("m_type_ord"), F.col("method_ord").alias("m_ord"))
        return joins.enclosing(points, m, ["file"], line, "m_start", "m_end", ["m_type_ord", "m_ord"], ids, how).drop("m_type_ord", "m_ord")

    def with_text(self, df: DataFrame, line: str = "line") -> DataFrame:
        """The row's source line as `text`, empty where there is none."""
        return df.join(self.source_lines.select("file", F.col("line").alias(line), "text"), ["file", line], "left").withColumn("text", F.coalesce("text", F.lit("")))
