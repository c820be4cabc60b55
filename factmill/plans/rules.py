"""Dimensions: rules by sink type, severity, and which sources reach which sinks. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: sink type: cwe, severity of the rule, severity in scan rows
RULES = {
    "sql_injection": ("CWE-89", "critical", "critical"),
    "nosql_injection": ("CWE-943", "critical", "high"),
    "command_injection": ("CWE-78", "critical", "critical"),
    "xss": ("CWE-79", "medium", "high"),
    "path_traversal": ("CWE-22", "high", "high"),
    "deserialization": ("CWE-502", "critical", "critical"),
    "xxe": ("CWE-611", "high", "critical"),
    "ldap_injection": ("CWE-90", "high", "high"),
    "xpath_injection": ("CWE-643", "high", "high"),
    "ssrf": ("CWE-918", "high", "high"),
    "open_redirect": ("CWE-601", "medium", "medium"),
    "log_injection": ("CWE-117", "low", "medium"),
    "code_injection": ("CWE-94", "critical", "critical"),
    "weak_random": ("CWE-330", "medium", "low"),
    "weak_hash": ("CWE-328", "medium", "low"),
    "weak_crypto": ("CWE-327", "medium", "low"),
    "insecure_cookie": ("CWE-614", "low", "low"),
    "trust_boundary": ("CWE-501", "medium", "medium"),
    "external_taint_escape": ("CWE-668", "medium", "medium"),
    "redos": ("CWE-1333", "high", "medium"),
    "format_string": ("CWE-134", "high", "high"),
    "crlf": ("CWE-113", "medium", "medium"),
    "mass_assignment": ("CWE-915", "high", "high"),
    "mybatis_mapper_call": ("CWE-89", "medium", "medium"),
    "prompt_injection": ("CWE-1427", "high", "high"),
    "insecure_storage": ("CWE-922", "medium", "medium"),
    "prototype_pollution": ("CWE-1321", "high", "high"),
    "regex_dos": ("CWE-1333", "high", "high"),
    "unsafe_memory": ("CWE-119", "high", "high"),
}
CRITICAL_SINKS = ["sql_injection", "command_injection", "deserialization", "code_injection"]
HIGH_SINKS = ["xss", "path_traversal", "xxe", "ssrf", "ldap_injection", "xpath_injection"]
_WEB = "open_redirect trust_boundary log_injection format_string nosql_injection prompt_injection"
REACH = {
    "http_param": f"sql_injection command_injection path_traversal xss xpath_injection ldap_injection ssrf mybatis_mapper_call code_injection crlf mass_assignment deserialization {_WEB}",
    "http_body": f"sql_injection command_injection deserialization xxe xss code_injection mybatis_mapper_call crlf mass_assignment {_WEB}",
    "http_header": f"sql_injection xss ssrf mybatis_mapper_call code_injection crlf {_WEB}",
    "http_cookie": f"sql_injection xss mybatis_mapper_call code_injection crlf {_WEB}",
    "http_path": "path_traversal sql_injection ssrf mybatis_mapper_call open_redirect trust_boundary xss log_injection format_string prompt_injection",
    "http_query": f"sql_injection command_injection xss ssrf mybatis_mapper_call code_injection crlf mass_assignment deserialization {_WEB}",
    "io_input": "command_injection path_traversal deserialization xxe code_injection xss ssrf log_injection format_string prompt_injection",
    "env_input": "command_injection path_traversal",
    "db_input": "xss sql_injection log_injection",
    "file_input": "deserialization xxe path_traversal command_injection code_injection",
    "network_input": "sql_injection command_injection xss ssrf log_injection format_string nosql_injection prompt_injection",
    "config_param": "sql_injection command_injection path_traversal xss ssrf log_injection format_string",
    "interprocedural_param": f"sql_injection command_injection path_traversal xss xpath_injection ldap_injection ssrf code_injection mybatis_mapper_call crlf mass_assignment xxe deserialization {_WEB}",
    "plugin_param": "sql_injection command_injection path_traversal xss code_injection log_injection format_string",
}


def reach(spark: SparkSession) -> DataFrame:
    """source_type, sink_type: pairs that may be a flow; other source types reach nothing."""
    return spark.createDataFrame([(s, k) for s, ks in REACH.items() for k in ks.split()], "source_type string, sink_type string")


def rule_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RULES.items()], "sink_type string, cwe string, severity string, scan_severity string")


def severity(has_path: Column, source_type: Column, sink_type: Column, confidence: Column) -> Column:
    """The ladder of severities; the first rung that holds."""
    http = source_type.isin("http_param", "http_body", "http_header")
    critical, high = sink_type.isin(CRITICAL_SINKS), sink_type.isin(HIGH_SINKS)
    return (
        F.when(has_path & critical & http, "critical")
        .when(has_path & critical & (confidence > 0.8), "critical")
        .when(http & critical, "high")
        .when(has_path & critical, "high")
        .when(has_path & high & (confidence > 0.8), "high")
        .when(has_path, "medium")
        .when(critical | high, "medium")
        .otherwise("low")
    )


def api_confidence(has_path: Column, hops: Column, source: Column, sink: Column, distance: Column) -> Column:
    """Base, path and hops, times the ends' own confidences, and nearness."""
    base = (F.lit(0.5) + F.when(has_path, F.lit(0.3) + F.least(F.lit(0.05) * hops, F.lit(0.1))).otherwise(F.lit(0.0))) * source * sink
    return F.least(F.lit(1.0), base + F.when(distance <= 5, 0.1).when(distance <= 15, 0.05).otherwise(0.0))
