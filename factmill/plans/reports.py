"""What is handed out: text, JSON, SARIF, CycloneDX, SPDX, and whether a scan fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .post import rank

SECURITY_SEVERITY = {"critical": "9.0", "high": "7.0", "medium": "5.0", "low": "3.0"}


def text(findings: DataFrame) -> DataFrame:
    """file, report: a line for each finding, by line."""
    row = F.format_string("  %s:%d  %s  %s", F.upper("severity"), F.col("line"), F.col("rule_id"), F.col("message"))
    return findings.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "rule_id", row.alias("row")))), lambda x: x["row"]), "\n").alias("report"))


def as_json(findings: DataFrame) -> DataFrame:
    """file, json: the file's findings as one document."""
    return findings.groupBy("file").agg(F.to_json(F.struct(F.first("file").alias("file"), F.sort_array(F.collect_list(F.struct("line", "rule_id", "severity", "level", "cwe", "message", "category"))).alias("findings"))).alias("json"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, category, rule and file, and in all, in one pass of grouping sets."""
    sets = findings.select("severity", "category", "rule_id", "file")
    g = sets.groupingSets([[F.col(c)] for c in sets.columns] + [[]], *map(F.col, sets.columns)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    by = F.when(F.col("g") == 7, "severity").when(F.col("g") == 11, "category").when(F.col("g") == 13, "rule_id").when(F.col("g") == 14, "file").otherwise("all")
    return g.select(by.alias("by"), F.coalesce("severity", "category", "rule_id", "file", F.lit("")).alias("key"), "n")


def sarif(findings: DataFrame, tool: str = "factmill") -> DataFrame:
    """sarif: one run as a document of version 2.1.0; a rule stands once, with the security severity of its severest finding."""
    worst = findings.groupBy("rule_id").agg(F.max_by("severity", rank()).alias("severity"), F.min_by("message", F.struct("file", "line", "message")).alias("text"))
    score = F.try_element_at(F.create_map(*[F.lit(x) for kv in SECURITY_SEVERITY.items() for x in kv]), "severity")
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("text")).alias("shortDescription"), F.struct(score.alias("security-severity")).alias("properties"))
    rules = worst.agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    results = findings.agg(F.sort_array(F.collect_list(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")))).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return rules.withColumn("k", F.lit(1)).join(F.broadcast(results.withColumn("k", F.lit(1))), "k").select(F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def cyclonedx(dependencies: DataFrame) -> DataFrame:
    """bom: CycloneDX 1.5; development dependencies are excluded from what runs."""
    scope = F.when(F.col("scope") == "dev", "excluded").when(F.col("scope") == "optional", "optional").otherwise("required")
    c = F.struct(F.lit("library").alias("type"), F.col("name"), F.col("version"), F.col("purl"), scope.alias("scope"))
    return dependencies.agg(F.sort_array(F.collect_list(c)).alias("components")).select(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), F.col("components"))).alias("bom"))


def spdx(dependencies: DataFrame, name: str = "project", created: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """document: SPDX 2.3; packages are numbered in order of ecosystem, name and version."""
    n = (F.row_number().over(Window.orderBy("ecosystem", "name", "version")) - 1).cast("string")
    d = dependencies.withColumn("id", F.concat(F.lit("SPDXRef-Package-"), n))
    p = F.struct(F.col("id").alias("SPDXID"), F.col("name"), F.col("version").alias("versionInfo"), F.coalesce("license", F.lit("NOASSERTION")).alias("licenseDeclared"), F.lit("NOASSERTION").alias("downloadLocation"))
    r = F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), F.col("id").alias("relatedSpdxElement"))
    a = d.agg(F.sort_array(F.collect_list(p)).alias("packages"), F.sort_array(F.collect_list(r)).alias("relationships"))
    return a.select(F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.lit(name).alias("name"), F.struct(F.lit(created).alias("created")).alias("creationInfo"), F.col("packages"), F.col("relationships"))).alias("document"))


def exit_code(findings: DataFrame) -> int:
    """1 if a security finding is left, else 0."""
    return 0 if findings.where("category = 'security'").isEmpty() else 1


def attack_surface(findings: DataFrame, most: int = 10) -> DataFrame:
    """The files and rules with the most findings: kind, key, n."""
    from ..operators.picks import top

    out = None
    for kind in ("file", "rule_id"):
        one = top(findings.groupBy(F.col(kind).alias("key")).agg(F.count("*").alias("n")), "key", "n", most).select(F.lit(kind).alias("kind"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out


def similar(findings: DataFrame, finding_id: str) -> DataFrame:
    """Other findings with the same rule and cwe as the one named."""
    one = findings.where(F.col("id") == finding_id).select("rule_id", F.col("cwe").alias("c")).distinct()
    return findings.join(F.broadcast(one), "rule_id").where((F.col("id") != finding_id) & F.col("cwe").eqNullSafe(F.col("c"))).drop("c")


def capped_text(column: str, most: int = 2048) -> F.Column:
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit("..."))).otherwise(F.col(column))


def observed(findings: DataFrame, name: str = "findings"):
    """findings that count themselves while an action runs, and the observation that has the counts afterwards."""
    from pyspark.sql import Observation

    o = Observation(name)
    return findings.observe(o, F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity").isin("high", "critical")).alias("severe")), o


def explained(findings: DataFrame, finding_id: str, lines: DataFrame, around: int = 3) -> DataFrame:
    """A finding with the source lines around it."""
    one = findings.where(F.col("id") == finding_id).select("id", "rule_id", "message", "fix", "file", F.col("line").alias("at"))
    return lines.join(F.broadcast(one), "file").where(F.abs(F.col("line") - F.col("at")) <= around).select("id", "rule_id", "message", "fix", "file", "line", "text")
