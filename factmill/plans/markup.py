"""Markup: what a page's tags say. Inline scripts, external scripts and handlers; attribute checks; merging script facts into the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import findings


def tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, n, tag (name in lower case), raw (the start tag), offset line: every start tag in order. Comments are blank."""
    plain = F.regexp_replace(F.col(html), "(?s)<!--.*?-->", "")
    t = pages.select(key, F.posexplode(F.regexp_extract_all(plain, F.lit("<[a-zA-Z][^<>]*>"), F.lit(0))).alias("n", "raw"))
    return t.withColumn("tag", F.lower(F.regexp_extract("raw", "^<([a-zA-Z][a-zA-Z0-9-]*)", 1)))


def attribute(raw: Column, name: str) -> Column:
    """The attribute's value, '' if it has none, null if the tag does not have it."""
    has = raw.rlike(f"(?i)\\s{name}(\\s|=|>|/)")
    value = F.regexp_extract(raw, f"(?i)\\s{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>]*)", 1)
    return F.when(has, F.regexp_replace(value, "^[\"']|[\"']$", ""))


def scripts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, n, code, line_offset: inline scripts; src is null."""
    body = F.regexp_extract_all(F.col(html), F.lit("(?s)(<script(?:\\s[^>]*)?>.*?</script>)"), F.lit(1))
    s = pages.select(key, html, F.posexplode(body).alias("n", "raw"))
    s = s.withColumn("src", attribute(F.regexp_extract("raw", "^<script[^>]*>", 0), "src")).withColumn("code", F.regexp_extract("raw", "(?s)^<script[^>]*>(.*)</script>$", 1))
    before = F.expr(f"substring({html}, 1, locate(raw, {html}) - 1)")
    return s.select(key, "n", "src", "code", F.regexp_count(before, F.lit("\\n")).alias("line_offset"))


def handlers(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, n, tag, event, code: on... attributes."""
    t = tags(pages, key, html)
    h = t.withColumn("h", F.explode(F.regexp_extract_all("raw", F.lit("(?i)\\s(on[a-z]+\\s*=\\s*(?:\"[^\"]*\"|'[^']*'))"), F.lit(1))))
    return h.select(key, "n", "tag", F.lower(F.regexp_extract("h", "^(on[a-zA-Z]+)", 1)).alias("event"), F.regexp_extract("h", "=\\s*[\"'](.*)[\"']$", 1).alias("code"))


def merge_script_facts(facts: DataFrame, script_blocks: DataFrame, keys: list[str], line_columns: list[str]) -> DataFrame:
    """Facts of script blocks as facts of the page: lines move by the block's offset."""
    j = facts.join(script_blocks.select(*keys, "line_offset"), keys)
    return j.withColumns({c: F.col(c) + F.col("line_offset") for c in line_columns}).drop("line_offset")


def attribute_findings(pages: DataFrame, key: str = "file", html: str = "html") -> DataFrame:
    """The eight attribute checks, one finding for each tag and check."""
    t = tags(pages, key, html)
    if key != "file":
        t = t.withColumn("file", F.col(key).cast("string"))
    t = t.withColumn("line", F.lit(1))
    a = lambda name: attribute(F.col("raw"), name)
    low = lambda name: F.lower(F.coalesce(a(name), F.lit("")))
    external = low("src").rlike("^(https?:)?//")
    checks = [
        ("html-missing-noopener", "CWE-1022", "medium", (F.col("tag") == "a") & (low("target") == "_blank") & ~low("rel").rlike("noopener|noreferrer"), "A link opens a new window that can reach this one"),
        ("html-javascript-uri", "CWE-79", "high", F.regexp_replace(F.coalesce(a("href"), a("src"), F.lit("")), "\\s", "").rlike("(?i)^javascript:"), "A javascript: address runs code"),
        ("html-missing-sandbox", "CWE-1021", "medium", (F.col("tag") == "iframe") & a("sandbox").isNull(), "A frame without sandbox"),
        ("html-mixed-content", "CWE-319", "medium", F.col("tag").isin("script", "link", "img", "iframe", "video", "audio") & F.coalesce(F.when(F.col("tag") == "link", low("href")).otherwise(low("src")), F.lit("")).rlike("^http://"), "Content over http"),
        ("html-missing-sri", "CWE-353", "medium", (F.col("tag") == "script") & external & a("integrity").isNull(), "An external script without integrity"),
        ("html-autocomplete", "CWE-525", "low", (F.col("tag") == "input") & (low("type") == "password") & ~low("autocomplete").isin("off", "new-password", "current-password"), "A password field that browsers fill in"),
        ("html-inline-handler", "CWE-79", "low", F.col("raw").rlike("(?i)\\son[a-z]+\\s*="), "Code in an attribute"),
        ("html-form-action", "CWE-79", "high", (F.col("tag") == "form") & F.regexp_replace(low("action"), "\\s", "").rlike("^javascript:"), "A form that runs code"),
    ]
    found = None
    for rule, cwe, severity, condition, said in checks:
        one = findings(t.where(condition), rule, "security", cwe, severity, {"high": "error", "medium": "warning", "low": "note"}[severity], F.lit(said), snippet=F.col("raw"), id_suffix=F.concat(F.lit("-"), F.col("n").cast("string")))
        found = one if found is None else found.unionByName(one)
    return found
