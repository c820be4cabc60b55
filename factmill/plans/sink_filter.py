"""Sinks that their own line, the lines above or their file show to be harmless.

Each stage is a row of a table: for which sinks (language, type, method, class), and what clears them. All rows are looked at in one pass over the
sinks' lines; what a file or the lines above say comes as flags from one pass over the lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts

JS = ("javascript", "typescript")

# Types that parse data and not programs, templates that were compiled before, engines whose template has a name.
DATA_PARSERS = ("Parser", "CommandLine", "JCommander", "DateParser", "FastDateFormat", "FastDatePrinter", "ResultParser", "DateFormat", "SimpleDateFormat", "NumberFormat", "DecimalFormat", "OptionParser", "CmdLineParser")
EVALUATORS = ("GroovyShell", "GroovyClassLoader", "ScriptEngine", "CronParser", "SpelExpressionParser", "ExpressionParser")
COMPILED = ("Template", "JetTemplate", "ITemplate", "VelocityTemplate", "BeetlTemplate")
ENGINES = ("VelocityEngine", "Velocity", "TemplateEngine", "SpringTemplateEngine", "Configuration", "PebbleEngine", "Pebble", "Handlebars")
WIRE_METHODS = ("executeCommand", "execute", "dispatch", "send", "publish", "command", "run")
WIRE_PACKAGES = r"redis\.clients\.jedis|io\.lettuce|org\.springframework\.data\.(?:redis|mongodb)|org\.springframework\.amqp|com\.rabbitmq|org\.apache\.kafka|org\.eclipse\.paho"


@dataclass(frozen=True)
class Clear:
    """What a stage drops. line: a pattern of the sink's line; unless: one that keeps it; above: two patterns that a line of the six above matches
    both; needs and never: patterns of the file's lines; path: of the file's name; classes and other_classes: of the sink's class."""

    name: str
    languages: tuple[str, ...]
    types: tuple[str, ...]
    line: str = ""
    methods: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    class_pattern: str = ""
    unless: str = ""
    above: tuple[str, str] | None = None
    needs: str = ""
    never: str = ""
    path: str = ""


_IF = r"\bif\s*\("
_CHECK = r"\b(?:includes|startsWith|endsWith|indexOf|test|match)\s*\("
_CHECK_OR_HAS = r"\b(?:includes|startsWith|endsWith|indexOf|test|match|has)\s*\("
ABOVE = 6
CLEARS = [
    Clear("python-xpath-bound", ("python",), ("xpath_injection",), r"\.xpath\s*\([^)]*,\s*\w+\s*=\s*\w+"),
    Clear("python-xpath-escaped", ("python",), ("xpath_injection",), r"""\.replace\(\s*['"](?:\\?'|")['"]\s*,\s*['"]&(?:apos|quot);['"]"""),
    Clear("js-safe-attribute", JS, ("xss",), r"""\bsetAttribute\s*\(\s*['"](?!on\w|style['"]|srcdoc['"])[\w-]+['"]""", methods=("setAttribute",)),
    Clear("js-xss-cleaned", JS, ("xss",), r"\b(?:DOMPurify\s*\.\s*sanitize|sanitizeHtml|escapeHtml|escapeHTML|he\s*\.\s*encode|encodeURIComponent|encodeURI|createSafeHTML)\s*\("),
    Clear("js-xss-literal", JS, ("xss",), r"""=\s*(?:"[^"]*"|'[^']*'|`[^`$]*`)\s*;?\s*$"""),
    Clear("js-xss-checked", JS, ("xss",), r"\.href\s*=|\blocation\s*=", above=(_IF, _CHECK)),
    Clear("js-redirect-checked", JS, ("open_redirect", "crlf", "header_injection"), above=(_IF, _CHECK_OR_HAS)),
    Clear("js-redirect-encoded", JS, ("open_redirect", "crlf", "header_injection"), r"\bencodeURI(?:Component)?\s*\("),
    Clear("js-header-literal", JS, ("crlf", "header_injection"), r"""\bsetHeader\s*\(\s*['"][^'"]+['"]\s*,\s*(?:'[^']*'|"[^"]*")\s*\)"""),
    Clear("js-cookie-crlf", JS, ("crlf",), methods=("cookie",)),
    Clear("java-data-parser", ("java",), ("code_injection", "xxe"), classes=DATA_PARSERS),
    Clear("java-other-parser", ("java",), ("code_injection",), class_pattern=r"^(?!(?:" + "|".join(EVALUATORS) + r")$)\w+Parser$"),
    Clear("java-compiled-template", ("java",), ("code_injection", "xss"), methods=("render", "process", "merge", "apply"), classes=COMPILED),
    Clear("java-named-template", ("java",), ("code_injection", "xss"), r"""\.\s*(?:render|process|merge|evaluate|apply|getTemplate)\s*\(\s*"[^"]*"\s*[,)]""", classes=ENGINES),
    Clear("java-literal-reflection", ("java",), ("code_injection",), r"""\.\s*(?:forName|loadClass|getMethod|getDeclaredMethod|getConstructor|getDeclaredConstructor|parseExpression)\s*\(\s*"[^"]*"\s*[,)]"""),
    Clear("java-plain-invoke", ("java",), ("code_injection",), r"\.\s*invoke\s*\(\s*\w+\s*\)", methods=("invoke",)),
    Clear("java-plain-new-instance", ("java",), ("code_injection",), r"\.\s*newInstance\s*\(\s*\)"),
    Clear("java-command-line-parser", ("java",), ("command_injection",), r"\bnew\s+CommandLine\s*\(", needs=r"^\s*import\s+picocli\b"),
    Clear("java-wire-protocol", ("java",), ("command_injection",), methods=WIRE_METHODS, needs=rf"^\s*(?:import|package)\s+(?:{WIRE_PACKAGES})", unless=r"\b(?:Runtime|ProcessBuilder|DefaultExecutor|Executor|Exec|Launcher|ProcStarter|ProcessExecutor|RuntimeUtil)\s*[.(]"),
    Clear("java-argument-list", ("java",), ("command_injection",), r"""\bnew\s+ProcessBuilder\s*\(\s*(?:Arrays\.asList\b|List\.of\b|Collections\.singletonList\b|new\s+ArrayList\b|new\s+String\s*\[\s*\]\s*\{|"[^"]*"\s*,)"""),
    Clear("java-throw", ("java",), ("sql_injection", "command_injection", "code_injection", "xss", "path_traversal", "log_injection", "ldap_injection", "xpath_injection", "ssrf", "open_redirect", "xxe"), r"^\s*throw\s+new\s+\w+(?:Exception|Error)\b[^;]*;\s*(?://.*|/\*.*)?$"),
    Clear("java-sql-placeholder", ("java",), ("sql_injection",), r"""\.\s*replaceAll\s*\(\s*"[^"]*"\s*,\s*"\?"\s*\)"""),
    Clear("java-other-body", ("java",), ("xss",), methods=("body",), never=r"text/html|TEXT_HTML"),
    Clear("js-entity-fetch", JS, ("ssrf",), r"(?<![\w.])(?!(?:window|self|globalThis|global)\s*\.)[A-Za-z_$][\w$]*(?:\s*\.\s*\w+)*\s*\.\s*fetch\s*\(", methods=("fetch",)),
    Clear("js-array-callback", JS, ("nosql_injection",), r"\.\s*(?:find|findIndex|filter|some|every|aggregate)\s*\(\s*(?:async\s+)?(?:function\b|\([\w\s,{}]*\)\s*=>|\w+\s*=>)"),
    Clear("js-query-builder", JS, ("sql_injection", "nosql_injection"), r"\(\s*\{\s*(?:where|select|include|data|orderBy|take|skip)\s*:"),
    Clear("js-browser-component", JS, ("ssrf",), needs=r"""['"]use client['"]|\buse(?:State|Effect)\s*\(|\bdocument\s*\.""", never=r"\bgetServerSideProps\b|\bNextApiRequest\b|\bexpress\s*\(|['\"]use server['\"]", path=r"\.[jt]sx$"),
    Clear("js-fixed-host", JS, ("ssrf",), r"""[`'"]https?://[A-Za-z0-9][\w.-]*(?::\d+)?/[^`'"]*(?:\$\{|['"]\s*\+)"""),
    Clear("js-log-stripped", JS, ("log_injection",), r"""\b(?:stripCrlf|stripCRLF|removeNewlines|sanitizeLogValue)\s*\(|\.replace\(\s*/(?:\[\s*\\r\s*\\n\s*\]|\\r\\n|\\n)/[gimsu]*\s*,"""),
    Clear("csharp-xml-hardened", ("csharp",), ("xxe",), needs=r"\bXmlResolver\s*=\s*null\b|\bDtdProcessing\s*=\s*(?:DtdProcessing\s*\.\s*)?(?:Prohibit|Ignore)\b"),
    Clear("csharp-encoded", ("csharp",), ("xss",), r"\b(?:HttpUtility|WebUtility|HtmlEncoder\s*\.\s*Default)\s*\.\s*(?:HtmlEncode|Encode|UrlEncode)\s*\("),
    Clear("python-ldap-escaped", ("python",), ("ldap_injection",), r"\b(?:escape_filter_chars|filter_format)\s*\("),
    Clear("python-xml-hardened", ("python",), ("xxe",), needs=r"\bXMLParser\s*\([^)]*\bresolve_entities\s*=\s*False\b"),
    Clear("python-sql-bound", ("python",), ("sql_injection",), r"""\.\s*execute(?:many)?\s*\(\s*(?:"[^"]*(?:\?|%s|:[A-Za-z_]\w*)[^"]*"|'[^']*(?:\?|%s|:[A-Za-z_]\w*)[^']*')\s*,"""),
]


def cleared(f: Facts, clears=CLEARS) -> DataFrame:
    """file, sink_ord, stage: the sinks that a stage drops, with the first that does."""
    file_patterns = sorted({p for c in clears for p in (c.needs, c.never) if p})
    at = {p: f"file_{i}" for i, p in enumerate(file_patterns)}
    look = sorted({c.above for c in clears if c.above})
    near = {p: f"above_{i}" for i, p in enumerate(look)}
    lines = f.source_lines
    w = Window.partitionBy("file").orderBy("line").rangeBetween(-ABOVE, 0)
    flagged = lines.withColumns({n: F.coalesce(F.bool_or(F.col("text").rlike(a) & F.col("text").rlike(b)).over(w), F.lit(False)) for (a, b), n in near.items()})
    of_file = lines.groupBy("file").agg(F.lit(True).alias("seen"), *[F.bool_or(F.col("text").rlike(p)).alias(n) for p, n in at.items()])
    s = f.taint_sinks.select("file", "sink_ord", "type", "line", "method", "class").join(f.files.select("file", "language"), "file")
    s = s.join(flagged, ["file", "line"], "left").join(of_file, "file", "left").withColumn("text", F.coalesce("text", F.lit("")))

    def hit(c: Clear) -> Column:
        parts = [F.col("language").isin(list(c.languages)), F.col("type").isin(list(c.types))]
        if c.line:
            parts.append(F.col("text").rlike(c.line))
        if c.methods:
            parts.append(F.col("method").isin(list(c.methods)))
        if c.classes:
            parts.append(F.col("class").isin(list(c.classes)))
        if c.class_pattern:
            parts.append(F.col("class").rlike(c.class_pattern))
        if c.unless:
            parts.append(~F.col("text").rlike(c.unless))
        if c.above:
            parts.append(F.col(near[c.above]))
        if c.needs:
            parts.append(F.col(at[c.needs]))
        if c.never:
            parts.append(~F.col(at[c.never]))
        if c.path:
            parts.append(F.col("file").rlike(c.path))
        return F.when(F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False)), F.lit(c.name))

    return s.withColumn("stage", F.coalesce(*map(hit, clears))).where("stage is not null").select("file", "sink_ord", "stage")


def kept_sinks(f: Facts, clears=CLEARS) -> Facts:
    """The facts without the sinks that a stage drops."""
    gone = cleared(f, clears).select("file", "sink_ord")
    return f.with_tables(taint_sinks=f.taint_sinks.join(gone, ["file", "sink_ord"], "left_anti").select(*f.taint_sinks.columns))
