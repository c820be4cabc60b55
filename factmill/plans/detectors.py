"""Detectors that read lines: texts from outside that reach a sink, and guards that clear the lines behind them.

A flow is a row of a table: where it looks, what counts as outside text, what the sink's argument is, and what clears it. Tainted variables
come from one fold over a file's assignments in line order, so a detector needs no fixpoint: an assignment taints its variable
if its right side holds outside text or a variable that is tainted by then. A guard is a row as well: a pattern, whether its body must leave the
function, and whether it clears its own line, all lines behind it, or those that name the variable it checks. Only the first guard of a kind
(and variable) matters to the lines behind, so no line meets more than one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import identifiers
from ..operators import joins
from .findings import findings
from .registry import register

JS = ("javascript", "typescript")

# What comes from outside, by kind; and the languages it is looked for in.
OUTSIDE = {
    "js-request": (JS, r"\breq(?:uest)?\s*\.\s*(?:query|body|params|headers|cookies)\b"),
    "js-body": (JS, r"\breq\s*\.\s*body\b"),
    "js-browser": (JS, r"\b(?:location\s*\.\s*(?:search|hash|href|pathname)|document\s*\.\s*(?:URL|documentURI|referrer|cookie)|window\s*\.\s*name|URLSearchParams)\b"),
    "js-env": (JS, r"\bprocess\s*\.\s*env\s*\.\s*\w*(?:KEY|TOKEN|SECRET|PASSWORD)\w*"),
    "python-request": (("python",), r"\brequest\s*\.\s*(?:args|form|values|json|get_json|files|cookies|headers|data)\b|\binput\s*\(|\bsys\s*\.\s*argv\b"),
    "python-env": (("python",), r"\bos\s*\.\s*(?:environ\b|getenv\s*\()"),
    "go-request": (("go",), r"\b\w+\s*\.\s*(?:URL\s*\.\s*Query\s*\(\s*\)|Form\b|PostForm\b|FormValue\s*\(|PostFormValue\s*\(|Header\s*\.\s*Get\s*\(|Cookie\s*\(|Body\b)"),
    "go-argv": (("go",), r"\bos\s*\.\s*Args\b"),
    "go-env": (("go",), r"\bos\s*\.\s*Getenv\s*\("),
    "java-request": (("java",), r"\b\w+\s*\.\s*(?:getParameter|getHeader|getQueryString|getCookies|getInputStream|getReader|getPathInfo)\s*\("),
    "rust-extractor": (("rust",), r"\b(?:\w+\s*::\s*)*(?:Query|Path|Form|Json)\s*<|\benv\s*::\s*args\s*\("),
    "csharp-request": (("csharp",), r"\bRequest\s*\.\s*(?:Query|Form|Headers|Cookies|QueryString|Params)\b|\bConsole\s*\.\s*ReadLine\s*\(|\bEnvironment\s*\.\s*GetEnvironmentVariables?\s*\("),
    "bash-argument": (("bash",), r"\$\{?[1-9@*]"),
}
#: What a source of a kind is called in taint_sources.
SOURCE_TYPES = {"js-request": "http_param", "js-body": "http_body", "js-browser": "dom_input", "js-env": "env_input", "python-request": "http_param", "python-env": "env_input", "go-request": "http_param", "go-argv": "io_input", "go-env": "env_input", "java-request": "http_param", "rust-extractor": "http_param", "csharp-request": "http_param", "bash-argument": "io_input"}

_ASSIGNED = r"^\s*(?:(?:const|let|var|final|mut|auto|local|export|readonly|my|declare)\s+)*(?:[A-Za-z_][\w.<>\[\],]*\s+)?([A-Za-z_$][\w$]*)(?:\s*,\s*[A-Za-z_]\w*)?\s*(?::\s*[^=:]+)?\s*:?=(?![=>])\s*(.+)$"
_RANGED = r"\bfor\b[^;{]*?,\s*([A-Za-z_]\w*)\s*:?=\s*range\s+(.+?)\s*\{?\s*$"
_EXTRACTED = r"\bfn\s+\w+\s*\(.*?\b([A-Za-z_]\w*)\s*:\s*((?:\w+\s*::\s*)*(?:Query|Path|Form|Json)\s*<)"
_LITERAL = r"""^\s*(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`$]*`|-?[\d.]+)\s*$"""
_COMMENT = r"^\s*(?://|#(?!\[)|\*|/\*)"


def assignments(f: Facts) -> DataFrame:
    """file, line, variable, right, kinds (of outside text on the right side), names (identifiers on it)."""
    t = f.source_lines.where(~F.col("text").rlike(_COMMENT)).join(f.files.select("file", "language"), "file")
    found = F.array(*[F.struct(F.regexp_extract("text", p, 1).alias("variable"), F.regexp_extract("text", p, 2).alias("right")) for p in (_ASSIGNED, _RANGED, _EXTRACTED)])
    t = t.withColumn("a", F.explode(F.filter(found, lambda x: ~x["variable"].isin("", "_")))).select("file", "line", "language", "a.variable", "a.right")
    kinds = F.array(*[F.when(F.col("language").isin(list(langs)) & F.col("right").rlike(p), F.lit(k)) for k, (langs, p) in OUTSIDE.items()])
    return t.withColumn("kinds", F.array_compact(kinds)).withColumn("names", identifiers("right"))


def assignment_sources(f: Facts) -> DataFrame:
    """taint_sources rows for assignments of outside text."""
    a = assignments(f).withColumn("kind", F.explode("kinds"))
    w = Window.partitionBy("file").orderBy("line", "kind", "variable")
    kind = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    return a.select("file", (F.row_number().over(w) - 1).cast("int").alias("src_ord"), F.element_at(kind, F.col("kind")).alias("type"), F.col("right").alias("location"), F.lit("high").alias("severity"), "line", F.lit(0.9).alias("confidence"), "variable")


def tainted_variables(f: Facts) -> DataFrame:
    """file, kind, variable, since: the line from which the variable holds outside text of the kind."""
    of_file = assignments(f).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "variable", "kinds", "names"))).alias("a"))

    def step(state: Column, a: Column) -> Column:
        carried = F.transform(F.filter(state, lambda s: F.array_contains(a["names"], s["variable"])), lambda s: s["kind"])
        has = F.transform(F.filter(state, lambda s: s["variable"] == a["variable"]), lambda s: s["kind"])
        new = F.array_except(F.array_union(a["kinds"], carried), has)
        return F.concat(state, F.transform(new, lambda k: F.struct(k.alias("kind"), a["variable"].alias("variable"), a["line"].alias("since"))))

    none = F.array().cast("array<struct<kind:string,variable:string,since:int>>")
    return of_file.select("file", F.explode(F.aggregate("a", none, step)).alias("t")).select("file", "t.*")


@dataclass(frozen=True)
class Flow:
    """A finding where the sink's argument (group 1) holds outside text of the kind; without a kind, where it is more than a literal.

    needs: patterns each of which some line of the file matches. never: a pattern that no line matches. safe: what clears an argument.
    """

    name: str
    rule: str
    cwe: str
    severity: str
    languages: tuple[str, ...]
    sink: str
    kind: str = ""
    needs: tuple[str, ...] = ()
    never: str = ""
    safe: str = ""


_GO_HANDLER = r"\*\s*http\.Request\b|\bhttp\.(?:HandlerFunc|ResponseWriter)\b"
_MONGO = "find|findOne|updateOne|updateMany|deleteOne|deleteMany|aggregate|countDocuments|replaceOne|findOneAndUpdate|findOneAndDelete|findOneAndReplace|distinct"
_FAR = r"https?://(?!localhost|127\.|10\.|192\.168\.)"
FLOWS = [
    # markup
    Flow("go-response-xss", "xss", "CWE-79", "high", ("go",), r"\b(?:fmt\.Fprint(?:f|ln)?\(\s*\w+\s*,|io\.WriteString\(\s*\w+\s*,|\w+\.Write\(\[\]byte\()\s*(.+)\)", needs=(r"\bhttp\.ResponseWriter\b",), safe=r"EscapeString|HTMLEscape|QueryEscape|PathEscape"),
    Flow("java-response-xss", "xss", "CWE-79", "high", ("java",), r"\.\s*getWriter\s*\(\s*\)\s*\.\s*(?:print|println|write|printf|append|format)\s*\((.+)\)", needs=(r"\bHttpServletResponse\b",), safe=r"(?i)encodeForHtml|escapeHtml|htmlEscape|Encode\.forHtml|sanitize"),
    Flow("angular-bypass-xss", "xss", "CWE-79", "high", ("typescript",), r"\bbypassSecurityTrust(?:Html|Script|Style|Url|ResourceUrl)\s*\(\s*([^)]+)\)"),
    Flow("flask-concat-xss", "xss", "CWE-79", "high", ("python",), r"""^\s*return\s+(.*(?:['"]\s*\+|\+\s*['"]|\bf['"][^{]*\{|['"]\s*%\s|['"]\.format\().*)$""", "python-request", (r"@\s*\w+\s*\.\s*route\s*\(",), safe=r"\b(?:escape|clean|quote)\s*\("),
    Flow("jinja-markup-xss", "xss", "CWE-79", "high", ("python",), r"\bMarkup\s*\(\s*([^)]+)\)", needs=(r"^\s*(?:from|import)\s.*\b(?:markupsafe|jinja2|flask)\b", r"\.\s*render\w*\s*\("), never=r"^\s*class\s+Markup\b", safe=r"\bescape\s*\("),
    Flow("dom-sink-xss", "xss", "CWE-79", "high", JS, r"(?:\.\s*(?:innerHTML|outerHTML)\s*=(?!=)|\bdocument\s*\.\s*write(?:ln)?\s*\(|\.\s*insertAdjacentHTML\s*\([^,]+,)\s*([^;]+)", "js-browser", safe=r"(?i)sanitize|encodeURIComponent|escape"),
    # redirects and headers
    Flow("go-location-redirect", "open_redirect", "CWE-601", "high", ("go",), r"""\.\s*Header\s*\(\s*\)\s*\.\s*(?:Set|Add)\s*\(\s*"Location"\s*,\s*(.+)\)""", needs=(r"\bhttp\.ResponseWriter\b",), safe=r"\burl\s*\.\s*(?:QueryEscape|PathEscape)\s*\("),
    Flow("python-location-redirect", "open_redirect", "CWE-601", "high", ("python",), r"""\.\s*headers\s*\[\s*['"]Location['"]\s*\]\s*=(?!=)\s*(.+)$""", "python-request", safe=r"\b(?:url_for|quote|quote_plus|urlencode)\s*\("),
    Flow("rust-location-redirect", "open_redirect", "CWE-601", "high", ("rust",), r"""\.\s*(?:append_header|insert_header)\s*\(\s*\(\s*(?:"Location"|(?:\w+::)*LOCATION)\s*,\s*(.+?)\)\s*\)""", "rust-extractor", safe=r"(?i)encode\w*\s*\("),
    Flow("dom-redirect", "open_redirect", "CWE-601", "high", JS, r"\blocation(?:\s*\.\s*href)?\s*(?:=(?!=)|\.\s*(?:assign|replace)\s*\()\s*([^;]+)", "js-browser", safe=r"\bencodeURIComponent\s*\("),
    Flow("python-header-crlf", "crlf", "CWE-113", "medium", ("python",), r"""\.\s*headers\s*\[\s*['"](?!Location['"])[^'"]+['"]\s*\]\s*=(?!=)\s*(.+)$""", "python-request", safe=r"""\.\s*replace\s*\(\s*['"]\\[rn]|\bquote\s*\("""),
    # code
    Flow("go-plugin-open", "code_injection", "CWE-94", "critical", ("go",), r"\bplugin\s*\.\s*(?:Open|Lookup)\s*\(\s*([^)]*)\)", "go-request", (r"\*\s*http\.Request\b",)),
    Flow("js-indirect-eval", "code_injection", "CWE-94", "critical", JS, r"(?:\(\s*0\s*,\s*eval\s*\)|\b(?:globalThis|window|global)\s*\.\s*eval)\s*\(\s*([^)]*)\)", "js-request"),
    Flow("python-interpreter", "code_injection", "CWE-94", "critical", ("python",), r"\bcode\s*\.\s*(?:Interactive(?:Interpreter|Console)\s*\([^)]*\)\s*\.\s*(?:runcode|runsource|push)|compile_command)\s*\(\s*([^),]+)", "python-request", (r"^\s*import\s+code\b",)),
    Flow("rust-eval-crate", "code_injection", "CWE-94", "critical", ("rust",), r"\b(?:evalexpr\s*::\s*eval\w*|libloading\s*::\s*Library\s*::\s*new)\s*\(\s*([^)]*)\)", "rust-extractor"),
    Flow("python-reflection", "unsafe_reflection", "CWE-470", "high", ("python",), r"\b(?:getattr\s*\(\s*\w+\s*,|import_module\s*\()\s*([^,)]+)", "python-request"),
    Flow("python-jinja-ssti", "template_injection", "CWE-1336", "critical", ("python",), r"\b(?:jinja2\s*\.\s*)?Template\s*\(\s*([^)]+?)\s*\)", "python-request", (r"\bfrom\s+jinja2\s+import\b.*\bTemplate\b|\bjinja2\s*\.\s*Template\b",)),
    Flow("js-template-ssti", "template_injection", "CWE-1336", "critical", JS, r"\b(?:Handlebars\s*\.\s*compile|ejs\s*\.\s*(?:render|compile))\s*\(\s*([^,)]+)", "js-request"),
    # queries
    Flow("go-mongo-nosql", "nosql_injection", "CWE-943", "critical", ("go",), rf"(?i)\.\s*(?:{_MONGO})\s*\((.+)\)", "go-request", (r"\bbson\s*\.\s*[MDAE]\b|mongo-driver|\*\s*mongo\.Collection", r"\*\s*http\.Request\b")),
    Flow("java-mongo-nosql", "nosql_injection", "CWE-943", "critical", ("java",), rf"\.\s*(?:{_MONGO})\s*\((.+)\)", "java-request", (r"\bMongoCollection\b|\bcom\.mongodb\b|\bFilters\b|\bnew\s+Document\s*\(",)),
    Flow("python-where-nosql", "nosql_injection", "CWE-943", "critical", ("python",), r"""['"]\$where['"]\s*:\s*([^,}\n]+)""", "python-request"),
    Flow("js-ldap", "ldap_injection", "CWE-90", "critical", JS, r"\bfilter\s*:\s*([^,}\n]+)", "js-request", (r"\bldap(?:js|ts)\b", r"\.\s*search\s*\("), safe=r"(?i)escape"),
    Flow("go-ldap", "ldap_injection", "CWE-90", "critical", ("go",), r"\bldap\s*\.\s*NewSearchRequest\s*\((.+)", "go-request", safe=r"\bEscapeFilter\s*\("),
    Flow("rust-ldap", "ldap_injection", "CWE-90", "critical", ("rust",), r"\.\s*search\s*\((.+)\)", "rust-extractor", (r"\b(?:ldap3|LdapConn|Ldap)\b",), safe=r"\bldap_escape\s*\("),
    Flow("dom-xpath", "xpath_injection", "CWE-643", "high", JS, r"\.\s*evaluate\s*\(\s*([^,)]+)", "js-browser", (r"\bXPathResult\b",)),
    # requests, formats, logs, objects
    Flow("java-url-stream-ssrf", "ssrf", "CWE-918", "critical", ("java",), r"^(.+)\.\s*(?:openStream|openConnection|getContent)\s*\(", "java-request", (r"\bnew\s+URL\s*\(|\bURI\s*\.\s*create\s*\(",), never=r"\.\s*contains\s*\(\s*\w+\s*\.\s*getHost\s*\(|\.\s*equals\s*\(\s*\w+\s*\.\s*getHost\s*\(|\bgetHost\s*\(\s*\)\s*\.\s*equals"),
    Flow("python-format-string", "format_string", "CWE-134", "high", ("python",), r"""(?:^|[^\w"'.])([A-Za-z_]\w*)\s*(?:%\s*[(\[{"'\w]|\.\s*format(?:_map)?\s*\()""", "python-request"),
    Flow("js-format-string", "format_string", "CWE-134", "medium", JS, r"\butil\s*\.\s*format\s*\(\s*([\w.]+)\s*[,)]", "js-request"),
    Flow("rust-log", "log_injection", "CWE-117", "medium", ("rust",), r"\b(?:info|warn|error|debug|trace)\s*!\s*\(\s*(.+)\)", "rust-extractor", (r"\b(?:log|tracing)\b",)),
    Flow("go-gob", "insecure_deserialization", "CWE-502", "critical", ("go",), r"\bgob\s*\.\s*NewDecoder\s*\(\s*([^)]*)\)", "go-request", (_GO_HANDLER,)),
    Flow("js-json-body", "insecure_deserialization", "CWE-502", "high", JS, r"\bJSON\s*\.\s*parse\s*\(\s*([^)]+?)\s*\)", "js-body"),
    Flow("go-xml-body", "xml_entity_expansion", "CWE-611", "high", ("go",), r"\bxml\s*\.\s*NewDecoder\s*\(\s*([^)]*)\)", "go-request", (_GO_HANDLER,)),
    Flow("python-trust-boundary", "trust_boundary", "CWE-501", "medium", ("python",), r"\bsession\s*\[[^\]]*\]\s*=(?!=)\s*(.+)$", "python-request"),
    # secrets that leave
    Flow("python-secret-exfiltration", "external_secret_exfiltration", "CWE-200", "high", ("python",), rf"""\brequests\s*\.\s*(?:get|post|put)\s*\(\s*['"]{_FAR}[^'"]+['"]\s*,(.+)\)""", "python-env"),
    Flow("js-secret-exfiltration", "external_secret_exfiltration", "CWE-200", "high", JS, rf"""\b(?:fetch|axios\s*\.\s*(?:get|post|put))\s*\(\s*['"`]{_FAR}[^'"`]+['"`]\s*,(.+)\)""", "js-env"),
    Flow("go-secret-exfiltration", "external_secret_exfiltration", "CWE-200", "high", ("go",), rf"""\bhttp\s*\.\s*(?:Post|PostForm)\s*\(\s*"{_FAR}[^"]+"\s*,(.+)\)""", "go-env"),
]


def _file_flags(f: Facts, patterns: dict[str, set[str]]) -> tuple[DataFrame, dict[str, str]]:
    """A row for each file that says which patterns a line of it matches; and the patterns' columns. patterns: each with the languages that ask for it."""
    at = {p: f"flag_{i}" for i, p in enumerate(sorted(patterns))}
    lines = f.source_lines.select("file", "text").join(f.files.select("file", "language"), "file")
    said = [F.bool_or(F.col("language").isin(sorted(patterns[p])) & F.col("text").rlike(p)).alias(n) for p, n in at.items()]
    return lines.groupBy("file").agg(F.lit(True).alias("seen"), *said), at


def _asked(rows) -> dict[str, set[str]]:
    """(pattern, languages) pairs by pattern."""
    out: dict[str, set[str]] = {}
    for pattern, languages in rows:
        if pattern:
            out.setdefault(pattern, set()).update(languages)
    return out


def flow_findings(f: Facts, flows=FLOWS) -> DataFrame:
    """All flows in one pass over the lines; the sinks of a line are an array that is exploded, and only these meet the tainted variables."""
    flags, at = _file_flags(f, _asked((p, r.languages) for r in flows for p in (*r.needs, r.never)))
    t = f.source_lines.where(~F.col("text").rlike(_COMMENT)).join(f.files.select("file", "language"), "file").join(flags, "file")

    def hit(r: Flow) -> Column:
        arg = F.regexp_extract("text", r.sink, 1)
        c = F.col("language").isin(list(r.languages)) & (arg != "") & ~arg.rlike(_LITERAL)
        for p in r.needs:
            c = c & F.col(at[p])
        if r.never:
            c = c & ~F.col(at[r.never])
        if r.safe:
            c = c & ~arg.rlike(r.safe)
        if r.kind:
            direct = arg.rlike(OUTSIDE[r.kind][1])
        else:
            direct = F.regexp_replace(arg, r""""[^"]*"|'[^']*'|`[^`]*`""", "").rlike(r"[A-Za-z_]")
            c = c & direct
        return F.when(c, F.struct(F.lit(r.name).alias("name"), F.lit(r.rule).alias("rule"), F.lit(r.cwe).alias("cwe"), F.lit(r.severity).alias("severity"), F.lit(r.kind).alias("kind"), arg.alias("arg"), direct.alias("direct")))

    sinks = t.withColumn("hit", F.explode(F.array_compact(F.array(*map(hit, flows))))).select("file", "line", "text", "hit.*")
    direct = sinks.where("direct").withColumn("variable", F.lit(None).cast("string"))
    named = sinks.where("not direct").withColumn("variable", F.explode(identifiers("arg")))
    through = named.join(tainted_variables(f), ["file", "kind", "variable"]).where("since < line")
    through = joins.first_match(through, ["file", "line", "name"], ["since", "variable"]).drop("since")
    every = direct.unionByName(through)
    level = F.when(F.col("severity") == "medium", "warning").otherwise("error")
    what = F.concat(F.lit("Text from outside"), F.coalesce(F.concat(F.lit(" in '"), "variable", F.lit("'")), F.lit("")), F.lit(" reaches a sink: "), "name")
    out = findings(every, "flow", "security", F.col("cwe"), F.col("severity"), level, what, snippet=F.trim("text"), evidence={"detector": "name", "rule": "rule", "variable": "variable"})
    told = F.get_json_object("evidence", "$.rule")
    name = F.get_json_object("evidence", "$.detector")
    return out.withColumn("rule_id", told).withColumn("pass", name).withColumn("id", F.concat(name, F.lit("-"), "file", F.lit("-"), F.col("line").cast("string")))


@register("line-flows", "security")
def line_flows(f: Facts) -> DataFrame:
    """The findings of all flows."""
    return flow_findings(f)


@dataclass(frozen=True)
class Guard:
    """Lines that clear others. scope: "line" (itself), "after" (all behind its body) or "variable" (those behind that name group 1).

    allowlist: group 2 must name one. leaves: the guard's line or body must have a word that leaves the function.
    """

    name: str
    language: str
    pattern: str
    sanitizes: tuple[str, ...]
    scope: str = "line"
    allowlist: bool = False
    leaves: bool = False
    needs: str = ""
    never: str = ""
    unless: str = ""


# Names of allowlists, and what leaves a function.
ALLOWLIST = r"^(?:[A-Z][A-Z0-9_]+|.*(?i:allowed|accepted|whitelist|permitted|valid|approved|allowlist).*)$"
LEAVES = r"\b(?:return|raise|throw|abort\s*\(|sys\.exit\s*\(|panic!?\s*\(|os\.Exit\s*\(|Err\s*\(|exit|die)|HttpResponse::(?:Forbidden|BadRequest|Unauthorized|NotFound)"
#: Lines that a guard's body may have.
BODY = 25
_SHELL = r"""['"](?:/bin/)?(?:sh|bash|cmd|cmd\.exe|powershell)['"]|\bshell\s*:\s*true"""
_ESCAPE = "external_taint_escape"
GUARDS = [
    Guard("java_safe_json_parse", "java", r"\.(?:readValue|fromJson)\s*\(", (_ESCAPE,)),
    Guard("js_safe_json_parse", "javascript", r"\bJSON\.parse\s*\(", (_ESCAPE,)),
    Guard("js_crypto_hash", "javascript", r"\b(?:bcrypt|argon2)\s*\.\s*hash(?:Sync)?\s*\(|\bcrypto\s*\.\s*(?:scrypt(?:Sync)?|createHash)\s*\(|\.digest\s*\(", (_ESCAPE,)),
    Guard("js_csv_formula_prefix", "javascript", r"""`'\$\{|["']\\?'["']\s*\+\s*[A-Za-z_]""", (_ESCAPE,)),
    Guard("js_argv_form_exec", "javascript", r"""\b(?:execFile|spawn)(?:Sync)?\s*\(\s*['"][\w./-]+['"]\s*,\s*\[""", ("command_injection", _ESCAPE), unless=_SHELL),
    Guard("js_parameterized_sql", "javascript", r"""\.\s*(?:query|execute)\s*\(\s*(?:"[^"]*(?:\$\d+|\?)[^"]*"|'[^']*(?:\$\d+|\?)[^']*'|`(?:(?!\$\{)[^`])*(?:\$\d+|\?)(?:(?!\$\{)[^`])*`)\s*,\s*\[""", ("sql_injection", _ESCAPE)),
    Guard("java_inline_crlf_strip_log", "java", r"""\b(?i:log|logger)\s*\.\s*(?:info|warn|error|debug|trace)\s*\(.*\.replace(?:All)?\s*\(\s*["'](?:\[?\\\\?[rn])""", ("log_injection", _ESCAPE)),
    Guard("java_argv_form_exec", "java", r"""\bnew\s+ProcessBuilder\s*\(\s*"[^"]+"\s*,|\.exec\s*\(\s*new\s+String\s*\[\s*\]\s*\{""", ("command_injection", _ESCAPE), unless=_SHELL),
    Guard("rust_argv_command", "rust", r"""\bCommand\s*::\s*new\s*\(\s*"[^"]+"\s*\)\s*\.\s*args?\s*\(""", ("command_injection", _ESCAPE), unless=_SHELL),
    Guard("go_html_template", "go", r"\.(?:Execute|ExecuteTemplate)\s*\(", ("xss", _ESCAPE, "open_redirect"), needs=r"""["\s]html/template["\s]?""", never=r"""["\s]text/template["\s]?"""),
    Guard("python_jinja_autoescape", "python", r"\.\s*render\s*\(", ("xss", _ESCAPE), needs=r"\bautoescape\s*=\s*(?!False\b|None\b|0\b)"),
    Guard("python_defusedxml", "python", r"(?<!import)\b\w+\s*\.\s*(?:parse|fromstring|iterparse|parseString|XML)\s*\(", ("xxe", _ESCAPE), needs=r"^\s*(?:import|from)\s+defusedxml\b"),
    Guard("python_default_sax_parser", "python", r"\b(?:minidom\.)?parseString\s*\(|\bparse\s*\(", ("xxe",), needs=r"\bmake_parser\s*\(", never=r"feature_external_(?:ges|pes)\s*,\s*(?:True|1)|setEntityResolver"),
    Guard("bash_shell_quote", "bash", r"""\$\(\s*printf\s+['"]%q['"]\s+["']?\$|\$\{[A-Za-z_]\w*@Q\}""", ("command_injection", "code_injection"), "after"),
    Guard("bash_regex_allowlist", "bash", r"""^\s*if\s+\[\[\s*!\s*"?\$\{?(\w+)\}?"?\s*=~\s*\^(?:\[[^\]]+\][+*?]?|[A-Za-z0-9_./-])+\$\s*\]\]\s*;\s*then\b""", ("command_injection", "path_traversal", "sql_injection", "code_injection", "ssrf", "xss", "open_redirect", "log_injection"), "after", leaves=True),
    Guard("go_map_allowlist", "go", r"^\s*if\s+!\s*()([A-Za-z_]\w*)\s*\[\s*[A-Za-z_]\w*\s*\]\s*\{", ("ssrf", "open_redirect", "path_traversal", "sql_injection", "command_injection", _ESCAPE), "after", allowlist=True, leaves=True),
    Guard("python_netloc_allowlist", "python", r"^\s*if\s+()\S.*\s+not\s+in\s+([A-Za-z_]\w*)\s*:\s*$", ("open_redirect", "ssrf", "path_traversal", _ESCAPE), "after", allowlist=True, leaves=True),
    Guard("python_range_check", "python", r"^\s*if\s+([A-Za-z_]\w*)\s*[<>]=?\s*(?:-?\d+\.?\d*|[A-Z][A-Z0-9_]+)\s*(?:(?:or|and)\s+\1\s*[<>]=?\s*(?:-?\d+\.?\d*|[A-Z][A-Z0-9_]+)\s*)?:\s*$", ("xss", _ESCAPE), "after", leaves=True),
    Guard("rust_set_allowlist", "rust", r"^\s*if\s+!\s*()([A-Za-z_]\w*)\s*\.\s*(?:contains|contains_key)\s*\(", ("ssrf", "open_redirect", "command_injection", _ESCAPE), "after", allowlist=True, leaves=True),
    Guard("rust_canonicalize", "rust", r"^\s*if\s+!\s*[A-Za-z_][\w?.()&]*\.starts_with\s*\(", ("path_traversal", "xss", "ssrf", _ESCAPE), "after", leaves=True),
    Guard("python_set_membership_xss", "python", r"^\s*if\s+([A-Za-z_]\w*)\s+not\s+in\s+([A-Za-z_]\w*)\s*:\s*$", ("xss", _ESCAPE), "variable", allowlist=True, leaves=True),
    Guard("python_traversal_reject", "python", r"""^\s*if\s+['"]\.\.(?:/)?['"]\s+in\s+([A-Za-z_]\w*)\b.*:\s*$""", ("path_traversal",), "variable", leaves=True),
    Guard("python_url_allowlist", "python", r"""^\s*if\s+not\s+([A-Za-z_]\w*)\s*\.\s*startswith\s*\(\s*(?:\(|['"]|[A-Z_]+).*\)\s*:\s*$""", ("open_redirect",), "variable", leaves=True),
    Guard("js_ssrf_allowlist", "javascript", r"\bif\s*\(\s*!\s*(?=([A-Za-z_]\w*)\s*\.\s*(?:has|includes)\s*\(\s*([A-Za-z_]\w*))\1\s*\.\s*(?:has|includes)\s*\(\s*\2(?:\s*\.\s*host(?:name)?)?\s*\)\s*\)", ("ssrf", _ESCAPE), "variable", allowlist=True, leaves=True),
    Guard("js_command_allowlist", "javascript", r"\bif\s*\(\s*!\s*(?=([A-Za-z_]\w*)\s*\.\s*(?:has|includes)\s*\(\s*([A-Za-z_]\w*))\1\s*\.\s*(?:has|includes)\s*\(\s*\2\s*\)\s*\)", ("command_injection", _ESCAPE), "variable", allowlist=True, leaves=True),
    Guard("js_path_startswith", "javascript", r"\bif\s*\(\s*!\s*([A-Za-z_]\w*)\s*\.\s*startsWith\s*\(", ("path_traversal", _ESCAPE), "variable", leaves=True, needs=r"\bpath\s*\.\s*(?:resolve|join|normalize)\s*\("),
    Guard("java_normalize_startswith", "java", r"\bif\s*\(\s*!\s*([A-Za-z_]\w*)\s*\.\s*startsWith\s*\(", ("path_traversal", _ESCAPE), "variable", leaves=True, needs=r"\.\s*normalize\s*\(\s*\)"),
    Guard("java_canonical_startswith", "java", r"\bif\s*\(\s*!\s*([A-Za-z_]\w*)(?:\s*\.\s*getCanonicalPath\s*\(\s*\))?\s*\.\s*startsWith\s*\(", ("path_traversal", _ESCAPE), "variable", leaves=True, needs=r"\bgetCanonicalPath\s*\("),
    Guard("java_path_get_filename", "java", r"\b([A-Za-z_]\w*)\s*=(?!=).*(?:\b(?:Paths\s*\.\s*get|Path\s*\.\s*of)\s*\(.*\.\s*getFileName\s*\(\s*\)|\bnew\s+File\s*\(.*\)\s*\.\s*getName\s*\(\s*\))", ("path_traversal", _ESCAPE), "variable"),
]
#: Guards whose pattern names the allowlist first and the variable second.
_LIST_FIRST = {"js_ssrf_allowlist", "js_command_allowlist"}


def guard_lines(f: Facts, guards=GUARDS) -> DataFrame:
    """file, line, name, scope, sanitizes, variable, behind (the last line of the guard's body) of all guards that hold."""
    flags, at = _file_flags(f, _asked((p, JS if g.language == "javascript" else (g.language,)) for g in guards for p in (g.needs, g.never)))
    t = f.source_lines.where(~F.col("text").rlike(_COMMENT)).join(f.files.select("file", F.when(F.col("language") == "typescript", "javascript").otherwise(F.col("language")).alias("language")), "file").join(flags, "file")

    def hit(g: Guard) -> Column:
        c = (F.col("language") == g.language) & F.col("text").rlike(g.pattern)
        first, second = (F.regexp_extract("text", g.pattern, i) if g.scope == "variable" or g.allowlist and i == 2 else F.lit("") for i in (1, 2 if g.allowlist else 0))
        variable, listed = (second, first) if g.name in _LIST_FIRST else (first, second)
        if g.allowlist:
            c = c & listed.rlike(ALLOWLIST)
        if g.needs:
            c = c & F.col(at[g.needs])
        if g.never:
            c = c & ~F.col(at[g.never])
        if g.unless:
            c = c & ~F.col("text").rlike(g.unless)
        return F.when(c, F.struct(F.lit(g.name).alias("name"), F.lit(g.scope).alias("scope"), F.lit(g.leaves).alias("leaves"), F.array(*map(F.lit, g.sanitizes)).alias("sanitizes"), variable.alias("variable")))

    found = t.withColumn("hit", F.explode(F.array_compact(F.array(*map(hit, guards))))).select("file", "line", "text", "language", "hit.*")
    plain = found.where("not leaves").withColumn("behind", F.col("line"))
    body = _bodies(f, found.where("leaves"))
    return plain.unionByName(body).drop("text", "language", "leaves")


def _bodies(f: Facts, guards: DataFrame) -> DataFrame:
    """Guards whose line or body leaves the function, with the body's last line: where braces balance, or before less indentation in Python."""
    lines = f.source_lines.select("file", F.col("line").alias("at"), F.col("text").alias("own"))
    key = ["file", "line", "name"]
    b = guards.join(lines, "file").where((F.col("at") >= F.col("line")) & (F.col("at") <= F.col("line") + BODY))
    depth = lambda c: F.length(c) - F.length(F.regexp_replace(c, "[{]", "")) - F.length(c) + F.length(F.regexp_replace(c, "[}]", ""))
    indent = lambda c: F.length(F.regexp_extract(c, r"^\s*", 0))
    w = Window.partitionBy(*key).orderBy("at")
    b = b.withColumn("depth", F.sum(depth(F.col("own"))).over(w))
    dedent = (F.col("at") > F.col("line")) & (F.trim("own") != "") & (indent(F.col("own")) <= indent(F.col("text")))
    fi = (F.col("at") > F.col("line")) & F.col("own").rlike(r"^\s*fi\b")
    end = F.when(F.col("language") == "python", F.when(dedent, F.col("at") - 1)).when(F.col("language") == "bash", F.when(fi | ((F.col("at") == F.col("line")) & F.col("own").rlike(r"\bfi\s*$")), F.col("at"))).otherwise(F.when(F.col("depth") <= 0, F.col("at")))
    ends = b.groupBy(*key).agg(F.coalesce(F.min(end), F.max("at")).alias("behind"))
    b = b.join(ends, key).where("at <= behind")
    left = b.groupBy(*key).agg(F.bool_or(F.col("own").rlike(LEAVES)).alias("left")).where("left").select(*key)
    return guards.join(ends, key).join(left, key, "left_semi")


def guard_sanitizers(f: Facts, guards=GUARDS) -> DataFrame:
    """taint_sanitizers rows: the lines that a guard clears."""
    g = guard_lines(f, guards)
    own = g.where("scope = 'line'").select("file", "line", "name", "sanitizes")
    behind = g.where("scope != 'line'").groupBy("file", "name", "variable", "scope", "sanitizes").agg(F.min("behind").alias("behind"))
    lines = f.source_lines.select("file", "line", "text")
    later = behind.join(lines, "file").where((F.col("line") > F.col("behind")) & ((F.col("scope") == "after") | F.array_contains(identifiers("text"), F.col("variable"))))
    every = own.unionByName(later.select("file", "line", "name", "sanitizes")).distinct()
    w = Window.partitionBy("file").orderBy("line", "name")
    return every.select("file", (F.row_number().over(w) - 1).cast("int").alias("san_ord"), F.col("name").alias("type"), F.col("name").alias("method"), "line", "sanitizes")


def with_line_detectors(f: Facts) -> Facts:
    """The facts with the sources and sanitizers that lines tell, beside those that are there."""
    sources, sanitizers = assignment_sources(f), guard_sanitizers(f)

    def both(known: DataFrame, more: DataFrame) -> DataFrame:
        missing = [x for x in known.schema if x.name not in more.columns]
        return known.unionByName(more.withColumns({x.name: F.lit(None).cast(x.dataType) for x in missing}).select(*known.columns))

    return f.with_tables(taint_sources=both(f.taint_sources, sources), taint_sanitizers=both(f.taint_sanitizers, sanitizers))


def detector_names() -> list[str]:
    return reduce(list.__add__, [[x.name for x in FLOWS], [x.name for x in GUARDS]])
