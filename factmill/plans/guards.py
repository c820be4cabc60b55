"""Security passes that ask what comes before: guards, sanitizers, delimiters, headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import identifiers
from ..operators import graph, joins
from .findings import findings
from .registry import register

# Fixed values.
GUARDS = "(?i)^(authenticate|authorize|isAuthenticated|isAuthorized|hasRole|hasPermission|checkPermission|checkAccess|requireAuth|verifyToken|isAdmin|assertAllowed)"
SENSITIVE = "(?i)^(delete|remove|drop|grant|revoke|transfer|withdraw|shutdown|execute|setRole|resetPassword|updatePassword)"
CLEANERS = "(?i)(escape|encode|sanitiz|sanitis|clean|purify|strip)"
PROMPTS = "create|complete|chat|generate|invoke|predict|completion|completions|generateContent|sendMessage"


def _entry_dominators(f: Facts) -> DataFrame:
    """file, method, id, enter, leave: the dominator tree of each method's blocks between its lines, from the first of them."""
    m = f.methods.select("file", F.concat_ws("#", "type_name", "name", F.col("start_line").cast("string")).alias("method"), F.col("start_line").alias("m_start"), F.col("end_line").alias("m_end"))
    b = joins.range_join(f.cfg_blocks.select("file", "id", "start_line", "end_line"), m, ["file"], "start_line", "m_start", "m_end").where("end_line <= m_end").select("file", "method", "id", "start_line", "end_line")
    own = b.select("file", "method", "id")
    e = f.cfg_edges.join(own.withColumnRenamed("id", "from"), ["file", "from"]).join(own.withColumnRenamed("id", "to"), ["file", "method", "to"])
    root = joins.first_match(b, ["file", "method"], ["start_line", "id"]).select("file", "method", "id")
    return graph.dominator_tree(own, e, root, ["file", "method"], "id", "from", "to").select("file", "method", "id", "enter", "leave")


def _not_dominated(f: Facts, wanted: DataFrame, guards: DataFrame) -> DataFrame:
    """Rows of wanted (file, line, ...) before which no guard (file, line) runs on all paths."""
    blocks = f.cfg_blocks.select("file", F.col("id").alias("block"), "start_line", "end_line")
    place = lambda df, ids: joins.enclosing(df, blocks, ["file"], "line", "start_line", "end_line", ["block"], ids).drop("start_line", "end_line")
    w = place(wanted, ["call_id"])
    g = place(guards.select("file", "line", "call_id"), ["call_id"]).select("file", F.col("block").alias("g_block"), F.col("line").alias("g_line"))
    d = _entry_dominators(f)
    at = w.join(d.select("file", "method", F.col("id").alias("block"), F.col("enter").alias("w_enter")), ["file", "block"])
    by = g.join(d.select("file", "method", F.col("id").alias("g_block"), "enter", "leave"), ["file", "g_block"])
    ok = at.join(by, ["file", "method"]).where("w_enter between enter and leave").where((F.col("g_block") != F.col("block")) | (F.col("g_line") < F.col("line"))).select("file", "call_id").distinct()
    return w.join(ok, ["file", "call_id"], "left_anti")


@register("missing-guard-dom", "security", default=False)
def missing_guard(f: Facts) -> DataFrame:
    """Sensitive operations that an authorisation check does not dominate in their method."""
    c = f.in_method(f.of_language(f.calls, "java"), "line", ["call_id"])
    hit = _not_dominated(f, c.where(F.col("method_name").rlike(SENSITIVE)).select("file", "call_id", "line", "method_name"), c.where(F.col("method_name").rlike(GUARDS)))
    return findings(hit, "missing-guard-dom", "security", "CWE-285", "high", "error", F.format_string("`%s()` runs without a check before it on all paths", "method_name"), fix="Check before the operation")


@register("missing-sanitizer-gate", "security")
def missing_sanitizer_gate(f: Facts) -> DataFrame:
    """Markup sinks that a call with a sanitizer's name does not dominate; speculative."""
    sinks = f.of_language(f.taint_sinks.where("type = 'xss'"), "java").select("file", F.col("sink_ord").alias("call_id"), "line", F.col("method").alias("method_name"))
    hit = _not_dominated(f, sinks, f.calls.where(F.col("method_name").rlike(CLEANERS)))
    return findings(hit, "missing-sanitizer-gate", "security", "CWE-79", "medium", "note", F.format_string("`%s()` writes without a sanitizer before it", "method_name"), fix="Escape what is written").withColumn("confidence", F.lit("low"))


@register("spring4shell", "security")
def spring4shell(f: Facts) -> DataFrame:
    """Request handlers of controllers that bind a plain object from the request."""
    ann = lambda c, names: F.arrays_overlap(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.regexp_extract(x, "([A-Za-z]+)", 1)), F.array(*map(F.lit, names.split())))
    t = f.of_language(f.types, "java").where(ann("annotations", "Controller RestController")).select("file", "type_ord")
    m = f.methods.join(t, ["file", "type_ord"]).where(ann("annotations", "RequestMapping GetMapping PostMapping PutMapping PatchMapping DeleteMapping"))
    p = f.params.where(~ann("annotations", "RequestBody RequestParam PathVariable RequestHeader CookieValue Valid AuthenticationPrincipal") & ~F.coalesce("type", F.lit("")).rlike("^(String|Integer|int|Long|long|Boolean|boolean|Double|double|UUID|Model|ModelMap|HttpServlet\\w+|HttpSession|Principal|BindingResult|MultipartFile|Pageable|Locale|Map|List|Set|Optional)\\b") & F.col("type").isNotNull())
    hit = m.join(p.select("file", "type_ord", "method_ord", F.col("name").alias("p_name"), F.col("type").alias("p_type")), ["file", "type_ord", "method_ord"])
    binder = f.source_lines.where(F.col("text").rlike("setDisallowedFields|setAllowedFields")).select("file").distinct()
    hit = joins.first_match(hit.join(binder, "file", "left_anti"), ["file", "type_ord", "method_ord"], ["p_name"])
    return findings(hit, "spring4shell", "security", "CWE-94", "high", "error", F.format_string("`%s %s` is bound from the request field by field", "p_type", "p_name"), "start_line", fix="Allow the fields that may be bound")


@register("cache-no-vary", "security")
def cache_no_vary(f: Facts) -> DataFrame:
    """Handlers that read who asks, allow shared caches and do not vary by it."""
    t = f.in_method(f.source_lines, "line", ["line"])
    g = t.groupBy("file", "m_type", "m_name", "m_start").agg(
        F.bool_or(F.col("text").rlike("(?i)cache-control['\"]?\\s*[,:)].*(public|s-maxage)")).alias("cached"),
        F.bool_or(F.col("text").rlike("(?i)authorization|req\\.user|session|cookies?\\b|principal")).alias("personal"),
        F.bool_or(F.col("text").rlike("(?i)\\bvary\\b")).alias("varies"),
    )
    return findings(g.where("cached and personal and not varies"), "cache-no-vary", "security", "CWE-524", "medium", "warning", F.format_string("`%s()` lets shared caches keep personal answers", "m_name"), "m_start", fix="Set Vary, or make the answer private")


def prompt_sinks(f: Facts) -> DataFrame:
    """file, call_id, line, expression, delimited, is_system: arguments of model calls, and whether what goes in is fenced off."""
    c = f.calls.where(F.col("method_name").rlike(f"^({PROMPTS})$") & F.coalesce("receiver", F.lit("")).rlike("(?i)(client|llm|model|chat|completions?|messages)"))
    a = c.select("file", "call_id", "line").join(f.call_args.select("file", "call_id", "expression"), ["file", "call_id"])
    delimited = F.col("expression").rlike("(<\\w+>|```|\"\"\"|###|---|\\[\\w+\\])[^<]*(\\{\\w+\\}|\\$\\{|\"\\s*\\+)")
    return a.withColumn("delimited", delimited).withColumn("is_system", F.col("expression").rlike("(?i)role['\"]?\\s*[:=]\\s*['\"]system"))


@register("prompt-injection", "security")
def prompt_injection(f: Facts) -> DataFrame:
    """Parameters that go into a model's instructions without anything that fences them off."""
    p = prompt_sinks(f).where("not delimited")
    m = f.in_method(p, "line", ["call_id", "expression"])
    given = f.params.join(f.methods.select("file", "type_ord", "method_ord", F.col("name").alias("m_name"), F.col("start_line").alias("m_start")), ["file", "type_ord", "method_ord"]).select("file", "m_name", "m_start", F.col("name").alias("variable"))
    hit = m.withColumn("variable", F.explode(identifiers("expression"))).join(given, ["file", "m_name", "m_start", "variable"])
    hit = joins.first_match(hit, ["file", "call_id"], ["variable"])
    out = findings(hit, "prompt-injection", "security", "CWE-1427", "high", "error", F.format_string("'%s' goes into a prompt as it is", "variable"), fix="Fence it off, and tell the model that it is data")
    return out.withColumn("confidence", F.lit("low"))


@register("vue-template-xss", "security")
def vue_template_xss(f: Facts) -> DataFrame:
    """v-html with a name that takes something from outside."""
    t = f.of_language(f.source_lines, "vue", "html").withColumn("bound", F.explode(F.regexp_extract_all("text", F.lit("v-html\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))))
    used = t.withColumn("variable", F.explode(identifiers("bound")))
    tainted = f.source_lines.withColumn("variable", F.regexp_extract("text", "\\b(?:this\\.)?(\\w+)\\s*[:=]\\s*.*(\\$route\\.|location\\.|localStorage|document\\.cookie|fetch\\(|axios|\\.data\\b)", 1)).where("variable != ''").select("file", "variable").distinct()
    hit = joins.first_match(used.join(tainted, ["file", "variable"]), ["file", "line"], ["variable"])
    return findings(hit, "vue-template-xss", "security", "CWE-79", "high", "error", F.format_string("v-html shows '%s' as markup", "variable"), snippet=F.trim("text"), fix="Show it as text, or clean it")
