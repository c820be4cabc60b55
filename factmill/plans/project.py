"""Questions about a whole project: profiles, symbols, hierarchies, call graphs, entry points, and taint across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import identifiers, simple_name, strip_generics
from ..operators import graph, joins
from .findings import SEVERITIES

# What marks a method as entered from outside.
ENTRY_METHOD_ANNOTATIONS = "RequestMapping GetMapping PostMapping PutMapping DeleteMapping PatchMapping Path GET POST PUT DELETE PATCH HEAD OPTIONS MessageMapping EventListener KafkaListener RabbitListener JmsListener Scheduled WebMethod".split()
ENTRY_CLASS_ANNOTATIONS = "Controller RestController Path WebServlet WebService ServerEndpoint ControllerAdvice".split()
ENTRY_LIFECYCLE = {
    "HttpServlet": "doGet doPost doPut doDelete doHead doOptions doTrace service",
    "GenericServlet": "service",
    "Filter": "doFilter",
    "HandlerInterceptor": "preHandle postHandle afterCompletion",
    "CommandLineRunner": "run",
    "ApplicationRunner": "run",
    "SimpleChannelInboundHandler": "channelRead0 messageReceived",
    "ChannelInboundHandlerAdapter": "channelRead channelReadComplete",
}
FACADE_SUFFIXES = "Utils Util Helper Helpers Factory Builder Converter Codec Parser Serializer".split()
ENTRY_DECORATORS = "(route|get|post|put|delete|patch|api_view|task|command|websocket|on_event|fixture|action|errorhandler|before_request|after_request|Get|Post|Put|Delete|Patch|Query|Mutation|MessagePattern|Cron)"
RECEIVER_TYPES = {"stmt": "Statement", "conn": "Connection", "req": "HttpServletRequest", "request": "HttpServletRequest", "resp": "HttpServletResponse", "response": "HttpServletResponse", "session": "HttpSession", "reader": "BufferedReader", "writer": "PrintWriter", "runtime": "Runtime", "scanner": "Scanner"}
SANITIZER_NAMES = "(?i)(escape|encode|sanitize|sanitise|validate|filter|clean|purify|quote|whitelist|allowlist)"
CROSS_FILE, CROSS_FLOOR, CROSS_HOP, ALIASED = 0.7, 0.3, 0.85, 0.65
VISITED = 2000
SPECULATIVE_SOURCES = ["interprocedural_param", "constructor_field"]
BUDGET_SECONDS = 300.0


# ---- profiles ----------------------------------------------------------------------------------------------------------


def environment(file: Column) -> Column:
    f = F.lower(F.regexp_replace(file, r"\\", "/"))
    return F.when(f.rlike("(^|/)tests?/"), "test").when(f.rlike("(^|/)benchmarks?/"), "benchmark").when(f.rlike("(^|/)(samples?|examples?|demos?|fixtures?)/"), "sample").when(f.rlike("(^|/)src/main/"), "production").otherwise("dev")


def shapes(modules: DataFrame) -> DataFrame:
    """root, shape: by plugins, packaging, publication and a main method; the first signal that holds."""
    has = lambda pattern: F.exists(F.coalesce("plugins", F.array().cast("array<string>")), lambda p: p.rlike(pattern))
    published = F.size(F.coalesce("distribution_urls", F.array().cast("array<string>"))) > 0
    library = has("java-library|maven-publish|nexus|bundle") | F.coalesce("has_jpms", F.lit(False)) | F.coalesce("has_spi", F.lit(False))
    main = F.coalesce("has_main", F.lit(False))
    return modules.select("root", F.when(has("spring-boot|war|quarkus|micronaut|ktor") | F.col("packaging").isin("war", "ear"), "server").when(has("maven-plugin|gradle-plugin|intellij") | (F.col("packaging") == "maven-plugin"), "plugin").when(main & has("shadow|picocli|graalvm|application"), "cli").when(main, "application").when(library & published, "library").when(library, "application").when(published, "library").otherwise("unknown").alias("shape"))


def profiles(files: DataFrame, modules: DataFrame, overrides: list[tuple[str, str]] = (), forced: str | None = None) -> DataFrame:
    """file, project_profile: an override (first glob that matches), else what is forced, else the owning module's shape and the path's environment."""
    from ..functions.text import glob_to_regex

    owned = joins.longest_prefix(files.select("file"), shapes(modules), "file", "root", ["file"])
    p = files.select("file").join(owned.select("file", "shape"), "file", "left")
    own = F.when(F.col("shape").isNull() | (F.col("shape") == "unknown"), F.lit("unknown")).otherwise(F.concat_ws("/", "shape", environment(F.col("file"))))
    out = F.lit(forced) if forced else own
    for pattern, profile in reversed(list(overrides)):
        out = F.when(F.col("file").rlike(glob_to_regex(pattern)), F.lit(profile)).otherwise(out)
    return p.select("file", out.alias("project_profile"))


def profile_histogram(files: DataFrame) -> DataFrame:
    """shape, env, n with totals for either: a cube."""
    part = F.split("project_profile", "/")
    return files.select(F.get(part, F.lit(0)).alias("shape"), F.get(part, F.lit(1)).alias("env")).cube("shape", "env").agg(F.count("*").alias("n"))


# ---- gates on sources and sinks, by profile and registry ---------------------------------------------------------------


def _library(f: Facts, df: DataFrame) -> DataFrame:
    return df.join(f.files.select("file", F.coalesce(F.col("project_profile").startswith("library/"), F.lit(False)).alias("_library")), "file", "left")


def tag_sources(f: Facts) -> Facts:
    """Constants, service-provider windows (30 lines around a loader) and demo paths are told on each source."""
    spi = f.source_lines.where(F.col("text").rlike("ServiceLoader|META-INF/services|spi")).select("file", F.col("line").alias("spi_line"))
    s = f.taint_sources.drop("constant", "spi", "demo_path")
    near = joins.band_join(s.select("file", "src_ord", "line"), spi, ["file"], "line", "spi_line", 30).select("file", "src_ord").distinct().withColumn("spi", F.lit(True))
    s = s.join(near, ["file", "src_ord"], "left").withColumn("constant", F.coalesce("code", F.lit("")).rlike("=\\s*(\"[^\"]*\"|'[^']*'|\\d+)\\s*;?\\s*$")).withColumn("spi", F.coalesce("spi", F.lit(False))).withColumn("demo_path", F.col("file").rlike("(?i)(^|/)(demo|example|sample|tutorial)s?/"))
    return f.with_tables(taint_sources=s.select(*f.taint_sources.columns))


def library_sources(f: Facts) -> Facts:
    """In libraries, parameters and constructor fields are no sources: who calls decides."""
    s = _library(f, f.taint_sources).where(~(F.col("_library") & F.col("type").isin(SPECULATIVE_SOURCES))).drop("_library")
    return f.with_tables(taint_sources=s)


def library_sinks(f: Facts, html_receivers: tuple[str, ...] = ("HttpServletResponse", "PrintWriter", "JspWriter", "Document", "Element")) -> Facts:
    """In libraries, logging is no sink, and markup only where it goes into a page."""
    s = _library(f, f.taint_sinks)
    html = F.coalesce(F.col("class").isin(list(html_receivers)), F.lit(True))
    s = s.where(~(F.col("_library") & ((F.col("type") == "log_injection") | ((F.col("type") == "xss") & ~html)))).drop("_library")
    return f.with_tables(taint_sinks=s)


def known_semantics(f: Facts, registry: DataFrame) -> Facts:
    """Drops sinks whose Class#method is known to be something else. registry: signature, overrides."""
    known = registry.select("signature", F.explode("overrides").alias("type")).distinct()
    s = f.taint_sinks.withColumn("signature", F.concat_ws("#", "class", "method")).join(F.broadcast(known), ["signature", "type"], "left_anti").drop("signature")
    return f.with_tables(taint_sinks=s.select(*f.taint_sinks.columns))


def safe_deserialization(f: Facts, dependencies: DataFrame) -> Facts:
    """Drops deserialization sinks of libraries whose declared version is safe by default, unless the file turns the safety off."""
    from ..functions.text import satisfies

    v = F.col("version")
    safe = dependencies.where(((F.col("name") == "com.alibaba:fastjson") & satisfies(v, ">=2.0.0")) | ((F.lower("name") == "pyyaml") & satisfies(v, ">=6.0.0")))
    unsafe = f.source_lines.where(F.col("text").rlike("setAutoTypeSupport\\(\\s*true|SupportAutoType|enableDefaultTyping|activateDefaultTyping|UnsafeLoader|FullLoader")).select("file").distinct()
    language = F.when(F.col("name") == "com.alibaba:fastjson", "java").otherwise("python")
    files = f.files.join(F.broadcast(safe.select(language.alias("language")).distinct()), "language").select("file").join(unsafe, "file", "left_anti")
    hit = files.withColumn("type", F.lit("deserialization"))
    return f.with_tables(taint_sinks=f.taint_sinks.join(hit, ["file", "type"], "left_anti").select(*f.taint_sinks.columns))


def command_line_reflection(f: Facts) -> Facts:
    """Drops reflection sinks of files that have a main method and nothing of the web."""
    main = f.methods.where(F.col("name") == "main").select("file").distinct()
    web = f.imports.where(F.col("from_package").rlike("servlet|springframework\\.web|jax\\.rs|ws\\.rs")).select("file").distinct()
    hit = main.join(web, "file", "left_anti")
    reflect = F.col("method").isin("forName", "invoke", "newInstance", "loadClass")
    kept = f.taint_sinks.where(~F.coalesce(reflect, F.lit(False))).unionByName(f.taint_sinks.where(reflect).join(hit, "file", "left_anti").select(*f.taint_sinks.columns))
    return f.with_tables(taint_sinks=kept)


def filtered_sinks(f: Facts, dead: DataFrame | None = None) -> Facts:
    """Drops sinks that a stage of the sink filter clears, on dead lines, with constant arguments alone, of parameterised queries and of sanitised lines."""
    from .sink_filter import kept_sinks

    s = f.with_text(kept_sinks(f).taint_sinks)
    s = s.where(~F.col("text").rlike("^\\s*throw\\s"))
    if dead is not None:
        s = s.join(dead.select("file", "line").distinct(), ["file", "line"], "left_anti")
    args = f.call_args.join(f.calls.select("file", "call_id", "line"), ["file", "call_id"])
    constant = args.groupBy("file", "line").agg(F.bool_and(F.col("literal").isNotNull() | F.col("expression").rlike("^\\s*(\"[^\"+]*\"|'[^'+]*'|\\d+)\\s*$")).alias("c")).where("c").select("file", "line")
    s = s.join(constant, ["file", "line"], "left_anti")
    parameterised = (F.col("type") == "sql_injection") & F.col("text").rlike("[\"'][^\"']*(\\?|:\\w+|%s|\\$\\d)[^\"']*[\"']\\s*,") & ~F.col("text").rlike("[\"']\\s*\\+|\\.format\\(|f[\"']")
    s = s.where(~parameterised)
    clean = s.select("file", "line", "type").join(f.taint_sanitizers.select("file", "line", "sanitizes"), ["file", "line"]).where(F.array_contains("sanitizes", F.col("type"))).select("file", "line", "type").distinct()
    return f.with_tables(taint_sinks=s.join(clean, ["file", "line", "type"], "left_anti").select(*f.taint_sinks.columns))


# ---- symbols and hierarchies -------------------------------------------------------------------------------------------


def symbols(f: Facts) -> DataFrame:
    """fqn, name, file, kind."""
    fqn = F.concat_ws(".", F.col("package"), F.col("name"))
    return f.types.select(fqn.alias("fqn"), "name", "file", "kind")


def resolve(f: Facts, names: DataFrame) -> DataFrame:
    """names (file, name) with `fqn`: itself if it is one, else by import, by wildcard import, or if only one type has that name."""
    s = symbols(f)
    full = s.select(F.col("fqn").alias("name"), F.col("fqn").alias("v")).dropDuplicates(["name"])
    named = f.imports.where("not is_wildcard").select("file", F.coalesce("alias", "imported_name").alias("name"), F.concat_ws(".", "from_package", "imported_name").alias("v")).dropDuplicates(["file", "name"])
    wild = f.imports.where("is_wildcard").select("file", F.col("from_package").alias("package")).join(f.types.select("package", "name"), "package").select("file", "name", F.concat_ws(".", "package", "name").alias("v")).groupBy("file", "name").agg(F.min("v").alias("v"))
    alone = s.groupBy("name").agg(F.count_distinct("fqn").alias("n"), F.first("fqn").alias("v")).where("n = 1")
    return joins.coalesced(names, [(full, ["name"], "v"), (named, ["file", "name"], "v"), (wild, ["file", "name"], "v"), (alone, ["name"], "v")], "fqn")


def receiver_type(receiver: Column, declared: Column) -> Column:
    """The declared type, else what the receiver's name suggests; the first of the names that it contains."""
    out = declared
    r = F.lower(F.coalesce(receiver, F.lit("")))
    guess = None
    for part, kind in RECEIVER_TYPES.items():
        guess = F.when(r.contains(part), kind) if guess is None else guess.when(r.contains(part), kind)
    return F.coalesce(out, guess)


def hierarchy(f: Facts, known: DataFrame | None = None) -> DataFrame:
    """sub, super, hops: closure of extends and implements by simple names; known: (sub, super) pairs of libraries."""
    e = f.types.where("extends is not null").select(F.col("name").alias("sub"), simple_name(strip_generics(F.col("extends"))).alias("super"))
    i = f.types.select(F.col("name").alias("sub"), F.explode("implements").alias("i")).select("sub", simple_name(strip_generics(F.col("i"))).alias("super"))
    every = e.unionByName(i) if known is None else e.unionByName(i).unionByName(known)
    c = graph.closure(every.where("sub != super").select(F.lit("").alias("g"), "sub", "super"), ["g"], "sub", "super")
    return c.select(F.col("src").alias("sub"), F.col("dst").alias("super"), "hops")


def could_be(h: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) where a is b, a subtype or a supertype of it."""
    same = pairs.where("a = b")
    down = pairs.join(h.select(F.col("sub").alias("a"), F.col("super").alias("b")), ["a", "b"], "left_semi")
    up = pairs.join(h.select(F.col("super").alias("a"), F.col("sub").alias("b")), ["a", "b"], "left_semi")
    return same.unionByName(down).unionByName(up).distinct()


# ---- calls and entry points --------------------------------------------------------------------------------------------


def method_keys(f: Facts) -> DataFrame:
    return f.methods.withColumn("key", F.concat_ws("#", "file", "type_name", "name", F.col("start_line").cast("string")))


def call_edges(f: Facts) -> DataFrame:
    """caller, callee, call_id, file, line: a call's method by name, within its receiver's type where that is known, in its own file first."""
    m = method_keys(f)
    c = f.in_method(f.calls.select("file", "call_id", "line", "method_name", "receiver", "receiver_type"), "line", ["call_id"])
    c = c.withColumn("caller", F.concat_ws("#", "file", "m_type", "m_name", F.col("m_start").cast("string")))
    t = m.select(F.col("name").alias("method_name"), F.col("type_name").alias("t_name"), F.col("file").alias("t_file"), F.col("key").alias("callee"))
    j = c.join(t, "method_name").where((F.col("receiver_type") == F.col("t_name")) | (F.col("receiver_type").isNull() & (F.col("receiver").isNull() | F.col("receiver").isin("this", "self", "")) & (F.col("file") == F.col("t_file"))) | (F.col("receiver_type").isNull() & F.col("receiver").isNotNull() & ~F.col("receiver").isin("this", "self", "")))
    rank = F.when(F.col("receiver_type") == F.col("t_name"), 0).when(F.col("file") == F.col("t_file"), 1).otherwise(2)
    best = joins.first_match(j.withColumn("rank", rank), ["file", "call_id", "t_file", "t_name"], ["rank", "callee"])
    return best.select("caller", "callee", "call_id", "file", "line").distinct()


def entry_tiers(f: Facts) -> DataFrame:
    """key, file, language, tier: entry point, reachable from one by one call, library, or unknown for languages without rules."""
    m = method_keys(f).join(f.files.select("file", "language"), "file").join(f.types.select("file", "type_ord", F.col("annotations").alias("t_annotations"), F.col("extends").alias("t_extends"), F.col("implements").alias("t_implements")), ["file", "type_ord"], "left")
    bare = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.regexp_replace(x, "^@", ""), "\\(.*", ""))
    has = lambda c, names: F.arrays_overlap(bare(F.col(c)), F.array(*map(F.lit, names)))
    supers = F.transform(F.concat(F.array_compact(F.array("t_extends")), F.coalesce("t_implements", F.array().cast("array<string>"))), lambda x: simple_name(F.regexp_replace(x, "<.*>", "")))
    lifecycle = F.lit(False)
    for kind, names in ENTRY_LIFECYCLE.items():
        lifecycle = lifecycle | (F.array_contains(supers, kind) & F.col("name").isin(names.split()))
    facade = F.col("type_name").rlike("(" + "|".join(FACADE_SUFFIXES) + ")$")
    java = ~facade & (has("annotations", ENTRY_METHOD_ANNOTATIONS) | has("t_annotations", ENTRY_CLASS_ANNOTATIONS) | lifecycle | ((F.col("name") == "main") & F.coalesce(F.array_contains("modifiers", "static"), F.lit(True))))
    decorated = F.exists(F.coalesce("annotations", F.array().cast("array<string>")), lambda x: x.rlike(f"(^|\\.|@){ENTRY_DECORATORS}\\b"))
    other = decorated | (F.col("name") == "main")
    go = F.col("name").rlike("^(main|ServeHTTP|Handle[A-Z]?\\w*)$")
    lang = F.col("language")
    known = lang.isin("java", "python", "javascript", "typescript", "go", "bash")
    first = F.when(lang == "java", java).when(lang.isin("python", "javascript", "typescript"), other).when(lang == "go", go).when(lang == "bash", F.lit(True))
    m = m.select("key", "file", "language", F.when(~known, "unknown").when(F.coalesce(first, F.lit(False)), "entry").otherwise("library").alias("tier"))
    near = call_edges(f).join(m.where("tier = 'entry'").select(F.col("key").alias("caller")), "caller").select(F.col("callee").alias("key")).distinct().withColumn("near", F.lit(True))
    return m.join(near, "key", "left").select("key", "file", "language", F.when((F.col("tier") == "library") & F.col("near"), "reachable").otherwise(F.col("tier")).alias("tier"))


def require_entry_path(f: Facts, found: DataFrame, taint_rules: list[str], most: int = VISITED) -> DataFrame:
    """Findings with entry_path_tier and entry_distance. One search from all entry points at once replaces one search for each finding.

    Severe taint findings that no entry point reaches are dropped, if their language has entry points, the method is known, and the
    file is no library. All others stay as they are.
    """
    tiers = entry_tiers(f)
    entries = tiers.where("tier = 'entry'").select(F.lit("p").alias("project"), F.col("key").alias("method"))
    e = call_edges(f).select(F.lit("p").alias("project"), "caller", "callee")
    reach = graph.shortest_with_parent(entries, e, ["project"], "method", "caller", "callee", most).select(F.col("method").alias("key"), F.col("depth").alias("entry_distance"), F.col("seed").alias("entry_point"))
    covered = tiers.groupBy("language").agg(F.bool_or(F.col("tier") == "entry").alias("has_entries"))
    files = f.files.join(covered, "language", "left").select("file", F.coalesce("has_entries", F.lit(False)).alias("has_entries"), F.coalesce("project_profile", F.lit("unknown")).alias("_profile"))
    at = f.in_method(found.select("file", "id", "line").distinct(), "line", ["id"]).withColumn("key", F.concat_ws("#", "file", "m_type", "m_name", F.col("m_start").cast("string"))).select("file", "id", "line", "key")
    j = found.join(files, "file", "left").join(at, ["file", "id", "line"], "left").join(reach, "key", "left")
    scope = (F.col("category") == "security") & F.col("rule_id").isin(taint_rules) & F.coalesce("has_entries", F.lit(False)) & F.col("key").isNotNull()
    drop = scope & F.col("entry_distance").isNull() & F.col("severity").isin("high", "critical") & ~F.col("_profile").startswith("library")
    return j.where(~drop).withColumn("entry_path_tier", F.when(scope & F.col("entry_distance").isNotNull(), "tier1-entry-point")).drop("key", "has_entries", "_profile")


# ---- taint between methods and files -----------------------------------------------------------------------------------


def method_summaries(f: Facts) -> DataFrame:
    """key, file, name, type_name, returns_source, tainted_params (positions whose definitions reach a sink), sanitizes."""
    m = method_keys(f).select("key", "file", "type_ord", "method_ord", "name", "type_name", F.col("start_line").alias("s"), F.col("end_line").alias("e"), "annotations")
    src = joins.range_join(f.taint_sources.where(F.col("type") != "interprocedural_param").select("file", "line", "variable"), m, ["file"], "line", "s", "e")
    back = joins.range_join(f.source_lines.where(F.col("text").rlike("^\\s*return\\b")).select("file", F.col("line").alias("r_line"), F.explode(identifiers("text")).alias("variable")), m.select("file", "key", "s", "e"), ["file"], "r_line", "s", "e")
    returns = src.select("key", "variable").join(back.select("key", "variable"), ["key", "variable"], "left_semi").select("key").distinct().withColumn("returns_source", F.lit(True))
    given = f.params.select("file", "type_ord", "method_ord", "position", F.col("name").alias("variable")).join(m, ["file", "type_ord", "method_ord"])
    starts = given.join(f.dfg_defs.where("kind = 'param'").select("file", F.col("id"), "variable", "line"), ["file", "variable"]).where("line between s and e or line = 0")
    reach = graph.reachable(starts.select("file", "key", "position", "id"), f.dfg_chains.join(starts.select("file", "key", "position").distinct(), "file"), ["file", "key", "position"], "id", "from_def", "to_def")
    uses = f.dfg_uses.where("def_id is not null").select("file", F.col("line"), F.col("def_id").alias("id")).join(f.taint_sinks.select("file", "line", F.col("type").alias("sink_type")), ["file", "line"])
    hits = reach.join(uses, ["file", "id"]).groupBy("key").agg(F.array_sort(F.collect_set("position")).alias("tainted_params"), F.array_sort(F.collect_set("sink_type")).alias("sink_types"))
    clean = F.col("name").rlike(SANITIZER_NAMES) | F.exists(F.coalesce("annotations", F.array().cast("array<string>")), lambda a: a.rlike("(?i)sanitiz|encod"))
    none = F.array().cast("array<int>")
    return m.join(returns, "key", "left").join(hits, "key", "left").select("key", "file", "name", "type_name", F.coalesce("returns_source", F.lit(False)).alias("returns_source"), F.coalesce("tainted_params", none).alias("tainted_params"), F.coalesce("sink_types", F.array().cast("array<string>")).alias("sink_types"), clean.alias("sanitizes"))


def cross_file_paths(f: Facts) -> DataFrame:
    """source_file, source_line, source_type, sink_type, call_file, call_line, target, hops, confidence.

    Taint that reaches an argument of a call whose target, or a method that the target hands it on to, has that parameter reach a sink. Confidence falls by
    hops; a target that sanitizes ends the path.
    """
    from . import rules, taint

    t = taint.propagate(f).select("file", "src_ord", "id")
    u = f.dfg_uses.where("def_id is not null").select("file", F.col("def_id").alias("id"), "line", "variable")
    s = f.taint_sources.select("file", "src_ord", F.col("line").alias("source_line"), F.col("type").alias("source_type"))
    calls = call_edges(f).select("caller", "callee", "call_id", "file", "line")
    args = f.call_args.select("file", "call_id", "position", F.explode(identifiers("expression")).alias("variable")).distinct()
    sums = method_summaries(f).select(F.col("key").alias("callee"), F.col("file").alias("target_file"), "tainted_params", "sink_types", "sanitizes")
    hit = t.join(u, ["file", "id"]).join(calls, ["file", "line"]).join(args, ["file", "call_id", "variable"]).join(sums, "callee").where((F.col("file") != F.col("target_file")) & F.array_contains("tainted_params", F.col("position")) & ~F.col("sanitizes"))
    rows = hit.join(s, ["file", "src_ord"]).withColumn("sink_type", F.explode("sink_types")).join(F.broadcast(rules.reach(f.spark)), ["source_type", "sink_type"], "left_semi")
    return rows.select(F.col("file").alias("source_file"), "source_line", "source_type", "sink_type", F.col("file").alias("call_file"), F.col("line").alias("call_line"), F.col("callee").alias("target"), F.lit(1).alias("hops"), F.lit(CROSS_FILE).alias("confidence")).distinct()


def wrapped_sources(f: Facts) -> DataFrame:
    """file, line, variable, confidence: variables that take the result of a method that returns a source, over any number of wrappers."""
    sums = method_summaries(f)
    back = f.source_lines.where(F.col("text").rlike("^\\s*return\\b")).select("file", "line")
    handed = call_edges(f).join(back, ["file", "line"]).select(F.lit("p").alias("project"), F.col("callee").alias("src"), F.col("caller").alias("dst"))
    seeds = sums.where("returns_source and not sanitizes").select(F.lit("p").alias("project"), "key")
    r = graph.reachable(seeds, handed, ["project"], "key", "src", "dst").select(F.col("key").alias("callee"), "depth")
    calls = call_edges(f).join(r, "callee")
    d = joins.first_match(f.dfg_defs, ["file", "line"], ["id"]).select("file", "line", "variable")
    out = calls.join(d, ["file", "line"])
    return out.groupBy("file", "line", "variable").agg(F.max(F.greatest(F.lit(CROSS_FLOOR), F.pow(F.lit(CROSS_HOP), F.col("depth")))).alias("confidence"))


def field_taint(f: Facts) -> DataFrame:
    """file, type_name, field, source_line, confidence: fields that a source is put into, and through them other instances of the type."""
    put = f.source_lines.withColumn("field", F.regexp_extract("text", r"\bthis\.(?:\w+\.)*(\w+)\s*=[^=]", 1)).where("field != ''").select("file", "line", "field", "text")
    direct = put.join(f.taint_sources.select("file", "line", "type"), ["file", "line"]).select("file", "line", "field")
    m = f.in_method(direct, "line", ["line", "field"])
    return m.select("file", F.col("m_type").alias("type_name"), "field", F.col("line").alias("source_line"), F.lit(ALIASED).alias("confidence")).distinct()


def without_sanitized(paths: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """Paths without a sanitizer of their type: between source and sink in one file, on the call's line otherwise."""
    s = sanitizers.select(F.col("file").alias("call_file"), F.col("line").alias("san_line"), F.explode("sanitizes").alias("sink_type"))
    same = F.col("source_file") == F.col("call_file")
    lo, hi = F.least("source_line", "call_line"), F.greatest("source_line", "call_line")
    hit = paths.join(s, ["call_file", "sink_type"]).where(F.when(same, F.col("san_line").between(lo, hi)).otherwise(F.col("san_line") == F.col("call_line"))).select(*paths.columns).distinct()
    return paths.join(hit, paths.columns, "left_anti")


def interprocedural(f: Facts) -> DataFrame:
    """caller, callee, call_line, tainted_args, returns_taint: calls that hand taint on, and whether the result carries it back."""
    from . import taint

    t = taint.propagate(f).select("file", "id").distinct()
    u = f.dfg_uses.where("def_id is not null").select("file", F.col("def_id").alias("id"), "line", "variable")
    args = f.call_args.select("file", "call_id", "position", F.explode(identifiers("expression")).alias("variable")).distinct()
    c = call_edges(f)
    hit = t.join(u, ["file", "id"]).join(c, ["file", "line"]).join(args, ["file", "call_id", "variable"])
    g = hit.groupBy("caller", "callee", F.col("line").alias("call_line")).agg(F.array_sort(F.collect_set("position")).alias("tainted_args"))
    back = method_summaries(f).select(F.col("key").alias("callee"), F.col("returns_source").alias("returns_taint"))
    return g.join(back, "callee", "left").select("caller", "callee", "call_line", "tainted_args", F.coalesce("returns_taint", F.lit(False)).alias("returns_taint"))


def taint_method_paths(f: Facts, most_depth: int = 5) -> DataFrame:
    """path: chains of methods that hand taint on, from methods with a source, up to a depth."""
    e = interprocedural(f).select(F.lit("p").alias("project"), "caller", "callee").distinct()
    m = method_keys(f).select("file", "key", "start_line", "end_line")
    seeds = joins.range_join(f.taint_sources.select("file", "line"), m, ["file"], "line", "start_line", "end_line").select(F.lit("p").alias("project"), "key").distinct()
    return graph.simple_paths(seeds, e, ["project"], "key", "caller", "callee", most_depth).where(F.size("path") > 1).select("path")


def escaping_taint(f: Facts) -> DataFrame:
    """file, line, method: calls outside of the project that take taint, where the file has no sink of its own."""
    from . import taint

    t = taint.propagate(f).select("file", "id").distinct()
    u = f.dfg_uses.where("def_id is not null").select("file", F.col("def_id").alias("id"), "line", "variable")
    own = f.methods.select(F.col("name").alias("method_name")).distinct()
    outer = f.calls.join(own, "method_name", "left_anti").where(~F.col("method_name").rlike("^(get|is|has|to|equals|hashCode|length|size|print|log|debug|info|warn|error|trace)"))
    args = f.call_args.select("file", "call_id", F.explode(identifiers("expression")).alias("variable")).distinct()
    hit = t.join(u, ["file", "id"]).join(outer, ["file", "line"]).join(args, ["file", "call_id", "variable"])
    return hit.join(f.taint_sinks.select("file").distinct(), "file", "left_anti").select("file", "line", F.col("method_name").alias("method")).distinct()


def unresolved(f: Facts) -> DataFrame:
    """file, call_id, reason: calls whose target cannot be told."""
    c = f.calls
    dynamic = c.where(F.col("method_name").isin("invoke", "newInstance", "forName", "getattr", "eval", "apply")).select("file", "call_id", F.lit("reflection").alias("reason"))
    inter = f.types.where("kind = 'interface'").select(F.col("name").alias("receiver_type")).distinct()
    virtual = c.join(inter, "receiver_type").select("file", "call_id", F.lit("virtual_dispatch").alias("reason"))
    unknown = c.where(F.col("receiver").isNotNull() & F.col("receiver_type").isNull() & (F.col("resolution.status") == "unresolved")).select("file", "call_id", F.lit("unknown_receiver").alias("reason"))
    return dynamic.unionByName(virtual).unionByName(unknown).distinct()


def enriched(f: Facts) -> DataFrame:
    """file, method_name, role, risk, trust_boundary."""
    tiers = entry_tiers(f).select("key", "tier")
    m = method_keys(f).join(tiers, "key")
    n = F.lower("name")
    role = F.when(F.col("tier") == "entry", "entry_point").when(n.rlike(SANITIZER_NAMES), "sanitizer").when(n.rlike("^(find|get|load|fetch|query|select)"), "accessor").when(n.rlike("^(save|insert|update|delete|write|store)"), "mutator").otherwise("internal")
    risk = F.when(F.col("tier") == "entry", "high").when(role == "mutator", "medium").otherwise("low")
    return m.select("file", F.col("name").alias("method_name"), role.alias("role"), risk.alias("risk"), (F.col("tier") == "entry").alias("trust_boundary"))


def polymorphic_targets(f: Facts) -> DataFrame:
    """call_id, file, candidates, primary: what a call on an interface or superclass may run; the first by order of types is the primary one."""
    h = hierarchy(f).select(F.col("super").alias("receiver_type"), F.col("sub").alias("type_name"))
    m = method_keys(f).select("type_name", F.col("name").alias("method_name"), "key", "type_ord")
    j = f.calls.where("receiver_type is not null").select("file", "call_id", "method_name", "receiver_type").join(h, "receiver_type").join(m, ["type_name", "method_name"])
    return j.groupBy("file", "call_id").agg(F.array_sort(F.collect_set("key")).alias("candidates"), F.min_by("key", F.struct("type_ord", "key")).alias("primary"))


# ---- the query tools ---------------------------------------------------------------------------------------------------


def entry_points(f: Facts) -> DataFrame:
    return entry_tiers(f).where("tier = 'entry'").select("key", "file", "language")


def entry_point_counts(f: Facts) -> DataFrame:
    return entry_points(f).groupBy("language").agg(F.count("*").alias("n"))


def reachable_sinks(f: Facts) -> DataFrame:
    """file, line, type, how: sinks at the end of a flow in a file, or of a path between files."""
    from . import taint

    a = taint.flows(f).select("file", F.col("sink_line").alias("line"), F.col("sink_type").alias("type"), F.lit("flow").alias("how"))
    b = cross_file_paths(f).select(F.split_part("target", F.lit("#"), F.lit(1)).alias("file"), F.col("call_line").alias("line"), F.col("sink_type").alias("type"), F.lit("cross-file").alias("how"))
    return a.unionByName(b).distinct()


def covering_sanitizers(f: Facts, sink_type: str) -> DataFrame:
    return f.taint_sanitizers.where(F.array_contains("sanitizes", sink_type))


def paths_where(paths: DataFrame, file: str | None = None, sink_type: str | None = None, most: int = 200) -> DataFrame:
    """Paths of a file (whole or by its end) and a sink type; the report holds a limited number."""
    p = paths
    if file:
        p = p.where((F.col("source_file") == file) | F.col("source_file").endswith(f"/{file}") | (F.col("call_file") == file) | F.col("call_file").endswith(f"/{file}"))
    if sink_type:
        p = p.where(F.col("sink_type") == sink_type)
    return p.orderBy("source_file", "source_line", "call_line").limit(most)


def severity_rank() -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))


