"""Taint: matching calls with patterns, propagation along definitions, flows, and findings from source-sink pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import identifiers, simple_name
from ..operators import graph, joins, picks
from . import rules

HOP, NEXT_LINE, FLOW = 0.95, 0.9, 0.9
BACKWARD = 32

SOURCE_PATTERNS = "method string, class string, type string, severity string, languages array<string>"
SINK_PATTERNS = "method string, class string, type string, cwe string, severity string, arg_positions array<int>, languages array<string>"
SANITIZER_PATTERNS = "method string, class string, removes array<string>"


def _language_ok() -> F.Column:
    return F.col("p_languages").isNull() | (F.size("p_languages") == 0) | F.array_contains("p_languages", F.col("language"))


def _class_ok() -> F.Column:
    """The pattern has no class, or the receiver's type, its last name, the receiver's own name or a resolved target is it."""
    want = F.col("p_class")
    name = F.lower(F.coalesce(F.col("receiver"), F.lit("")))
    return want.isNull() | F.coalesce(F.col("receiver_type") == want, F.lit(False)) | F.coalesce(simple_name("receiver_type_fqn") == want, F.lit(False)) | (F.lower(want) == name) | ((name != "") & F.endswith(F.lower(want), simple_name(name)))


def _patterned(f: Facts, patterns: DataFrame) -> DataFrame:
    """Calls with each pattern of their method name: a broadcast dictionary match with a residual predicate."""
    p = F.broadcast(patterns.select(F.col("method").alias("m"), *[F.col(c).alias(f"p_{c}") for c in patterns.columns if c != "method"]))
    calls = f.calls.join(f.files.select("file", "language"), "file").withColumn("m", simple_name("method_name"))
    hit = calls.join(p, "m").where(_class_ok())
    return hit.where(_language_ok()) if "p_languages" in hit.columns else hit


def match_sources(f: Facts, patterns: DataFrame) -> DataFrame:
    """Sources by call, and every parameter of a public method as a source of its own kind."""
    hit = _patterned(f, patterns)
    var = joins.first_match(f.dfg_defs, ["file", "line"], ["id"]).select("file", "line", "variable")
    called = hit.join(var, ["file", "line"], "left").select("file", F.col("p_type").alias("type"), F.concat_ws(".", "receiver", "method_name").alias("location"), F.col("p_severity").alias("severity"), "line", F.lit(1.0).alias("confidence"), "variable", "in_method")
    m = f.methods.where(~F.coalesce(F.array_contains("modifiers", "private"), F.lit(False))).select("file", "type_ord", "method_ord", F.col("name").alias("in_method"), "start_line")
    given = f.params.join(m, ["file", "type_ord", "method_ord"]).select("file", F.lit("interprocedural_param").alias("type"), F.col("name").alias("location"), F.lit("medium").alias("severity"), F.coalesce("line", "start_line").alias("line"), F.when(F.col("type").isNotNull(), 0.7).otherwise(0.5).alias("confidence"), F.col("name").alias("variable"), "in_method")
    every = f.with_text(called.unionByName(given)).withColumn("code", F.trim("text")).drop("text")
    every = picks.keep_best(every, ["file", "line", "type", "variable"], "confidence", ["location"])
    from pyspark.sql import Window

    return every.withColumn("src_ord", (F.row_number().over(Window.partitionBy("file").orderBy("line", "type", "variable")) - 1).cast("int")).select("file", "src_ord", "type", "location", "severity", "line", "confidence", "variable", "in_method", "code", F.lit(None).cast("boolean").alias("constant"), F.lit(None).cast("boolean").alias("spi"), F.lit(None).cast("boolean").alias("demo_path"))


def match_sinks(f: Facts, patterns: DataFrame) -> DataFrame:
    """Sinks by call; of those at one place with one cwe the most confident stays."""
    hit = _patterned(f, patterns)
    exact = F.coalesce(F.col("receiver_type") == F.col("p_class"), F.lit(False))
    conf = F.least(F.lit(1.0), F.lit(0.8) + F.when(F.col("p_class").isNotNull(), 0.1).otherwise(0.0) + F.when(exact, 0.05).otherwise(0.0) + F.when(F.col("p_severity") == "critical", 0.1).otherwise(0.0))
    rows = hit.select("file", F.col("p_type").alias("type"), F.col("p_cwe").alias("cwe"), F.concat_ws(".", "receiver", "method_name").alias("location"), "line", conf.alias("confidence"), F.col("method_name").alias("method"), F.col("p_arg_positions").alias("arg_positions"), F.col("p_class").alias("class"), "call_id")
    best = picks.keep_best(rows, ["file", "location", "line", "cwe"], "confidence", ["call_id", "type"])
    from pyspark.sql import Window

    return f.with_text(best).withColumn("sink_ord", (F.row_number().over(Window.partitionBy("file").orderBy("line", "type", "location")) - 1).cast("int")).select("file", "sink_ord", "type", "cwe", "location", "line", "confidence", "method", "arg_positions", "class", F.trim("text").alias("code"), F.lit(None).cast("array<string>").alias("tags"))


def match_sanitizers(f: Facts, patterns: DataFrame) -> DataFrame:
    hit = _patterned(f, patterns).select("file", F.lit("method").alias("type"), F.concat(F.col("method_name"), F.lit("()")).alias("method"), "line", F.col("p_removes").alias("sanitizes"))
    rows = picks.set_union(hit, ["file", "type", "method", "line"], "sanitizes", "sanitizes")
    return rows.withColumn("san_ord", F.lit(0))


def derived_sanitizers(f: Facts, patterns: DataFrame) -> DataFrame:
    """Methods of at most two lines whose single call is a sanitizer of a parameter: calls of them sanitize alike."""
    c = f.in_method(f.calls, "line", ["call_id"])
    alone = c.groupBy("file", "m_type", "m_name", "m_start", "m_end").agg(F.count("*").alias("n"), F.min("call_id").alias("call_id")).where("n = 1 and m_end - m_start <= 3")
    inner = alone.join(f.calls.select("file", "call_id", F.col("method_name").alias("method"), "line"), ["file", "call_id"]).join(F.broadcast(patterns.select("method", "removes")), "method")
    inner = f.with_text(inner).where(F.col("text").rlike("^\\s*return\\b"))
    given = f.params.join(f.methods.select("file", "type_ord", "method_ord", F.col("name").alias("m_name")), ["file", "type_ord", "method_ord"]).select("file", "m_name", F.col("name").alias("variable"))
    used = f.call_args.select("file", "call_id", "variable").join(inner, ["file", "call_id"]).join(given, ["file", "m_name", "variable"], "left_semi")
    outer = used.select("file", F.col("m_name").alias("method_name"), F.col("removes").alias("sanitizes")).distinct()
    return f.calls.join(outer, ["file", "method_name"]).select("file", F.lit("derived").alias("type"), F.concat("method_name", F.lit("()")).alias("method"), "line", "sanitizes", F.lit(0).alias("san_ord"))


def initial_taint(f: Facts) -> DataFrame:
    """file, id, src_ord, confidence: definitions on a source's line, on the next one when the source is a call, and its parameter."""
    s = f.taint_sources.select("file", "src_ord", F.col("line").alias("s_line"), F.col("variable").alias("s_var"), F.col("confidence").alias("s_conf"))
    d = f.dfg_defs.select("file", "id", F.col("line").alias("d_line"), "variable", "kind")
    pairs = s.join(d, "file")
    here = pairs.where("d_line = s_line").withColumn("confidence", F.lit(1.0))
    called = f.calls.select("file", F.col("line").alias("s_line")).distinct()
    nxt = pairs.where("d_line = s_line + 1 and variable = s_var").join(called, ["file", "s_line"], "left_semi").withColumn("confidence", F.lit(NEXT_LINE))
    given = pairs.where("d_line = 0 and kind = 'param' and variable = s_var").withColumn("confidence", F.lit(1.0))
    return here.unionByName(nxt.select(here.columns)).unionByName(given.select(here.columns)).groupBy("file", "id", "src_ord").agg(F.max("confidence").alias("confidence"))


def propagate(f: Facts) -> DataFrame:
    """file, src_ord, id, depth, confidence: tainted definitions. A chain into a line with a sanitizer that removes anything is not taken."""
    lines = f.dfg_defs.select("file", F.col("id").alias("to_def"), "line")
    clean = f.taint_sanitizers.where(F.size("sanitizes") > 0).select("file", "line").distinct()
    blocked = f.dfg_chains.join(lines, ["file", "to_def"]).join(clean, ["file", "line"]).select("file", "from_def", "to_def")
    return graph.with_decay(initial_taint(f), f.dfg_chains, ["file"], "id", "from_def", "to_def", HOP, blocked, ["src_ord"])


def sanitized_sinks(f: Facts) -> DataFrame:
    """file, sink_ord: sinks on whose line, or on a definition that leads to them, a sanitizer covers their type. At most BACKWARD steps back."""
    k = f.taint_sinks.select("file", "sink_ord", F.col("type").alias("k_type"), F.col("line").alias("k_line"))
    start = f.dfg_uses.where("def_id is not null").select("file", F.col("line").alias("k_line"), F.col("def_id").alias("id")).join(k, ["file", "k_line"])
    back = graph.reachable(start.select("file", "sink_ord", "id"), f.dfg_chains.join(k.select("file", "sink_ord"), "file"), ["file", "sink_ord"], "id", "to_def", "from_def", at_most=BACKWARD)
    lines = back.join(f.dfg_defs.select("file", "id", "line"), ["file", "id"]).select("file", "sink_ord", "line").unionByName(k.select("file", "sink_ord", F.col("k_line").alias("line"))).distinct()
    covered = lines.join(f.taint_sanitizers.select("file", "line", "sanitizes"), ["file", "line"]).join(k.select("file", "sink_ord", "k_type"), ["file", "sink_ord"]).where(F.array_contains("sanitizes", F.col("k_type")))
    return covered.select("file", "sink_ord").distinct()


def flows(f: Facts) -> DataFrame:
    """The taint_flows table: a tainted definition is used by a dangerous argument of a sink; one row for each source line, sink line and sink type."""
    t = propagate(f)
    s = f.taint_sources.select("file", "src_ord", F.col("type").alias("source_type"), F.col("line").alias("source_line"), F.col("confidence").alias("s_conf"))
    k = f.taint_sinks.select("file", "sink_ord", F.col("type").alias("sink_type"), F.col("line").alias("sink_line"), "method", "arg_positions", "tags")
    u = f.dfg_uses.where("def_id is not null").select("file", F.col("line").alias("sink_line"), F.col("variable").alias("used"), F.col("def_id").alias("id")).distinct()
    args = f.call_args.join(f.calls.select("file", "call_id", F.col("line").alias("sink_line"), F.col("method_name").alias("method")), ["file", "call_id"])
    at = k.join(args, ["file", "sink_line", "method"]).where(F.col("arg_positions").isNull() | (F.size("arg_positions") == 0) | F.array_contains("arg_positions", F.col("position")))
    named = at.select("file", "sink_ord", "sink_line", "sink_type", "tags", F.explode(identifiers("expression")).alias("used")).distinct()
    hit = named.join(u, ["file", "sink_line", "used"]).join(t, ["file", "id"]).join(s, ["file", "src_ord"])
    hit = hit.join(F.broadcast(rules.reach(f.spark)), ["source_type", "sink_type"], "left_semi").join(sanitized_sinks(f), ["file", "sink_ord"], "left_anti")
    rows = hit.select("file", "source_line", "sink_line", "source_type", "sink_type", F.col("depth").alias("hops"), (F.col("confidence") * FLOW).alias("confidence"), F.lit(False).alias("sanitized"), "tags")
    return picks.keep_first(rows, ["file", "source_line", "sink_line", "sink_type"], ["hops", F.col("confidence").desc(), "source_type"])


def paths(f: Facts, most_hops: int = 50, per_sink: int = 10, branching: int = 3) -> DataFrame:
    """file, sink_ord, path, length: simple paths of definitions from sources to sinks, the shortest of each sink first."""
    seeds = initial_taint(f).select("file", "id").distinct()
    every = graph.simple_paths(seeds, f.dfg_chains, ["file"], "id", "from_def", "to_def", most_hops, branching)
    k = f.taint_sinks.select("file", "sink_ord", F.col("line").alias("k_line"))
    ends = f.dfg_uses.where("def_id is not null").select("file", F.col("def_id").alias("id"), F.col("line").alias("k_line")).join(k, ["file", "k_line"]).select("file", "id", "sink_ord").distinct()
    hit = every.join(ends, ["file", "id"]).withColumn("length", F.size("path"))
    return picks.capped(hit, ["file", "sink_ord"], ["length", "path"], per_sink).select("file", "sink_ord", "path", "length")


def verify(f: Facts, most_hops: int = 30) -> DataFrame:
    """file, src_ord, sink_ord, found, sanitized, length, confidence for each source-sink pair that the reach matrix allows.

    The shortest way from the source's definitions to a use on the sink's line decides: direct ones count more, long ones less.
    """
    s = f.taint_sources.select("file", "src_ord", F.col("type").alias("source_type"))
    k = f.taint_sinks.select("file", "sink_ord", F.col("type").alias("sink_type"), F.col("line").alias("k_line"))
    pairs = joins.reach_pairs(s, k, rules.reach(f.spark), ["file"])
    seeds = initial_taint(f).select("file", "src_ord", "id")
    e = f.dfg_chains.join(seeds.select("file", "src_ord").distinct(), "file")
    reach = graph.reachable(seeds, e, ["file", "src_ord"], "id", "from_def", "to_def", at_most=most_hops)
    u = f.dfg_uses.where("def_id is not null").select("file", F.col("def_id").alias("id"), F.col("line").alias("k_line")).distinct()
    length = reach.join(u, ["file", "id"]).join(k.select("file", "sink_ord", "k_line"), ["file", "k_line"]).groupBy("file", "src_ord", "sink_ord").agg((F.min("depth") + 1).alias("length"))
    clean = sanitized_sinks(f).withColumn("sanitized", F.lit(True))
    v = pairs.join(length, ["file", "src_ord", "sink_ord"], "left").join(clean, ["file", "sink_ord"], "left")
    n = F.col("length")
    sure = F.lit(0.9) + F.when(n <= 1, 0.05).otherwise(0.0) - F.when(n > 10, 0.15).when(n > 5, 0.05).otherwise(0.0)
    conf = F.when(n.isNull(), 0.2).when(F.col("sanitized"), 0.1).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.5), sure)))
    return v.select("file", "src_ord", "sink_ord", n.isNotNull().alias("found"), F.coalesce("sanitized", F.lit(False)).alias("sanitized"), "length", conf.alias("confidence"))


def flow_statistics(found: DataFrame) -> DataFrame:
    """sink_type, n, confidence (mean) of flows."""
    return found.groupBy("sink_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


def generate_findings(f: Facts) -> DataFrame:
    """file, sink_line, type, cwe, severity, confidence, exploitable, sources: source-sink pairs that the reach matrix allows.

    A pair has a path where the source's taint reaches a use on the sink's line. Of pairs with the same sink the most confident stays, with all its sources; severest first.
    """
    s = f.taint_sources.where("not coalesce(constant, false)").select("file", "src_ord", F.col("type").alias("source_type"), F.col("line").alias("source_line"), F.col("confidence").alias("s_conf"), F.coalesce("spi", F.lit(False)).alias("spi"))
    k = f.taint_sinks.select("file", "sink_ord", F.col("type").alias("sink_type"), F.col("line").alias("sink_line"), F.col("confidence").alias("k_conf"))
    pairs = joins.reach_pairs(s, k, rules.reach(f.spark), ["file"]).where("not spi or sink_type = 'code_injection'")
    u = f.dfg_uses.where("def_id is not null").select("file", F.col("line").alias("sink_line"), F.col("def_id").alias("id")).distinct()
    reached = propagate(f).join(u, ["file", "id"]).groupBy("file", "src_ord", "sink_line").agg(F.min("depth").alias("hops"))
    p = pairs.join(reached, ["file", "src_ord", "sink_line"], "left").withColumn("path", F.col("hops").isNotNull())
    p = p.withColumn("confidence", rules.api_confidence(F.col("path"), F.coalesce("hops", F.lit(0)), F.col("s_conf"), F.col("k_conf"), F.abs(F.col("source_line") - F.col("sink_line"))))
    p = p.withColumn("severity", rules.severity(F.col("path"), F.col("source_type"), F.col("sink_type"), F.lit(0.5)))
    all_sources = p.groupBy("file", "sink_line", "sink_type").agg(F.array_sort(F.collect_set("source_line")).alias("sources"))
    best = picks.keep_best(p, ["file", "sink_line", "sink_type"], "confidence", ["src_ord", "sink_ord"])
    out = best.join(all_sources, ["file", "sink_line", "sink_type"]).join(F.broadcast(rules.rule_dimension(f.spark).select("sink_type", "cwe")), "sink_type", "left")
    rank = F.array_position(F.array(*map(F.lit, ["critical", "high", "medium", "low"])), F.col("severity"))
    return out.select("file", "sink_line", F.col("sink_type").alias("type"), "cwe", "severity", "confidence", (F.col("path") & (F.col("confidence") > 0.7)).alias("exploitable"), "sources").orderBy(rank, F.col("confidence").desc(), "file", "sink_line", "type")


def entry_distance(entries: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, method, depth, parent, seed: how each method is reached from the nearest entry point; one search from all of them."""
    return graph.shortest_with_parent(entries, calls, keys, "method", "caller", "callee")
