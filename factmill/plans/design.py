"""Passes on names, types, documentation and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import identifiers, simple_name, strip_generics
from ..operators import graph, joins, picks
from .findings import findings
from .registry import register

# Fixed values.
SKIPPED_NAMES = "_ unused e err error ex exception i j k n idx index boolean string number object symbol undefined null never void any unknown bigint".split()
PRIMITIVES = "void boolean byte short int long float double char string number object any never unknown String Integer Long Double Boolean Object Number null undefined".split()
FAN_OUT, DEPTH, DEPTH_GUARD, ANCESTORS = 20, 5, 20, 10
WMC, LCOM2, CBO, VOTES = 47, 0.8, 14, 2
ENVY_LEAST, ENVY_MARGIN = 4, 2
TEST_PATH = "[./](?:test|spec)[./]|\\.(?:test|spec)\\.[jt]s$"


@register("unused-variable", "maintainability")
def unused_variable(f: Facts) -> DataFrame:
    """Local definitions that no use reaches and whose name stands nowhere else.

    An inverted index of identifiers by line answers where a name stands; a later definition of the same name ends a declaration's reach.
    """
    named = f.source_lines.select("file", F.col("line").alias("at"), F.explode(identifiers("text")).alias("variable"))
    d = f.dfg_defs.where((F.col("kind") == "local") & ~F.col("variable").startswith("_") & ~F.col("variable").isin(SKIPPED_NAMES) & ~F.col("file").rlike(TEST_PATH))
    d = f.with_text(d).where(~F.col("text").rlike("\\bcatch\\s*\\(|\\bexport\\b"))
    used = f.dfg_uses.where("def_id is not null").select("file", F.col("def_id").alias("id")).distinct()
    d = d.join(used, ["file", "id"], "left_anti")
    others = f.dfg_defs.select("file", "variable", F.col("id").alias("o_id"), F.col("line").alias("o_line"))
    pairs = d.select("file", "id", "variable", "line").join(others, ["file", "variable"]).where("o_id != id")
    next_def = pairs.groupBy("file", "id").agg(F.min(F.when(F.col("o_line") > F.col("line"), F.col("o_line"))).alias("next_line"), F.lit(True).alias("redefined"))
    d = d.join(next_def, ["file", "id"], "left")
    declares = F.col("text").rlike("\\b(?:let|const|var)\\s+[\\w{\\[]|\\b(?:int|long|float|double|boolean|byte|char|short|var|final)\\b|\\b[A-Z]\\w*(?:<[^>]*>)?\\s+\\w|\\blet\\s+(?:mut\\s+)?\\w")
    stands = d.join(named, ["file", "variable"]).where("at != line")
    stands = stands.join(pairs.select("file", "id", F.col("o_line").alias("at")).distinct(), ["file", "id", "at"], "left_anti")
    stands = stands.where(F.col("redefined").isNull() | ~declares | F.col("next_line").isNull() | (F.col("at") <= F.col("next_line")))
    d = joins.first_match(d.join(stands.select("file", "id").distinct(), ["file", "id"], "left_anti"), ["file", "variable", "line"], ["id"])
    return findings(d, "unused-variable", "maintainability", "CWE-561", "low", "note", F.format_string("'%s' is given a value that is never read", "variable"), snippet=F.trim("text"), fix="Remove it or use it", evidence={"variable": "variable"})


@register("variable-shadowing", "maintainability")
def variable_shadowing(f: Facts) -> DataFrame:
    """A local variable with the name of a parameter of its method."""
    d = f.in_method(f.dfg_defs.where("line > 0"), "line", ["id"])
    p = d.where("kind = 'param'").select("file", "m_start", "m_type", "variable", F.col("line").alias("outer_line")).dropDuplicates(["file", "m_start", "m_type", "variable"])
    hit = f.with_text(d.where("kind = 'local'")).where(F.col("text").rlike("\\b(?:let|const|var|int|long|float|double|boolean|String)\\b")).join(p, ["file", "m_start", "m_type", "variable"])
    hit = joins.first_match(hit, ["file", "variable", "m_start"], ["line"])
    return findings(hit, "variable-shadowing", "maintainability", "CWE-1109", "medium", "warning", F.format_string("'%s' hides the parameter from line %d", "variable", "outer_line"), snippet=F.trim("text"), fix="Give it another name", evidence={"variable": "variable", "outer_line": "outer_line"})


@register("leaked-global", "maintainability")
def leaked_global(f: Facts) -> DataFrame:
    """Assignments in a function to names that nothing declares."""
    t = f.of_language(f.source_lines, "javascript", "typescript").withColumn("variable", F.regexp_extract("text", "^\\s*([A-Za-z_$][\\w$]*)\\s*=(?![=>])", 1)).where("variable != ''")
    t = f.in_method(t, "line", ["line"])
    declared = f.source_lines.withColumn("variable", F.explode(F.regexp_extract_all("text", F.lit("\\b(?:let|const|var|function|class)\\s+([A-Za-z_$][\\w$]*)"), F.lit(1)))).select("file", "variable")
    known = declared.unionByName(f.params.select("file", F.col("name").alias("variable"))).unionByName(f.fields.select("file", F.col("name").alias("variable"))).unionByName(f.imports.select("file", F.coalesce("alias", "imported_name").alias("variable"))).distinct()
    hit = joins.first_match(t.join(known, ["file", "variable"], "left_anti"), ["file", "variable"], ["line"])
    return findings(hit, "leaked-global", "maintainability", "CWE-1109", "medium", "warning", F.format_string("'%s' is assigned but declared nowhere: it becomes global", "variable"), snippet=F.trim("text"), fix="Declare it", evidence={"variable": "variable"})


@register("dependency-fan-out", "architecture")
def dependency_fan_out(f: Facts, threshold: int = FAN_OUT) -> DataFrame:
    n = f.imports.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return findings(n.withColumn("line", F.lit(1)), "dependency-fan-out", "architecture", None, "low", "note", F.concat(F.lit("The module imports "), F.col("n").cast("string"), F.lit(f" others, {threshold} or more")), evidence={"importCount": "n"})


@register("stale-doc-ref", "maintainability")
def stale_doc_ref(f: Facts) -> DataFrame:
    """{@link X} and @see X in documentation blocks, where X is neither a type of the file nor imported."""
    t = f.source_lines.where(F.col("text").rlike("\\{@link\\s|@see\\s") & F.col("text").rlike("^\\s*(/\\*\\*|\\*)"))
    t = t.withColumn("raw", F.explode(F.array_union(F.regexp_extract_all("text", F.lit("\\{@link\\s+([\\w.#]+)"), F.lit(1)), F.regexp_extract_all("text", F.lit("@see\\s+([\\w.#]+)"), F.lit(1)))))
    t = t.withColumn("ref", simple_name(F.substring_index("raw", "#", 1)))
    known = f.types.select("file", F.col("name").alias("ref")).unionByName(f.imports.where("imported_name not in ('*', 'default')").select("file", F.col("imported_name").alias("ref"))).unionByName(f.imports.where("alias is not null").select("file", F.col("alias").alias("ref"))).distinct()
    return findings(t.join(known, ["file", "ref"], "left_anti"), "stale-doc-ref", "maintainability", None, "low", "note", F.format_string("The comment refers to '%s', which is not known here", "ref"), evidence={"ref": "ref", "raw": "raw"})


def _parents(f: Facts) -> DataFrame:
    p = f.types.where("extends is not null").select("file", "name", strip_generics(F.col("extends")).alias("parent")).where("parent != ''")
    return p.dropDuplicates(["file", "name"])


@register("deep-inheritance", "architecture")
def deep_inheritance(f: Facts) -> DataFrame:
    """Classes with more than DEPTH ancestors, counted up to and including the first that is not in the file; a cycle ends the count."""
    parents = _parents(f)
    t = f.of_language(f.types, "rust", "bash", but=True).where("kind = 'class' and start_line > 0")
    up = graph.simple_paths(t.select("file", "name"), parents, ["file"], "name", "name", "parent", DEPTH_GUARD)
    last = joins.first_match(up.withColumn("class", F.get("path", F.lit(0))).withColumn("depth", F.size("path") - 1), ["file", "class"], [F.col("depth").desc()])
    closed = last.join(parents, ["file", "name"], "left").withColumn("depth", F.when(F.col("parent").isNotNull() & F.array_contains("path", F.col("parent")), F.col("depth") + 1).otherwise(F.col("depth")))
    deep = t.join(closed.select("file", F.col("class").alias("name"), F.least("depth", F.lit(DEPTH_GUARD)).alias("depth")), ["file", "name"]).where(F.col("depth") > DEPTH)
    return findings(deep, "deep-inheritance", "architecture", "CWE-1086", "low", "warning", F.format_string("Class `%s` has %d ancestors", "name", "depth"), "start_line", fix="Prefer composition", evidence={"depth": "depth"})


@register("missing-override", "maintainability")
def missing_override(f: Facts) -> DataFrame:
    """Methods with the name of a method of an ancestor class in the file, without @Override."""
    java = f.of_language(f.methods, "java")
    up = graph.closure(_parents(f), ["file"], "name", "parent", at_most=ANCESTORS).select("file", F.col("src").alias("type_name"), F.col("dst").alias("ancestor"))
    theirs = java.select("file", F.col("type_name").alias("ancestor"), "name").distinct()
    own = java.where((F.col("name") != F.col("type_name")) & ~F.coalesce(F.arrays_overlap("modifiers", F.array(*map(F.lit, ("private", "static", "abstract")))), F.lit(False)) & ~F.coalesce(F.array_contains("annotations", "Override"), F.lit(False)))
    hit = own.join(up.where("ancestor != type_name").join(theirs, ["file", "ancestor"]).select("file", "type_name", "name").distinct(), ["file", "type_name", "name"], "left_semi")
    hit = joins.first_match(hit, ["file", "type_name", "name"], ["type_ord", "method_ord"])
    return findings(hit, "missing-override", "maintainability", None, "low", "warning", F.format_string("`%s()` of `%s` overrides a method without saying so", "name", "type_name"), "start_line", fix="Add @Override")


@register("unused-interface-method", "maintainability")
def unused_interface_method(f: Facts) -> DataFrame:
    i = f.of_language(f.types, "java", "typescript").where("kind = 'interface'").select("file", "type_ord")
    m = f.methods.join(i, ["file", "type_ord"], "left_semi")
    called = f.calls.select("file", F.col("method_name").alias("name")).distinct()
    hit = joins.first_match(m.join(called, ["file", "name"], "left_anti"), ["file", "type_name", "name"], ["type_ord", "method_ord"])
    return findings(hit, "unused-interface-method", "maintainability", None, "low", "note", F.format_string("`%s()` of the interface `%s` is called nowhere in the file", "name", "type_name"), "start_line", fix="Remove it, or make sure that other files call it")


@register("todo-in-prod", "maintainability")
def todo_in_prod(f: Facts) -> DataFrame:
    """FIXME, HACK, TODO and XXX in comments, outside of tests."""
    t = f.source_lines.where(~F.col("file").rlike(TEST_PATH)).withColumn("mark", F.regexp_extract("text", "(?:^|[^A-Za-z0-9_])(FIXME|HACK|TODO|XXX)(?:$|[^A-Za-z0-9_])", 1)).where("mark != ''")
    return findings(t, "todo-in-prod", "maintainability", None, F.when(F.col("mark").isin("FIXME", "HACK"), "medium").otherwise("low"), "note", F.format_string("%s left in the code", "mark"), snippet=F.trim("text"), fix="Do it or move it to the issue tracker", evidence={"marker": "mark"})


def class_measures(f: Facts) -> DataFrame:
    """file, type_ord, name, start_line, n_methods, wmc, lcom2, cbo of classes with two methods or more."""
    from .metrics import method_complexity

    m = f.methods
    t = f.of_language(f.types, "bash", "rust", but=True).where("kind = 'class'").select("file", "type_ord", "name", "start_line")
    n = m.groupBy("file", "type_ord").agg(F.count("*").alias("n_methods"), F.min("start_line").alias("first"), F.max("end_line").alias("last")).where("n_methods >= 2")
    wmc = method_complexity(f).groupBy("file", "type_ord").agg(F.sum("complexity").alias("wmc"))
    members = m.select("file", "type_ord", "method_ord", "start_line", "end_line")
    uses = f.dfg_uses.select("file", "line", "variable").unionByName(f.dfg_defs.select("file", "line", "variable")).withColumnRenamed("variable", "field")
    uses = joins.range_join(uses, members, ["file"], "line", "start_line", "end_line").join(f.fields.select("file", "type_ord", F.col("name").alias("field")).distinct(), ["file", "type_ord", "field"])
    cohesion = picks.lcom2(picks.shared_pairs(members, uses, ["file", "type_ord"], "method_ord", "field"))
    has_fields = f.fields.select("file", "type_ord").distinct().withColumn("fields", F.lit(True))
    calls = f.calls.where("receiver_type is not null").select("file", "line", strip_generics(F.col("receiver_type")).alias("other"))
    cbo = joins.range_join(calls, n.join(t, ["file", "type_ord"]).select("file", "type_ord", "name", "first", "last"), ["file"], "line", "first", "last").where(~F.col("other").isin(PRIMITIVES) & (F.col("other") != F.col("name"))).groupBy("file", "type_ord").agg(F.count_distinct("other").alias("cbo"))
    key = ["file", "type_ord"]
    out = t.join(n, key).join(wmc, key, "left").join(cohesion.select(*key, "lcom2"), key, "left").join(has_fields, key, "left").join(cbo, key, "left")
    return out.select(*key, "name", "start_line", "n_methods", F.coalesce("wmc", F.lit(0)).alias("wmc"), F.when(F.col("fields"), F.col("lcom2")).otherwise(F.lit(0.0)).alias("lcom2"), F.coalesce("cbo", F.lit(0)).alias("cbo"))


@register("god-class", "architecture")
def god_class(f: Facts) -> DataFrame:
    """Classes that are too complex, too little cohesive or too much coupled: two of the three."""
    c = class_measures(f)
    over = [F.col("wmc") > WMC, F.col("lcom2") > LCOM2, F.col("cbo") > CBO]
    hit = c.where(picks.vote(over, VOTES))
    return findings(hit, "god-class", "architecture", "CWE-1060", "medium", "warning", F.format_string("Class `%s` does too much (WMC %d, LCOM2 %.2f, CBO %d)", "name", "wmc", "lcom2", "cbo"), "start_line", fix="Split it", evidence={"wmc": "wmc", "lcom2": "lcom2", "cbo": "cbo"})


@register("feature-envy", "architecture", default=False)
def feature_envy(f: Facts) -> DataFrame:
    """Methods that call one other type far more often than their own."""
    c = f.in_method(f.calls.where("receiver_type is not null"), "line", ["call_id"])
    n = c.groupBy("file", "m_type", "m_name", "m_start", "receiver_type").agg(F.count("*").alias("n"), F.min("call_id").alias("first"))
    own = n.where("receiver_type = m_type").select("file", "m_type", "m_name", "m_start", F.col("n").alias("own"))
    best = joins.first_match(n.where("receiver_type != m_type"), ["file", "m_type", "m_name", "m_start"], [F.col("n").desc(), "first"])
    hit = best.join(own, ["file", "m_type", "m_name", "m_start"], "left").withColumn("own", F.coalesce("own", F.lit(0))).where((F.col("n") >= ENVY_LEAST) & (F.col("n") > F.col("own") + ENVY_MARGIN))
    return findings(hit, "feature-envy", "architecture", "CWE-1060", "low", "note", F.format_string("`%s()` calls %s %d times and its own type %d times", "m_name", "receiver_type", "n", "own"), "m_start", fix="Move the method")


def import_edges(f: Facts) -> DataFrame:
    """Relative imports as edges file -> file: of the names that an import may mean the first that exists."""
    folder = F.regexp_replace("file", "[^/]*$", "")
    from ..functions.text import normalised_path

    base = normalised_path(F.concat(folder, F.col("from_package")))
    stem = F.regexp_replace(base, "\\.js$", "")
    names = F.array(base, F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")), F.concat(stem, F.lit(".js")), F.concat(stem, F.lit(".jsx")), F.concat(base, F.lit(".py")), F.concat(base, F.lit("/index.ts")), F.concat(base, F.lit("/index.js")), F.concat(base, F.lit("/__init__.py")))
    i = f.imports.where(F.col("from_package").startswith(".")).select("file", "from_package").distinct()
    hit = joins.first_probe(i, names, f.files.select(F.col("file").alias("target")), "target", ["file", "from_package"])
    return hit.where("file != target").select(F.lit("").alias("project"), F.col("file").alias("src"), F.col("target").alias("dst")).distinct()


@register("circular-dependency", "architecture")
def circular_dependency(f: Facts) -> DataFrame:
    """Groups of files that import each other; each is reported at its first file."""
    c = graph.components(import_edges(f), ["project"], "src", "dst")
    g = c.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members")).withColumnRenamed("component", "file")
    return findings(g.withColumn("line", F.lit(1)), "circular-dependency", "architecture", "CWE-1047", "medium", "warning", F.concat(F.lit("Circular dependency: "), F.array_join("members", " -> ")), evidence={"members": "members"})


@register("orphan-module", "architecture")
def orphan_module(f: Facts) -> DataFrame:
    """Files that no other file imports, but for those whose name says that they are entered from outside."""
    e = import_edges(f).select(F.col("src"), F.col("dst"))
    o = graph.orphans(f.files.select("file"), e, [], "file", "src", "dst")
    o = o.where(~F.regexp_extract("file", "([^/]*)$", 1).rlike("(?i)^(index|main|app|server|cli|__init__|__main__|setup|conftest)\\.|\\.(test|spec|config|d)\\."))
    return findings(o.withColumn("line", F.lit(1)), "orphan-module", "architecture", None, "low", "note", F.lit("No other file imports this module"))
