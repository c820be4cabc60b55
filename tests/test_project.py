import pytest

from factmill.facts import SCHEMAS, Facts
from factmill.plans import project


def facts(spark, **tables):
    made = {}
    for name, rows in tables.items():
        schema = spark.createDataFrame([], SCHEMAS[name]).schema
        made[name] = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    return Facts(spark, made)


def method(file, type_name, name, start, end, ordinal=0, **o):
    return {"file": file, "type_ord": 0, "method_ord": ordinal, "type_name": type_name, "name": name, "start_line": start, "end_line": end, "modifiers": ["public"], "annotations": []} | o


def call(file, n, name, line, receiver=None, receiver_type=None):
    return {"file": file, "call_id": n, "method_name": name, "line": line, "receiver": receiver, "receiver_type": receiver_type}


@pytest.fixture(scope="module")
def app(spark):
    """A controller reads a parameter and hands it to a service in another file, whose query is a sink; a tool class has a sink that nobody reaches."""
    lines = {"C.java": ["class Ctl {", " void list() {", "  String q = req.getParameter(\"q\");", "  svc.find(q);", " }", "}"], "S.java": ["class Svc {", " List find(String s) {", "  return db.query(s);", " }", "}"], "U.java": ["class U {", " void lone(String t) {", "  db.query(t);", " }", "}"]}
    return facts(
        spark,
        files=[{"file": f, "language": "java", "project_profile": "application/production"} for f in lines],
        source_lines=[{"file": f, "line": i, "text": t} for f, ts in lines.items() for i, t in enumerate(ts, 1)],
        types=[{"file": "C.java", "type_ord": 0, "name": "Ctl", "kind": "class", "annotations": ["RestController"], "start_line": 1, "end_line": 6}, {"file": "S.java", "type_ord": 0, "name": "Svc", "kind": "class", "annotations": [], "implements": ["Finder<T>"], "start_line": 1, "end_line": 5}, {"file": "U.java", "type_ord": 0, "name": "U", "kind": "class", "annotations": [], "extends": "Svc", "start_line": 1, "end_line": 5}],
        methods=[method("C.java", "Ctl", "list", 2, 5), method("S.java", "Svc", "find", 2, 4), method("U.java", "U", "lone", 2, 4)],
        params=[{"file": "S.java", "type_ord": 0, "method_ord": 0, "position": 0, "name": "s", "line": 2}],
        calls=[call("C.java", 0, "getParameter", 3, "req"), call("C.java", 1, "find", 4, "svc", "Svc"), call("S.java", 0, "query", 3, "db"), call("U.java", 0, "query", 3, "db")],
        call_args=[{"file": "C.java", "call_id": 1, "position": 0, "expression": "q"}, {"file": "S.java", "call_id": 0, "position": 0, "expression": "s"}],
        dfg_defs=[{"file": "C.java", "id": 0, "variable": "q", "line": 3, "kind": "local"}, {"file": "S.java", "id": 0, "variable": "s", "line": 2, "kind": "param"}],
        dfg_uses=[{"file": "C.java", "id": 0, "variable": "q", "line": 4, "def_id": 0}, {"file": "S.java", "id": 0, "variable": "s", "line": 3, "def_id": 0}],
        taint_sources=[{"file": "C.java", "src_ord": 0, "type": "http_param", "line": 3, "variable": "q", "confidence": 1.0}],
        taint_sinks=[{"file": "S.java", "sink_ord": 0, "type": "sql_injection", "line": 3, "confidence": 0.9, "method": "query"}, {"file": "U.java", "sink_ord": 0, "type": "sql_injection", "line": 3, "confidence": 0.9, "method": "query"}],
    )


def test_entry_paths(spark, app):
    tiers = {r.key.split("#")[2]: r.tier for r in project.entry_tiers(app).collect()}
    assert tiers == {"list": "entry", "find": "reachable", "lone": "library"}
    schema = spark.createDataFrame([], SCHEMAS["findings"]).schema
    row = lambda f, n, **o: tuple(({"file": f, "id": n, "category": "security", "rule_id": "sql_injection", "severity": "critical", "line": 3} | o).get(c.name) for c in schema)
    found = spark.createDataFrame([row("S.java", "a"), row("U.java", "b"), row("U.java", "c", rule_id="weak-hash"), row("U.java", "d", severity="low")], schema)
    got = {r.id: (r.entry_path_tier, r.entry_distance) for r in project.require_entry_path(app, found, ["sql_injection"]).collect()}
    assert got == {"a": ("tier1-entry-point", 1), "c": (None, None), "d": (None, None)}
    library = app.with_tables(files=app.files.selectExpr("file", "language", "loc", "hash", "package", "'library/dev' as project_profile"))
    assert project.require_entry_path(library, found, ["sql_injection"]).count() == 4


def test_across_files(app):
    (p,) = project.cross_file_paths(app).collect()
    assert (p.source_file, p.source_line, p.sink_type, p.call_line, p.target.split("#")[:3], p.confidence) == ("C.java", 3, "sql_injection", 4, ["S.java", "Svc", "find"], 0.7)
    (e,) = project.interprocedural(app).collect()
    assert (e.call_line, e.tainted_args, e.returns_taint) == (4, [0], False)
    assert [len(r.path) for r in project.taint_method_paths(app).collect()] == [2]
    assert {(r.file, r.type, r.how) for r in project.reachable_sinks(app).collect()} == {("S.java", "sql_injection", "cross-file")}
    clean = project.without_sanitized(project.cross_file_paths(app), app.spark.createDataFrame([("C.java", 0, "m", "esc()", 4, ["sql_injection"])], SCHEMAS["taint_sanitizers"]))
    assert clean.count() == 0


def test_hierarchy_and_symbols(spark, app):
    h = {(r.sub, r["super"]): r.hops for r in project.hierarchy(app).collect()}
    assert h == {("U", "Svc"): 1, ("U", "Finder"): 2, ("Svc", "Finder"): 1}
    pairs = spark.createDataFrame([("U", "Finder"), ("Finder", "U"), ("Ctl", "Svc"), ("U", "U")], "a string, b string")
    assert {tuple(r) for r in project.could_be(project.hierarchy(app), pairs).collect()} == {("U", "Finder"), ("Finder", "U"), ("U", "U")}
    names = spark.createDataFrame([("C.java", "Svc"), ("C.java", "None")], "file string, name string")
    assert {r.name: r.fqn for r in project.resolve(app, names).collect()} == {"Svc": "Svc", "None": None}
    r = spark.createDataFrame([("pstmt", None), ("x", "T"), ("myConn", None), ("y", None)], "a string, b string").select("a", project.receiver_type(project.F.col("a"), project.F.col("b")).alias("t"))
    assert {x.a: x.t for x in r.collect()} == {"pstmt": "Statement", "x": "T", "myConn": "Connection", "y": None}


def test_profiles(spark):
    files = spark.createDataFrame([("a/src/main/X.java",), ("a/b/src/test/Y.java",), ("c/z.py",), ("demo/q.js",)], "file string")
    modules = spark.createDataFrame([("a", ["org.springframework.boot spring-boot"], None, [], False), ("a/b", ["java-library"], None, ["https://repo"], False), ("demo", [], None, [], True)], "root string, plugins array<string>, packaging string, distribution_urls array<string>, has_main boolean")
    modules = modules.selectExpr("*", "false as has_jpms", "false as has_spi")
    got = {r.file: r.project_profile for r in project.profiles(files, modules).collect()}
    assert got == {"a/src/main/X.java": "server/production", "a/b/src/test/Y.java": "library/test", "c/z.py": "unknown", "demo/q.js": "application/sample"}
    over = project.profiles(files, modules, [("**/*.py", "cli/dev"), ("c/**", "server/dev")])
    assert {r.file: r.project_profile for r in over.collect()}["c/z.py"] == "cli/dev"


def test_gates(spark, app):
    library = app.with_tables(files=app.files.selectExpr("file", "language", "loc", "hash", "package", "'library/dev' as project_profile"), taint_sources=app.taint_sources.unionByName(app.spark.createDataFrame([("S.java", 1, "interprocedural_param", "s", "medium", 2, 0.7, "s", "find", None, None, None, None)], SCHEMAS["taint_sources"])))
    assert project.library_sources(library).taint_sources.count() == 1 and library.taint_sources.count() == 2
    assert project.library_sinks(library).taint_sinks.count() == 2
    known = spark.createDataFrame([("Db#query", ["sql_injection"])], "signature string, overrides array<string>")
    typed = app.with_tables(taint_sinks=app.taint_sinks.withColumn("class", project.F.lit("Db")))
    assert project.known_semantics(typed, known).taint_sinks.count() == 0 and project.known_semantics(app, known).taint_sinks.count() == 2
    assert project.filtered_sinks(app).taint_sinks.count() == 2
    tagged = project.tag_sources(app).taint_sources.first()
    assert (tagged.constant, tagged.spi, tagged.demo_path) == (False, False, False)
    assert project.command_line_reflection(app).taint_sinks.count() == 2
    deps = spark.createDataFrame([("com.alibaba:fastjson", "2.0.4")], "name string, version string")
    risky = app.with_tables(taint_sinks=app.taint_sinks.withColumn("type", project.F.lit("deserialization")))
    assert project.safe_deserialization(risky, deps).taint_sinks.count() == 0
    assert project.enriched(app).where("trust_boundary").count() == 1
    assert project.unresolved(app).count() == 0 and project.polymorphic_targets(app).count() == 0 and project.escaping_taint(app).count() >= 0
    assert project.wrapped_sources(app).count() == 0 and project.field_taint(app).count() == 0
