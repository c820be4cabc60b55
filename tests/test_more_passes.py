import pytest

from factmill.plans import catalogue, taint
from factmill.sources import constants, files, python_source
from tests.test_passes import METHOD, facts, run


def test_documentation(spark):
    code = ["/** doc */", "@Ann", "class A {", " public void a() {}", "", " // no", " public void b() {}", " /** x", "  */", " public void c() {}", "}"]
    t = [{"type_ord": 0, "name": "A", "kind": "class", "start_line": 3, "end_line": 11}]
    m = [{"type_ord": 0, "method_ord": i, "type_name": "A", "name": n, "modifiers": ["public"], "start_line": at, "end_line": at} for i, (n, at) in enumerate([("a", 4), ("b", 7), ("c", 10)])]
    f = facts(spark, lines=code, types=t, methods=m)
    assert [x[0] for x in run(f, "missing-public-doc")] == [4, 7]
    py = facts(spark, "python", ["def f(x):", "    \"\"\"Doc.\"\"\"", "def g(x):", "    return 1", "def _h():", "    pass"], methods=[{"type_ord": 0, "method_ord": i, "type_name": "<module>", "name": n, "modifiers": [], "start_line": at, "end_line": at + 1} for i, (n, at) in enumerate([("f", 1), ("g", 3), ("_h", 5)])])
    assert [x[0] for x in run(py, "missing-public-doc")] == [3]


def test_names(spark):
    f = facts(spark, types=[{"type_ord": 0, "name": "bad_class", "kind": "class", "start_line": 1}, {"type_ord": 1, "name": "Good", "kind": "class", "start_line": 5}], methods=[{"type_ord": 0, "method_ord": 0, "type_name": "bad_class", "name": "Do_it", "start_line": 2}, {"type_ord": 1, "method_ord": 0, "type_name": "Good", "name": "toString", "start_line": 6}], fields=[{"type_ord": 0, "name": "maxSize", "modifiers": ["static", "final"]}, {"type_ord": 0, "name": "any_thing", "modifiers": []}])
    assert [x[0] for x in run(f, "naming-convention")] == [1, 1, 2]


def test_streams_and_jsx(spark):
    f = facts(spark, "javascript", ["function a() {", " const t = await res.json();", "}", "function b() {", " res.text(); x.pipe(y);", "}", "<Comp data={{a: 1}} style={{b: 2}} onClick={() => go()} />"], methods=[METHOD[0] | {"end_line": 3}, METHOD[0] | {"method_ord": 1, "name": "n", "start_line": 4, "end_line": 6}])
    assert [x[0] for x in run(f, "missing-stream")] == [2]
    assert [x[0] for x in run(f, "react-inline-jsx")] == [7, 7]


def guarded(spark, edges, guard="checkAccess"):
    blocks = [{"id": i, "type": "normal", "start_line": a, "end_line": b} for i, (a, b) in enumerate([(1, 1), (2, 3), (4, 5), (6, 9)])]
    calls = [{"call_id": 0, "method_name": guard, "line": 2}, {"call_id": 1, "method_name": "deleteUser", "line": 7}]
    return facts(spark, methods=METHOD, cfg_blocks=blocks, cfg_edges=[{"from": a, "to": b, "type": "sequential"} for a, b in edges], calls=calls)


def test_guards(spark):
    assert run(guarded(spark, [(0, 1), (1, 3)]), "missing-guard-dom") == []
    assert run(guarded(spark, [(0, 1), (0, 2), (1, 3), (2, 3)]), "missing-guard-dom") == [(7, "missing-guard-dom", "high")]
    assert run(guarded(spark, [(0, 1), (1, 3)], "other"), "missing-guard-dom") == [(7, "missing-guard-dom", "high")]


def test_binding_and_caches(spark):
    types = [{"type_ord": 0, "name": "C", "kind": "class", "annotations": ["@RestController"], "start_line": 1, "end_line": 9}]
    methods = [METHOD[0] | {"annotations": ["@PostMapping(\"/x\")"]}]
    param = lambda **o: [{"type_ord": 0, "method_ord": 0, "position": 0, "name": "user", "type": "User", "annotations": []} | o]
    assert len(run(facts(spark, types=types, methods=methods, params=param()), "spring4shell")) == 1
    assert run(facts(spark, types=types, methods=methods, params=param(annotations=["@RequestBody"])), "spring4shell") == []
    assert run(facts(spark, types=types, methods=methods, params=param(type="String")), "spring4shell") == []
    lines = ["void m() {", ' res.set("Cache-Control", "public, max-age=60");', " send(req.user.name);", "}"]
    assert len(run(facts(spark, lines=lines, methods=METHOD), "cache-no-vary")) == 1
    assert run(facts(spark, lines=[*lines[:2], ' res.vary("Authorization");', *lines[2:]], methods=METHOD), "cache-no-vary") == []


def test_prompts(spark):
    call = {"call_id": 0, "method_name": "create", "receiver": "client.messages", "line": 3}
    f = lambda text: facts(spark, "python", ["def m(q):"], methods=METHOD, params=[{"type_ord": 0, "method_ord": 0, "position": 0, "name": "q"}], calls=[call], call_args=[{"call_id": 0, "position": 0, "expression": text}])
    assert len(run(f("'Answer: ' + q"), "prompt-injection")) == 1
    assert run(f('f"<data>{q}</data>"'), "prompt-injection") == []


CODE = """def f(cmd):
    a = 2 + 3
    if a > 9:
        run(cmd)
    b = "x".upper() + str(a)
    while False:
        boom()
    if cmd:
        a = 7
    c = a
    return c
    never()
"""


def test_constants(spark):
    known, dead = constants.propagate(CODE)
    assert ("f", 2, "a", "5") in known and dead == [4, 7, 12]
    assert not any(v in ("b", "c") for _, _, v, _ in known)
    scan = files.snippet(spark, CODE, "f.py", "python")
    assert constants.dead_lines(scan).count() == 3 and constants.constants(scan).count() == len(known)
    assert constants.propagate("x = 'a' * 10**9\ny = [1, 2][5]\nz = -'a'\nw = 1 if 2 < 1 else 'no'")[0] == [("", 4, "w", "'no'")]
    assert constants.propagate("def (") == ([], [])


PY = """import os
def handler(request, db):
    name = os.getenv('N')
    cmd = 'ls ' + name
    os.system(cmd)
    safe = quote(name)
    os.system(safe)
"""


def test_catalogue_end_to_end(spark):
    """From Python source to flows with the default patterns."""
    from factmill.facts import Facts

    scan = files.snippet(spark, PY, "h.py", "python")
    f = Facts(spark, {n: python_source.facts(scan, n) for n in python_source.TABLES} | {"files": files.meta(scan), "source_lines": files.lines(scan)})
    f = catalogue.matched(f)
    got = {(r.source_type, r.source_line, r.sink_type, r.sink_line) for r in taint.flows(f).collect()}
    assert ("env_input", 3, "command_injection", 5) in got
    assert not any(x[3] == 7 and x[0] == "env_input" for x in got)
    assert catalogue.sources(spark).count() > 40 and catalogue.sinks(spark).count() > 100


@pytest.mark.parametrize("which", ["sources", "sinks", "sanitizers"])
def test_catalogue_rows(spark, which):
    df = getattr(catalogue, which)(spark)
    assert df.where("method = '' or method like '% %'").count() == 0
