import pytest

from factmill.plans import catalogue, load, registry, taint
from factmill.sources import curly, files, read_project

JAVA = '''package a.b;
import java.sql.*;

/** Lists users. */
@RestController
public class Users extends Base<String> implements Api {
    private static final int MAX = 3; // not { a brace
    private Connection conn;

    @GetMapping("/u")
    public List<String> list(HttpServletRequest req, String other) throws Exception {
        String q = req.getParameter("q");
        String sql = "select * from t where n = '" + q + "'";
        Statement st = conn.createStatement();
        ResultSet rs = st.executeQuery(sql);
        while (rs.next()) {
            repo.findById(rs.getLong(1));
        }
        try {
            FileReader r = new FileReader("x");
            r.read();
        } catch (Exception e) {
        }
        return null;
    }

    void safe(HttpServletRequest req) {
        String id = req.getParameter("id");
        int n = Integer.parseInt(id);
        st.executeQuery("select " + n);
    }
}
'''


@pytest.fixture(scope="module")
def java(spark):
    return read_project(files.snippet(spark, JAVA, "Users.java", "java"))


def test_structure():
    rows = curly.read(JAVA, "f", "java")
    assert [(r[2], r[3], r[5], r[6], r[7], r[8], r[9]) for r in rows["types"]][1] == ("Users", "class", "Base<String>", ["Api"], ["RestController"], 6, 32)
    assert [(r[4], r[6], r[8], r[9]) for r in rows["methods"]] == [("list", ["GetMapping"], 11, 25), ("safe", [], 27, 31)]
    assert [(r[4], r[5]) for r in rows["params"]] == [("req", "HttpServletRequest"), ("other", "String"), ("req", "HttpServletRequest")]
    assert {(r[2], r[3]) for r in rows["fields"]} == {("MAX", "int"), ("conn", "Connection")}
    calls = {(r[2], r[3], r[4], r[6]) for r in rows["calls"]}
    assert {("getParameter", "req", "HttpServletRequest", 12), ("executeQuery", "st", "Statement", 15), ("findById", "repo", None, 17), ("FileReader", None, None, 20)} <= calls
    assert not any(c[0] in ("list", "safe", "while", "catch") for c in calls)


def test_flows(java):
    f = catalogue.matched(java)
    got = {(r.source_type, r.source_line, r.sink_type, r.sink_line) for r in taint.flows(f).collect()}
    assert ("http_param", 12, "sql_injection", 15) in got
    assert not any(x[3] == 30 and x[0] == "http_param" for x in got)


def test_passes(java):
    load()
    lines = lambda name: [r.line for r in registry.PASSES[name].run(java).collect()]
    assert lines("n-plus-one") == [17]
    assert lines("broad-catch") == [22] and lines("swallowed-exception") == [22]
    assert lines("resource-leak") == [20]


JS = '''import { a as b } from './m';
const express = require('express');
class K { run(x) { return x.go(); } }
async function handle(req, res) {
  const id = req.query('id');
  const out = `select ${id}`;
  db.query(out + id);
  for (const i of items) { fetch(i); }
}
const f = (x, y) => { return g(x); };
'''
GO = '''package main
import "os/exec"
type S struct { n int }
func (s *S) Run(w http.ResponseWriter, r *http.Request) {
    name := r.FormValue("n")
    exec.Command("sh", name)
}
'''


def test_other_languages():
    rows = curly.read(JS, "f.js", "javascript")
    assert [r[4] for r in rows["methods"]] == ["run", "handle", "f"] or sorted(r[4] for r in rows["methods"]) == ["f", "handle", "run"]
    assert ("async" in next(r for r in rows["methods"] if r[4] == "handle")[7])
    chains = {(rows["dfg_defs"][a][2], rows["dfg_defs"][b][2]) for _, a, b, _ in rows["dfg_chains"]}
    assert ("req", "id") in chains
    assert {("query", "req"), ("query", "db"), ("fetch", None), ("g", None)} <= {(r[2], r[3]) for r in rows["calls"]}
    go = curly.read(GO, "f.go", "go")
    assert [(r[3], r[4]) for r in go["methods"]] == [("S", "Run")]
    assert [(r[4], r[5]) for r in go["params"]] == [("w", "http.ResponseWriter"), ("r", "*http.Request")]
    assert ("Command", "exec") in {(r[2], r[3]) for r in go["calls"]}


@pytest.mark.parametrize("text", ["", "{", "}}}", "class", "class A {", "void f( {", '"', "/* open", "a.b.c(d(e(", "x = y = z;", "if (a) { b(); } else { c(); }"])
def test_odd_texts(text):
    for language in curly.LANGUAGES:
        assert set(curly.read(text, "f", language)) == set(curly.TABLES)
