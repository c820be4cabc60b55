from factmill.facts import Facts
from factmill.plans import catalogue, taint
from factmill.sources import curly, files

JAVA = '''public class Users {
    public void list(HttpServletRequest req) throws Exception {
        String q = req.getParameter("q");
        Statement st = conn.createStatement();
        ResultSet rs = st.executeQuery("select COLUMNS from t where n = '" + q + "'");
    }
}
'''.replace("COLUMNS", ", ".join(f"column{i}" for i in range(120)))


def test_flow_of_a_variable_after_a_long_literal(spark):
    scan = files.snippet(spark, JAVA, "Users.java", "java")
    f = Facts(spark, {n: curly.facts(scan, n) for n in curly.TABLES} | {"files": files.meta(scan), "source_lines": files.lines(scan)})
    (argument,) = [r.expression for r in f.call_args.collect() if "column0" in r.expression]
    assert len(argument) > 1000 and argument.endswith("""+ q + "'\"""")
    got = {(r.source_type, r.source_line, r.sink_type, r.sink_line) for r in taint.flows(catalogue.matched(f)).collect()}
    assert ("http_param", 3, "sql_injection", 5) in got
