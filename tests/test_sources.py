import pytest
from pyspark.sql import functions as F

from factmill.functions import text as fn
from factmill.plans import markup, reports
from factmill.sources import files, manifests
from factmill.streaming import events


@pytest.mark.parametrize(
    "version,spec,ok",
    [("1.2.3", "^1.2.3", True), ("1.9.0", "^1.2.3", True), ("2.0.0", "^1.2.3", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.5.0", "1.0.0 - 2.0.0", True), ("2.0.1", "1.0.0 - 2.0.0", False), ("9.9.9", "*", True), ("1.4.2", "1.x", True), ("1.2.3", ">=1.0.0 <1.2.3", False), ("1.2.3-beta", "<1.2.3", True), ("3.0.0", "^1.0.0 || ^3.0.0", True), ("v1.2.3", "=1.2.3", True), ("1.2", "1.2.0", True)],
)
def test_versions(spark, version, spec, ok):
    assert spark.range(1).select(fn.satisfies(F.lit(version), spec).alias("x")).first().x is ok


def test_vulnerable(spark):
    got = spark.createDataFrame([("1.0.0",), ("1.5.0",), ("0.9.0",)], "v string").select("v", fn.is_vulnerable(F.col("v"), [">=1.4.0"], ["<1.0.0"]).alias("x"))
    assert {r.v: r.x for r in got.collect()} == {"1.0.0": True, "1.5.0": False, "0.9.0": False}


@pytest.mark.parametrize("glob,yes,no", [("**/*.py", ["a.py", "x/y/a.py"], ["a.pyc"]), ("src/*.ts", ["src/a.ts"], ["src/x/a.ts", "a.ts"]), ("a?.js", ["ab.js"], ["a.js", "a/.js"]), ("lib/**", ["lib/x/y"], ["libx"])])
def test_globs(spark, glob, yes, no):
    got = spark.createDataFrame([(x,) for x in yes + no], "p string").where(F.col("p").rlike(fn.glob_to_regex(glob)))
    assert sorted(r.p for r in got.collect()) == sorted(yes)


def test_paths_and_purl(spark):
    df = spark.createDataFrame([("a/./b/../c/",), ("../x",)], "p string").select(fn.normalised_path(F.col("p")).alias("n"))
    assert [r.n for r in df.collect()] == ["a/c", "x"]
    p = spark.range(1).select(fn.purl(F.lit("npm"), F.lit("@scope/a b"), F.lit("1.0")).alias("a"), fn.purl(F.lit("maven"), F.lit("org.x:y"), F.lit("")).alias("b"), fn.purl(F.lit("pypi"), F.lit("My_Pkg"), F.lit("2")).alias("c")).first()
    assert tuple(p) == ("pkg:npm/%40scope/a%20b@1.0", "pkg:maven/org.x/y", "pkg:pypi/my-pkg@2")


def deps(df):
    return sorted((r.name, r.version, r.scope) for r in df.collect())


def test_manifests(spark):
    t = lambda x: spark.createDataFrame([(x,)], "text string")
    assert deps(manifests.npm(t('{"dependencies": {"a": "^1.2.0"}, "devDependencies": {"b": "~2"}}'))) == [("a", "1.2.0", "prod"), ("b", "2", "dev")]
    assert deps(manifests.npm_lock(t('{"packages": {"": {}, "node_modules/a": {"version": "1.0.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0", "dev": true}}}'))) == [("@s/b", "2.0.0", "dev"), ("a", "1.0.0", "prod")]
    assert deps(manifests.npm_lock(t('{"dependencies": {"a": {"version": "1.0.0"}}}'))) == [("a", "1.0.0", "prod")]
    assert deps(manifests.cargo_lock(t('[[package]]\nname = "x"\nversion = "0.1.0"\n\n[[package]]\nname = "y"\nversion = "2.0.0"\n'))) == [("x", "0.1.0", "prod"), ("y", "2.0.0", "prod")]
    assert deps(manifests.requirements(t("# c\nflask==2.0\nrequests>=1.1,<2  # x\n-r other.txt\nnumpy\n"))) == [("flask", "2.0", "prod"), ("numpy", "", "prod"), ("requests", "1.1", "prod")]
    assert deps(manifests.pyproject(t('[project]\ndependencies = [\n  "a>=1.0",\n  "b"\n]\n[tool.poetry.dependencies]\npython = "^3"\nc = "^2.1"\nd = {version = "3.0", optional = true}\n[tool.poetry.group.dev.dependencies]\ne = "*"\n'))) == [("a", "1.0", "prod"), ("b", "", "prod"), ("c", "2.1", "prod"), ("d", "3.0", "prod"), ("e", "*", "dev")]
    assert deps(manifests.cargo(t('[dependencies]\na = "1.0"\nb = { version = "2.0" }\n[dev-dependencies]\nc = "3"\n'))) == [("a", "1.0", "prod"), ("b", "2.0", "prod"), ("c", "3", "dev")]
    assert deps(manifests.gradle(t("dependencies {\n implementation 'g:a:1.0'\n // implementation 'no:no:1'\n testImplementation(\"g:b:2.0\")\n}"))) == [("g:a", "1.0", "prod"), ("g:b", "2.0", "dev")]
    assert deps(manifests.maven(t("<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency><!-- <dependency><groupId>x</groupId></dependency> --><dependency><groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies>"))) == [("g:a", "1", "prod"), ("g:t", "", "dev")]
    assert deps(manifests.go_mod(t("module m.io/x\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\nrequire golang.org/x/c v0.1.0 // indirect\n"))) == [("github.com/a/b", "1.2.3", "prod"), ("golang.org/x/c", "0.1.0", "prod")]
    both = manifests.collect([manifests.npm(t('{"devDependencies": {"a": "1"}}')), manifests.npm(t('{"dependencies": {"a": "1"}}'))])
    assert deps(both) == [("a", "1", "prod")]
    import json

    assert json.loads(reports.cyclonedx(both).first().bom)["components"][0]["purl"] == "pkg:npm/a@1"
    assert json.loads(reports.spdx(both).first().document)["packages"][0]["SPDXID"] == "SPDXRef-Package-0"


def test_maven_parents(spark):
    p = spark.createDataFrame([("r/a/b", "../pom.xml"), ("r/a", ""), ("r", None), ("x", "../y/pom.xml"), ("y", "../x/pom.xml"), ("z", "../missing")], "root string, parent_relative_path string")
    got = {(r.root, r.parent): r.hops for r in manifests.maven_parents(p).collect()}
    assert got == {("r/a/b", "r/a"): 1, ("r/a/b", "r"): 2, ("r/a", "r"): 1, ("x", "y"): 1, ("y", "x"): 1}


def test_scan(spark, tmp_path):
    for name, text in {"src/A.java": "package a.b;\nimport java.util.List;\nclass A {}\n", "node_modules/x.js": "x", "test/a.test.ts": "y", "notes.txt": "z", "b.py": "import os\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.scan(spark, str(tmp_path))
    assert sorted((r.file, r.language) for r in got.collect()) == [("b.py", "python"), ("src/A.java", "java"), ("test/a.test.ts", "typescript")]
    assert sorted(r.file for r in files.scan(spark, str(tmp_path), skip_tests=True, exclude=["*.py"]).collect()) == ["src/A.java"]
    m = {r.file: r for r in files.meta(got).collect()}
    assert (m["src/A.java"].package, m["src/A.java"].loc, len(m["src/A.java"]["hash"])) == ("a.b", 4, 16)
    assert files.unchanged(got, got).count() == 3
    assert [(r.imported_name, r.from_package) for r in files.imports(got).where("file like '%java'").collect()] == [("List", "java.util")]


PAGE = '<a href="http://x" target="_blank">a</a><a target=_blank rel="noopener" href="/">b</a><a href="javascript:x()">c</a><iframe src="/f"></iframe><script src="http://cdn.x/a.js"></script><script src="https://cdn.x/a.js" integrity="sha"></script><form action="javascript:y()"><input type="password"></form><p onclick="z()">t</p><!-- <iframe> -->\n<script>\nvar a = 1;\n</script>'


def test_markup(spark):
    pages = spark.createDataFrame([("p", PAGE)], "file string, html string")
    got = sorted(r.rule_id for r in markup.attribute_findings(pages).collect())
    assert got == sorted(["html-missing-noopener", "html-javascript-uri", "html-missing-sandbox", "html-mixed-content", "html-missing-sri", "html-autocomplete", "html-inline-handler", "html-form-action"])
    s = markup.scripts(pages, "file", "html").collect()
    assert [(r.src, r.code.strip(), r.line_offset) for r in s][-1] == (None, "var a = 1;", 1)
    assert [(r.event, r.code) for r in markup.handlers(pages, "file", "html").collect()] == [("onclick", "z()")]


def test_streams_equal_their_batch_form(spark):
    d = "/root/testdata/sf0.001"
    for i, make in enumerate((lambda e: events.rates(e).select("start", "event_type", "n"), lambda e: events.sessions(e).select("user_id", "start", "n"))):
        batch = sorted(tuple(r) for r in make(events.read(spark, d, streaming=False)).collect())
        got = events.run_to_table(make(events.read(spark, d))).drop("epoch")
        rows = sorted(tuple(r) for r in got.collect())
        assert set(rows) <= set(batch) and len(rows) > 0.9 * len(batch)  # the last windows stay open until later events come
    once = events.run_to_table(events.once(events.read(spark, d), ["user_id", "event_type"]).select("user_id", "event_type"))
    assert once.count() >= events.read(spark, d, streaming=False).select("user_id", "event_type").distinct().count()


def test_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("x = 1\n")
    got = events.run_to_table(events.new_files(spark, str(tmp_path / "in"), "*.py")).collect()
    assert [(r.file.endswith("a.py"), r.text) for r in got] == [(True, "x = 1\n")]
