"""Scanning folders: which files there are, in which language, and what stands in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import glob_to_regex, sha16

# File extensions by language, and folders that hold no sources.
LANGUAGES = {
    "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "py": "python", "rs": "rust", "go": "go", "sh": "bash", "bash": "bash", "cs": "csharp", "html": "html", "htm": "html", "vue": "vue",
}
EXCLUDED = "node_modules .git dist build target vendor __pycache__ .venv venv coverage .next out bin obj".split()
TEST_FILES = [r"(^|/)tests?/", r"(^|/)__tests__/", r"(^|/)spec/", r"(^|/)src/test/", r"\.test\.[jt]sx?$", r"\.spec\.[jt]sx?$", r"(^|/)test_[^/]*\.py$", r"_test\.(py|go)$", r"Tests?\.(java|cs)$", r"IT\.java$", r"(^|/)fixtures?/", r"(^|/)mocks?/"]


def language_of(path) -> F.Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def is_test(path) -> F.Column:
    return path.rlike("|".join(TEST_FILES))


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None, skip_tests: bool = False, max_bytes: int | None = None) -> DataFrame:
    """file (below root), language, modified, text of each source file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.regexp_replace("path", "^[a-zA-Z]+:/{0,2}", "/")
    f = raw.withColumn("file", F.substring_index(F.regexp_replace(path, "^/+", "/"), f"{base}/", -1)).withColumn("language", language_of(F.col("file")))
    f = f.where(F.col("language").isNotNull() & ~F.concat(F.lit("/"), F.col("file")).rlike("/(" + "|".join(x.replace(".", "\\.") for x in EXCLUDED) + ")/"))
    if include:
        f = f.where(F.col("file").rlike("|".join(map(glob_to_regex, include))))
    if exclude:
        f = f.where(~F.col("file").rlike("|".join(map(glob_to_regex, exclude))))
    if languages:
        f = f.where(F.col("language").isin(languages))
    if skip_tests:
        f = f.where(~is_test(F.col("file")))
    if max_bytes is not None:
        f = f.where(F.col("length") <= max_bytes)
    return f.select("file", "language", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def snippet(spark: SparkSession, code: str, file: str, language: str) -> DataFrame:
    """One text as a scan of one file."""
    return spark.createDataFrame([(file, language, code)], "file string, language string, text string")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files with the same modification time in both scans: what is known about them still holds."""
    return after.select("file", "modified").intersect(before.select("file", "modified")).select("file")


def lines(scanned: DataFrame) -> DataFrame:
    """file, line (from 1), text. A trailing line feed makes a last empty line."""
    return scanned.select("file", F.posexplode(F.split("text", "\r?\n", -1)).alias("n", "text")).select("file", (F.col("n") + 1).cast("int").alias("line"), "text")


def meta(scanned: DataFrame) -> DataFrame:
    """The files table: lines of code, content hash and package."""
    package = F.when(F.col("language") == "java", F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)).when(F.col("language") == "go", F.regexp_extract("text", r"(?m)^\s*package\s+(\w+)", 1))
    return scanned.select("file", "language", F.size(F.split("text", "\n", -1)).alias("loc"), sha16(F.col("text")).alias("hash"), F.nullif(package, F.lit("")).alias("package"), F.lit(None).cast("string").alias("project_profile"))


def imports(scanned: DataFrame) -> DataFrame:
    """The imports table by each language's import statements."""
    t = lines(scanned).join(scanned.select("file", "language"), "file").withColumn("s", F.trim("text"))
    lang = F.col("language")
    java = t.where((lang == "java") & F.col("s").rlike(r"^import\s")).withColumn("full", F.regexp_extract("s", r"^import\s+(?:static\s+)?([\w.*]+)", 1))
    java = java.select("file", F.substring_index("full", ".", -1).alias("imported_name"), F.regexp_replace("full", r"\.[^.]*$", "").alias("from_package"), F.lit(None).cast("string").alias("alias"), F.col("full").endswith("*").alias("is_wildcard"), F.col("line").alias("line_number"))
    js = t.where(lang.isin("javascript", "typescript", "vue"))
    src = F.coalesce(F.nullif(F.regexp_extract("s", r"\bfrom\s+['\"]([^'\"]+)['\"]", 1), F.lit("")), F.nullif(F.regexp_extract("s", r"^import\s+['\"]([^'\"]+)['\"]", 1), F.lit("")), F.nullif(F.regexp_extract("s", r"\brequire\(\s*['\"]([^'\"]+)['\"]", 1), F.lit("")))
    clause = F.regexp_extract("s", r"^(?:import|export|(?:const|let|var))\s+(?:type\s+)?(.*?)\s*(?:from\b|=\s*require)", 1)
    named = F.filter(F.split(F.regexp_replace(clause, r"[{}]", ","), r"\s*,\s*"), lambda x: x != "")
    js = js.withColumn("src", src).where("src is not null").withColumn("item", F.explode_outer(named))
    js = js.select("file", F.when(F.col("item").isNull(), F.lit("*")).when(F.col("item").startswith("*"), F.lit("*")).otherwise(F.regexp_extract("item", r"^([\w$]+)", 1)).alias("imported_name"), F.col("src").alias("from_package"), F.nullif(F.regexp_extract("item", r"\s+as\s+([\w$]+)", 1), F.lit("")).alias("alias"), F.coalesce(F.col("item").startswith("*"), F.lit(False)).alias("is_wildcard"), F.col("line").alias("line_number"))
    py = t.where((lang == "python") & F.col("s").rlike(r"^(import|from)\s"))
    package = F.regexp_extract("s", r"^from\s+(\S+)\s+import", 1)
    item = F.explode(F.split(F.regexp_replace(F.regexp_replace("s", r"^(from\s+\S+\s+)?import\s+", ""), r"[()]|#.*", ""), r"\s*,\s*"))
    py = py.withColumn("package", package).withColumn("item", item)
    py = py.select("file", F.regexp_extract("item", r"^(\S+)", 1).alias("imported_name"), F.when(F.col("package") == "", F.regexp_extract("item", r"^(\S+)", 1)).otherwise(F.col("package")).alias("from_package"), F.nullif(F.regexp_extract("item", r"\s+as\s+(\w+)", 1), F.lit("")).alias("alias"), (F.col("item") == "*").alias("is_wildcard"), F.col("line").alias("line_number"))
    go = t.where((lang == "go") & F.col("s").rlike(r"^(import\s+)?(\w+\s+|_\s+|\.\s+)?\"[^\"]+\"$"))
    go = go.select("file", F.regexp_extract("s", r"([^/\"]+)\"$", 1).alias("imported_name"), F.regexp_extract("s", r"\"([^\"]+)\"", 1).alias("from_package"), F.nullif(F.regexp_extract("s", r"^(?:import\s+)?(\w+)\s+\"", 1), F.lit("")).alias("alias"), F.lit(False).alias("is_wildcard"), F.col("line").alias("line_number"))
    rust = t.where((lang == "rust") & F.col("s").rlike(r"^(pub\s+)?use\s")).withColumn("full", F.regexp_extract("s", r"use\s+([\w:*]+)", 1))
    rust = rust.select("file", F.regexp_extract("full", r"([\w*]+)$", 1).alias("imported_name"), F.regexp_replace("full", r"::[\w*]*$", "").alias("from_package"), F.nullif(F.regexp_extract("s", r"\bas\s+(\w+)", 1), F.lit("")).alias("alias"), F.col("full").endswith("*").alias("is_wildcard"), F.col("line").alias("line_number"))
    return java.unionByName(js).unionByName(py).unionByName(go).unionByName(rust)


def exports(f: Facts) -> DataFrame:
    """Types and methods that others may use."""
    public = lambda c: F.coalesce(F.array_contains(c, "public"), F.lit(False))
    t = f.types.select("file", F.col("name").alias("symbol"), "kind", F.lit("public").alias("visibility"))
    m = f.methods.where(public("modifiers") | F.coalesce(F.array_contains("modifiers", "protected"), F.lit(False))).select("file", F.concat_ws(".", "type_name", "name").alias("symbol"), F.lit("method").alias("kind"), F.when(public("modifiers"), "public").otherwise("protected").alias("visibility"))
    d = f.fields.where(public("modifiers")).select("file", F.col("name").alias("symbol"), F.lit("field").alias("kind"), F.lit("public").alias("visibility"))
    return t.unionByName(m).unionByName(d)


def registrations(f: Facts) -> DataFrame:
    """file, line, kind, framework, path, handler: routes, middleware and listeners that calls or decorators register."""
    first = f.call_args.where("position = 0").select("file", "call_id", F.col("literal").alias("path"), F.col("variable").alias("only"))
    last = f.call_args.groupBy("file", "call_id").agg(F.max_by("variable", "position").alias("handler"))
    c = f.of_language(f.calls, "javascript", "typescript").where(F.col("receiver").rlike("(?i)(^|\\.)(app|router|server|api|emitter|bus|fastify|socket|io)$"))
    c = c.join(first, ["file", "call_id"], "left").join(last, ["file", "call_id"], "left")
    name = F.col("method_name")
    kind = F.when(name.isin("get", "post", "put", "delete", "patch", "all", "head", "options") & F.col("path").startswith("/"), "route").when(name == "use", "middleware").when(name.isin("on", "once", "addListener"), "listener")
    js = c.withColumn("kind", kind).where("kind is not null").select("file", "line", "kind", F.when(F.col("receiver").rlike("(?i)fastify"), "fastify").otherwise("express").alias("framework"), "path", F.coalesce("handler", "only").alias("handler"))
    m = f.methods.withColumn("a", F.explode("annotations"))
    route = F.regexp_extract("a", r"[\"']([^\"']*)[\"']", 1)
    py = m.where(F.col("a").rlike(r"\.(route|get|post|put|delete|patch|websocket)\(")).select("file", F.col("start_line").alias("line"), F.lit("route").alias("kind"), F.when(F.col("a").rlike(r"\.route\("), "flask").otherwise("fastapi").alias("framework"), F.nullif(route, F.lit("")).alias("path"), F.col("name").alias("handler"))
    java = m.where(F.col("a").rlike("(Get|Post|Put|Delete|Patch|Request)Mapping")).select("file", F.col("start_line").alias("line"), F.lit("route").alias("kind"), F.lit("spring").alias("framework"), F.nullif(route, F.lit("")).alias("path"), F.col("name").alias("handler"))
    return js.unionByName(py).unionByName(java)
