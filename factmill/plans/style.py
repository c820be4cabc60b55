"""Passes on documentation, names, whole reads and inline properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..operators import joins, picks
from .findings import findings
from .registry import register

# Fixed values.
TEST_PATH = "(?i)[/._](test|tests|spec|specs|__tests?__|__mocks?__)[/._]"
UTIL_PATH = "(?i)[/](utils?|helpers?|internal|private|common|shared)[/]"
PASCAL, CAMEL, SNAKE, UPPER = "^[A-Z][A-Za-z0-9]*$", "^[a-z][a-zA-Z0-9]*$", "^[a-z_][a-z0-9_]*$", "^[A-Z][A-Z0-9_]*$"
GENERIC = "T K V E R N S U W".split()
EXEMPT = "main toString hashCode equals compareTo valueOf of from create build get set is has".split()
NAMES_PER_FILE = 20
LOOK_BACK, DOCSTRING = 10, 4
JSX_SKIPPED = "style key ref className id".split()


def _doc_before(f: Facts, things: DataFrame) -> DataFrame:
    """file, start_line of things with a comment among the ten lines above, blank and annotation lines in between."""
    t = f.source_lines.withColumn("s", F.trim("text"))
    kind = F.when((F.col("s") == "") | F.col("s").startswith("@") | F.col("s").startswith("#["), 0).when(F.col("s").rlike("^(/\\*\\*|\\*|///|//!)"), 1).otherwise(2)
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the nearest line above that is neither blank nor an annotation, and what it is
    near = t.withColumn("k", kind).withColumn("last", F.last(F.when(F.col("k") > 0, F.struct("line", "k")), ignorenulls=True).over(w)).select("file", (F.col("line") + 1).alias("start_line"), "last")
    return things.join(near, ["file", "start_line"]).where((F.col("last.k") == 1) & (F.col("last.line") >= F.col("start_line") - LOOK_BACK)).select("file", "start_line").distinct()


@register("missing-public-doc", "maintainability")
def missing_public_doc(f: Facts) -> DataFrame:
    """Types and public methods without a documentation comment above, or a docstring below in Python."""
    files = f.files.where(F.col("language").isin("java", "javascript", "typescript", "python", "csharp") & ~F.col("file").rlike(TEST_PATH) & ~F.col("file").rlike(UTIL_PATH)).select("file", "language")
    has = lambda m: F.coalesce(F.array_contains("modifiers", m), F.lit(False))
    public = F.when(F.col("language").isin("java", "csharp"), has("public")).when(F.col("language") == "python", ~F.col("name").startswith("_")).otherwise(~has("private") & ~has("protected"))
    types = f.types.where("name != '<module>'").join(files, "file").select("file", "language", "start_line", F.concat_ws(" ", "kind", "name").alias("what"), F.lit(False).alias("is_method"))
    methods = f.methods.join(files, "file").where(public).select("file", "language", "start_line", F.concat_ws(".", "type_name", "name").alias("what"), F.lit(True).alias("is_method"))
    things = types.unionByName(methods)
    string = f.source_lines.where(F.trim("text") != "").select("file", F.col("line").alias("d_line"), F.trim("text").rlike("^(\"\"\"|''')").alias("doc"))
    python = things.where("language = 'python' and is_method")
    below = joins.first_match(python.join(string, "file").where((F.col("d_line") > F.col("start_line")) & (F.col("d_line") <= F.col("start_line") + DOCSTRING)), ["file", "start_line"], ["d_line"]).where("doc").select("file", "start_line")
    documented = _doc_before(f, things.where("not (language = 'python' and is_method)").select("file", "start_line").distinct()).unionByName(below).distinct()
    hit = things.join(documented, ["file", "start_line"], "left_anti")
    return findings(hit, "missing-public-doc", "maintainability", None, "low", "note", F.format_string("No documentation on %s", "what"), "start_line", fix="Add a documentation comment", id_suffix=F.concat(F.lit("-"), "what"))


@register("naming-convention", "maintainability")
def naming_convention(f: Facts, interface_prefix: bool = False) -> DataFrame:
    """Types, methods and constants whose names break the language's convention; the first twenty of a file, in order."""
    n = F.col("name")
    lang = F.col("language")
    skip = (F.length("name") <= 2) | n.rlike("^[_$<]|>$") | n.isin(GENERIC)
    files = f.files.select("file", "language")
    curly = lang.isin("java", "typescript", "javascript")
    t = f.types.join(files, "file").where(~skip & (curly | (lang == "python")))
    bad_type = ~n.rlike(PASCAL) & ((F.col("kind") == "class") | (curly & (F.col("kind") == "interface")))
    prefixed = curly & (F.col("kind") == "interface") & n.rlike("^I[A-Z]") & F.lit(interface_prefix)
    types = t.where(bad_type | prefixed).select("file", "type_ord", F.lit(-1).alias("o"), F.lit(0).alias("k"), "name", F.col("start_line").alias("line"), F.when(bad_type, "PascalCase").otherwise("PascalCase (no I-prefix)").alias("expected"))
    m = f.methods.join(files, "file").where(~skip & ((curly & ~n.isin(EXEMPT) & ~n.rlike(CAMEL)) | ((lang == "python") & ~n.rlike(SNAKE))))
    methods = m.select("file", "type_ord", F.col("method_ord").alias("o"), F.lit(1).alias("k"), "name", F.col("start_line").alias("line"), F.when(curly, "camelCase").otherwise("snake_case").alias("expected"))
    constant = F.array_contains("modifiers", "final") & F.array_contains("modifiers", "static")
    d = f.fields.join(files.where("language = 'java'"), "file").where(~skip & F.coalesce(constant, F.lit(False)) & ~n.rlike(UPPER)).join(f.types.select("file", "type_ord", "start_line"), ["file", "type_ord"])
    fields = d.select("file", "type_ord", F.lit(1 << 30).alias("o"), F.lit(2).alias("k"), "name", F.col("start_line").alias("line"), F.lit("UPPER_SNAKE_CASE").alias("expected"))
    every = picks.capped(types.unionByName(methods).unionByName(fields), ["file"], ["type_ord", "k", "o", "name"], NAMES_PER_FILE)
    return findings(every, "naming-convention", "maintainability", None, "low", "note", F.format_string("`%s` should be %s", "name", "expected"), fix=F.format_string("Rename it to %s", "expected"), evidence={"name": "name", "expected_convention": "expected"}, id_suffix=F.concat(F.lit("-"), "name"))


@register("missing-stream", "performance")
def missing_stream(f: Facts) -> DataFrame:
    """Reads of whole files or answers; in JavaScript only in functions without any streaming."""
    t = f.source_lines.join(f.files.select("file", "language"), "file")
    js = F.col("language").isin("javascript", "typescript")
    whole = F.when(js, F.regexp_extract("text", "\\b(readFileSync|fs\\.readFile|response\\.text|response\\.json|res\\.text|res\\.json|body\\.text|body\\.json)\\s*\\(", 1)).when(F.col("language") == "java", F.regexp_extract("text", "\\b(Files\\.readAllBytes|Files\\.readAllLines|Files\\.readString|new\\s+BufferedReader|FileInputStream)\\b", 1)).when(F.col("language") == "python", F.regexp_extract("text", "(\\.\\s*read)\\s*\\(\\s*\\)", 1))
    t = f.in_method(t.withColumn("m", whole).where("m != ''"), "line", ["line"], "left")
    streams = f.source_lines.where(F.col("text").rlike("(?i)\\.pipe\\s*\\(|\\.on\\s*\\(\\s*['\"]data['\"]|for\\s+await\\s*\\(|\\bcreateReadStream\\b|\\bstream\\b")).select("file", F.col("line").alias("st_line"))
    near = t.where(js).select("file", "line", "m_start", "m_end").join(streams, "file").where("m_start is null or st_line between m_start and m_end").select("file", "line").distinct()
    return findings(t.join(near, ["file", "line"], "left_anti"), "missing-stream", "performance", None, "low", "note", F.format_string("`%s` reads everything into memory", "m"), snippet=F.trim("text"), fix="Read it as a stream", evidence={"method": "m"})


@register("react-inline-jsx", "performance")
def react_inline_jsx(f: Facts) -> DataFrame:
    """Objects and functions that a component's property makes anew in each rendering."""
    jsx = f.source_lines.where(F.col("text").rlike("<[A-Z][A-Za-z0-9]*")).select("file").distinct()
    t = f.of_language(f.source_lines, "javascript", "typescript").join(jsx, "file", "left_semi").where(~F.ltrim("text").rlike("^(//|\\*|/\\*)"))
    found = None
    for kind, pattern in (("object", "\\s([A-Za-z][A-Za-z0-9_]*)=\\{\\{"), ("arrow", "\\s([A-Za-z][A-Za-z0-9_]*)=\\{(?:\\(|[A-Za-z_$]).*?=>"), ("function", "\\s([A-Za-z][A-Za-z0-9_]*)=\\{function\\s*\\(")):
        one = t.withColumn("prop", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).withColumn("made", F.lit(kind))
        found = one if found is None else found.unionByName(one)
    hit = found.where(~F.col("prop").isin(JSX_SKIPPED)).dropDuplicates(["file", "line", "prop", "made"])
    return findings(hit, "react-inline-jsx", "performance", None, "low", "note", F.format_string("The property `%s` gets a new %s in each rendering", "prop", "made"), snippet=F.trim("text"), fix="Make it outside of the component", evidence={"prop": "prop", "kind": "made"}, id_suffix=F.concat(F.lit("-"), "prop"))
