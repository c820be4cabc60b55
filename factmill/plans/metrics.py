"""The 28 metrics of a file, its types and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import strip_generics
from ..operators import graph, joins, picks

# Words and marks that count as operators.
KEYWORDS = "if else for while do switch case break continue return try catch finally throw new delete typeof instanceof in of class extends implements interface function const let var import export default async await yield static public private protected void this super".split()
OPERATOR = "(?:===|!==|==|!=|<=|>=|&&|\\|\\||\\+\\+|--|\\+=|-=|\\*=|/=|=>|<<|>>|[-+*/%=<>!&|^~?:])"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
NUMBER = "[0-9]+"
COMMENT = "^(//|#|\\*|/\\*)"


def _metric(df: DataFrame, name: str, category: str, value, description=None) -> DataFrame:
    return df.select("file", F.lit(name).alias("name"), F.lit(category).alias("category"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("iso_25010"), (F.lit(None).cast("string") if description is None else F.col(description)).alias("description"))


def sizes(lines: DataFrame) -> DataFrame:
    """file, loc, nloc, comment_density."""
    t = F.trim("text")
    comment = t.rlike(COMMENT)
    return lines.groupBy("file").agg(F.count("*").alias("loc"), F.count_if((t != "") & ~comment).alias("nloc"), F.count_if(comment).alias("comments")).select("file", "loc", "nloc", F.round(F.col("comments") / F.col("loc"), 4).alias("comment_density"))


def halstead(lines: DataFrame) -> DataFrame:
    """file, n1, n2, t1, t2 (distinct and all operators and operands), volume, difficulty, effort, bugs."""
    words = lines.select("file", F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("t"))
    words = words.select("file", "t", F.col("t").isin(KEYWORDS).alias("op"))
    marks = lines.select("file", F.explode(F.regexp_extract_all("text", F.lit(OPERATOR), F.lit(0))).alias("t"), F.lit(True).alias("op"))
    numbers = lines.select("file", F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("t"), F.lit(False).alias("op"))
    n = words.unionByName(marks).unionByName(numbers).groupBy("file", "t", "op").agg(F.count("*").alias("c"))
    n = n.groupBy("file").agg(F.count_if("op").alias("n1"), F.count_if(~F.col("op")).alias("n2"), F.sum(F.when(F.col("op"), F.col("c")).otherwise(0)).alias("t1"), F.sum(F.when(F.col("op"), 0).otherwise(F.col("c"))).alias("t2"))
    n = lines.select("file").distinct().join(n, "file", "left").fillna(0)
    none = (F.col("n1") + F.col("n2") == 0) | (F.col("n2") == 0)
    volume = F.when(none, F.lit(0.0)).otherwise((F.col("t1") + F.col("t2")) * F.log2(F.col("n1") + F.col("n2")))
    difficulty = F.when(none, F.lit(0.0)).otherwise(F.col("n1") / 2 * (F.col("t2") / F.col("n2")))
    n = n.withColumn("v", volume).withColumn("d", difficulty).withColumn("e", F.col("v") * F.col("d"))
    return n.select("file", "n1", "n2", "t1", "t2", F.round("v", 2).alias("volume"), F.round("d", 2).alias("difficulty"), F.round("e", 2).alias("effort"), F.round(F.pow("e", F.lit(2 / 3)) / 3000, 4).alias("bugs"))


def method_complexity(f: Facts) -> DataFrame:
    """file, type_ord, method_ord, name, complexity: edges - blocks + 2 within the method, 1 at least."""
    m = f.methods.select("file", "type_ord", "method_ord", "name", F.col("start_line").alias("m_start"), F.col("end_line").alias("m_end"))
    b = joins.range_join(f.cfg_blocks.select("file", "id", "start_line", "end_line"), m, ["file"], "start_line", "m_start", "m_end").where("end_line <= m_end")
    key = ["file", "type_ord", "method_ord"]
    nodes = b.groupBy(*key).agg(F.count_distinct("id").alias("nodes"))
    own = b.select(*key, "id").distinct()
    e = f.cfg_edges.join(own.withColumnRenamed("id", "from"), ["file", "from"]).join(own.withColumnRenamed("id", "to"), [*key, "to"]).groupBy(*key).agg(F.count("*").alias("edges"))
    out = m.join(nodes, key, "left").join(e, key, "left")
    return out.select(*key, "name", F.when(F.col("nodes").isNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.coalesce("edges", F.lit(0)) - F.col("nodes") + 2)).cast("long").alias("complexity"))


def coupling(f: Facts) -> DataFrame:
    """file, type_ord, name, cbo, rfc: types and methods outside of the file that a type's calls and fields reach."""
    t = f.types.select("file", "type_ord", "name", F.col("start_line").alias("t_start"), F.col("end_line").alias("t_end"))
    local = f.types.select("file", F.col("name").alias("other")).distinct()
    c = joins.range_join(f.calls.select("file", "line", "method_name", strip_generics(F.col("receiver_type")).alias("other")), t, ["file"], "line", "t_start", "t_end")
    key = ["file", "type_ord"]
    outer = c.where("other is not null").join(local, ["file", "other"], "left_anti")
    held = f.fields.select(*key, strip_generics(F.col("type")).alias("other")).where("other is not null").join(local, ["file", "other"], "left_anti")
    cbo = outer.select(*key, "other").unionByName(held).groupBy(*key).agg(F.count_distinct("other").alias("cbo"))
    rfc = outer.groupBy(*key).agg(F.count_distinct("method_name").alias("outer"))
    own = f.methods.groupBy(*key).agg(F.count("*").alias("own"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return t.join(cbo, key, "left").join(rfc, key, "left").join(own, key, "left").select(*key, "name", zero("cbo").alias("cbo"), (zero("own") + zero("outer")).alias("rfc"))


def cohesion(f: Facts) -> DataFrame:
    """file, type_ord, name, lcom over methods that share instance fields."""
    key = ["file", "type_ord"]
    inst = f.fields.where(~F.coalesce(F.array_contains("modifiers", "static"), F.lit(False))).select(*key, F.col("name").alias("field")).distinct()
    m = f.methods.select(*key, "method_ord", "start_line", "end_line")
    uses = joins.range_join(f.dfg_uses.select("file", "line", F.col("variable").alias("field")), m, ["file"], "line", "start_line", "end_line").join(inst, [*key, "field"])
    p = picks.lcom(picks.shared_pairs(m, uses, key, "method_ord", "field")).join(inst.select(*key).distinct(), key, "left_semi").where("n >= 2")
    return f.types.select(*key, "name").join(p.select(*key, "lcom"), key, "left").withColumn("lcom", F.coalesce("lcom", F.lit(0)))


def inheritance(f: Facts) -> DataFrame:
    """file, name, dit (ancestors in the file), noc (children)."""
    t = f.types.select("file", "name").distinct()
    p = f.types.where("extends is not null").select("file", "name", strip_generics(F.col("extends")).alias("parent"))
    local = p.join(t.withColumnRenamed("name", "parent"), ["file", "parent"])
    up = graph.closure(local, ["file"], "name", "parent").where("src != dst").groupBy("file", F.col("src").alias("name")).agg(F.count("*").alias("dit"))
    kids = p.groupBy("file", F.col("parent").alias("name")).agg(F.count("*").alias("noc"))
    return t.join(up, ["file", "name"], "left").join(kids, ["file", "name"], "left").fillna(0)


def doc_coverage(f: Facts) -> DataFrame:
    """file, doc_coverage: share of types and methods with a documentation block that ends on the line before."""
    things = f.types.select("file", "start_line").unionByName(f.methods.select("file", "start_line")).withColumn("before", F.col("start_line") - 1)
    ends = f.source_lines.where(F.col("text").rlike("\\*/\\s*$")).select("file", F.col("line").alias("end"))
    starts = f.source_lines.where(F.col("text").rlike("^\\s*/\\*")).select("file", F.col("line").alias("start"), F.col("text").rlike("^\\s*/\\*\\*").alias("doc"))
    block = joins.asof_join(ends, starts, ["file"], "end", "start", ["doc"]).where("asof_doc").select("file", F.col("end").alias("before")).distinct().withColumn("ok", F.lit(1))
    return things.join(block, ["file", "before"], "left").groupBy("file").agg(F.round(F.count("ok") / F.count("*"), 4).alias("doc_coverage"))


def all_metrics(f: Facts) -> DataFrame:
    """Rows of the metrics table: base metrics, then the composites over them."""
    from functools import reduce

    s, h = sizes(f.source_lines), halstead(f.source_lines)
    mc, cp, co, inh, doc = method_complexity(f), coupling(f), cohesion(f), inheritance(f), doc_coverage(f)
    files = f.files.select("file")
    count = lambda df, cond, name: files.join(df.where(cond).groupBy("file").agg(F.count("*").alias(name)), "file", "left").fillna(0)
    fn = files.join(f.methods.groupBy("file").agg(F.count("*").alias("v")), "file", "left").fillna(0)
    wmc = files.join(mc.groupBy("file").agg(F.sum("complexity").alias("v")), "file", "left").fillna(0)
    loops, conds = count(f.cfg_edges, "type = 'back'", "v"), count(f.cfg_edges, "type in ('true', 'false')", "v")
    flow = count(f.dfg_uses, "def_id is not null", "v")
    means = cp.groupBy("file").agg(F.round(F.avg("cbo"), 2).alias("CBO_avg"), F.round(F.avg("rfc"), 2).alias("RFC_avg")).join(co.groupBy("file").agg(F.round(F.avg("lcom"), 2).alias("LCOM_avg")), "file", "left")
    tree = inh.groupBy("file").agg(F.max("dit").alias("DIT_max"), F.sum("noc").alias("NOC_total"))
    rows = [_metric(s, "LOC", "size", "loc"), _metric(s, "NLOC", "size", "nloc"), _metric(s, "comment_density", "size", "comment_density"), _metric(fn, "function_count", "size", "v")]
    rows += [_metric(mc, "cyclomatic_complexity", "complexity", "complexity", "name"), _metric(wmc, "WMC", "complexity", "v"), _metric(loops, "loop_complexity", "complexity", "v"), _metric(conds, "condition_complexity", "complexity", "v")]
    rows += [_metric(h, f"halstead_{x}", "complexity", x) for x in ("volume", "difficulty", "effort", "bugs")] + [_metric(flow, "data_flow_complexity", "complexity", "v")]
    rows += [_metric(cp, "CBO", "coupling", "cbo", "name"), _metric(cp, "RFC", "coupling", "rfc", "name"), _metric(means, "CBO_avg", "coupling", "CBO_avg"), _metric(means, "RFC_avg", "coupling", "RFC_avg")]
    rows += [_metric(inh, "DIT", "inheritance", "dit", "name"), _metric(inh, "NOC", "inheritance", "noc", "name"), _metric(tree, "DIT_max", "inheritance", "DIT_max"), _metric(tree, "NOC_total", "inheritance", "NOC_total")]
    rows += [_metric(co, "LCOM", "cohesion", "lcom", "name"), _metric(means, "LCOM_avg", "cohesion", "LCOM_avg"), _metric(doc, "doc_coverage", "documentation", "doc_coverage")]
    base = files.join(h.select("file", "volume", "effort"), "file", "left").join(s.select("file", "loc"), "file", "left").join(wmc.withColumnRenamed("v", "wmc"), "file", "left").join(loops.withColumnRenamed("v", "loops"), "file", "left").join(means, "file", "left").join(tree, "file", "left").join(doc, "file", "left").fillna(0)
    c = composites(base)
    rows += [_metric(c, n, "composite", n) for n in ("maintainability_index", "code_quality_index", "bug_hotspot_score", "refactoring_roi")]
    return reduce(lambda a, b: a.unionByName(b), rows)


def composites(base: DataFrame) -> DataFrame:
    """base with the four composite scores; it has volume, effort, loc, wmc, loops, CBO_avg, LCOM_avg, DIT_max, doc_coverage."""
    v = F.col
    mi = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (171 - 5.2 * F.log(v("volume") + 1) - 0.23 * v("wmc") - 16.2 * F.log(v("loc") + 1)) / 171 * 100)), 2)
    base = base.withColumn("maintainability_index", mi)
    part = lambda c, n: 1 - F.least(F.lit(1.0), v(c) / n)
    base = base.withColumn("code_quality_index", F.round(100 * (v("maintainability_index") / 100 * 0.4 + v("doc_coverage") * 0.3 + part("LCOM_avg", 10) * 0.2 + part("CBO_avg", 10) * 0.1), 2))
    base = base.withColumn("bug_hotspot_score", F.round(F.least(F.lit(100.0), v("effort") / 10000 * 50 + v("wmc") / 10 * 30 + v("loops") / 5 * 20), 2))
    return base.withColumn("refactoring_roi", F.round(F.least(F.lit(100.0), v("LCOM_avg") / 5 * 40 + v("DIT_max") / 6 * 30 + v("CBO_avg") / 10 * 30), 2))
