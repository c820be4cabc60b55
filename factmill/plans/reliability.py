"""Passes on errors, null values, resources and control flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import any_of, identifiers
from ..operators import graph, joins
from .findings import findings
from .registry import register

# Fixed values.
RESOURCE_CTORS = "FileInputStream FileOutputStream FileReader FileWriter BufferedReader BufferedWriter PrintWriter InputStreamReader OutputStreamWriter RandomAccessFile DataInputStream DataOutputStream ObjectInputStream ObjectOutputStream ZipInputStream ZipOutputStream JarInputStream JarOutputStream GZIPInputStream GZIPOutputStream FileChannel Socket ServerSocket DatagramSocket".split()
RESOURCE_FACTORIES = "openConnection openStream newInputStream newOutputStream newBufferedReader newBufferedWriter newByteChannel open createReadStream createWriteStream createConnection".split()
CLOSERS = "close dispose shutdown disconnect release destroy free shutdownNow terminate".split()
MUST_CHECK = "createNewFile mkdir mkdirs tryLock tryAcquire compareAndSet compareAndExchange".split()
MUST_CHECK_JAVA = "delete find".split()
MUST_CHECK_ON_FILES = "renameTo setExecutable setReadable setWritable setLastModified".split()
ASYNC = "readFile writeFile appendFile unlink rmdir mkdir readdir stat lstat access rename copyFile fetch query execute findOne findById findByIdAndUpdate findByIdAndDelete findOneAndUpdate findOneAndDelete countDocuments aggregate findAll findAndCountAll bulkCreate findFirst findUnique findMany connect disconnect".split()


def opened(f: Facts) -> DataFrame:
    """file, call_id, resource, open_line, variable, m_start, m_end: resources that are opened into a variable inside a method."""
    made = F.coalesce(F.col("is_constructor"), F.lit(False))
    opens = f.calls.where((made & F.col("method_name").rlike(any_of(RESOURCE_CTORS))) | (~made & F.col("method_name").rlike(any_of(RESOURCE_FACTORIES))))
    first = joins.first_match(f.dfg_defs, ["file", "line"], ["id"]).select("file", F.col("line").alias("open_line"), "variable")
    rows = opens.select("file", "call_id", F.col("method_name").alias("resource"), F.col("line").alias("open_line")).join(first, ["file", "open_line"])
    return f.in_method(rows, "open_line", ["call_id"])


def _on_variable(f: Facts, opens: DataFrame, close: bool) -> DataFrame:
    """Later calls on the variable within the method: those that close it, or all others."""
    is_close = F.col("method_name").rlike(any_of(CLOSERS))
    c = f.calls.where(is_close if close else ~is_close).select("file", F.col("receiver").alias("variable"), F.col("line").alias("at"), F.col("call_id").alias("at_id"), F.col("method_name").alias("at_name"))
    return opens.join(c, ["file", "variable"]).where("at > open_line and at <= m_end")


@register("dead-code", "reliability")
def dead_code(f: Facts) -> DataFrame:
    """Blocks that no root reaches. Roots have successors and no predecessors; else a file's entry block, else its first."""
    b, e = f.cfg_blocks, f.cfg_edges
    outs = e.select("file", F.col("from").alias("id")).distinct()
    ins = e.select("file", F.col("to").alias("id")).distinct()
    roots = outs.join(ins, ["file", "id"], "left_anti")
    other = b.join(roots.select("file"), "file", "left_anti")
    entry = joins.first_match(other, ["file"], [(F.col("type") != "entry").cast("int"), "id"]).select("file", "id")
    live = graph.reached(roots.unionByName(entry), e, ["file"], "id", "from", "to")
    dead = b.join(live, ["file", "id"], "left_anti").where("type not in ('entry', 'exit') and start_line > 0")
    with_prev = f.with_text(f.with_text(dead.withColumn("line", F.col("start_line"))).withColumnRenamed("text", "own").withColumn("before", F.col("start_line") - 1), "before")
    dead = with_prev.where(~F.rtrim("text").rlike("(\\{|=>)$"))
    return findings(dead, "dead-code", "reliability", "CWE-561", "low", "warning", F.format_string("Unreachable code: lines %d to %d", "start_line", "end_line"), "start_line", "end_line", F.trim("own"), "Remove the block or the jump before it")


@register("missing-await", "reliability")
def missing_await(f: Facts) -> DataFrame:
    """Calls that return a promise which is neither awaited, kept nor returned."""
    c = f.of_language(f.calls, "javascript", "typescript").where(F.col("method_name").rlike(any_of(ASYNC)))
    c = f.with_text(c.join(f.dfg_defs.select("file", "line").distinct(), ["file", "line"], "left_anti"))
    c = c.where(~F.col("text").rlike("\\bawait\\b") & ~F.col("text").rlike("^\\s*return\\b"))
    return findings(c, "missing-await", "reliability", "CWE-252", "medium", "warning", F.format_string("Missing await: `%s()` gives a promise that nobody waits for", "method_name"), snippet=F.trim("text"), fix="Await the call, or keep the promise and handle its rejection")


@register("unchecked-return", "reliability")
def unchecked_return(f: Facts) -> DataFrame:
    """Calls that tell of failure by their result, which is thrown away."""
    java = f.files.where("language = 'java'").select("file", F.lit(True).alias("java"))
    n = F.col("method_name")
    on_file = F.coalesce(F.col("receiver"), F.lit("")).rlike("(?i)^(file|f|src|dest|target|source|dir|directory|path|tmp|temp)\\b")
    c = f.calls.join(java, "file", "left").where(n.rlike(any_of(MUST_CHECK)) | (F.col("java") & n.rlike(any_of(MUST_CHECK_JAVA))) | (n.rlike(any_of(MUST_CHECK_ON_FILES)) & on_file))
    c = f.with_text(c.join(f.dfg_defs.select("file", "line").distinct(), ["file", "line"], "left_anti"))
    c = c.where(~F.col("text").rlike("\\bif\\s*\\(|\\bwhile\\s*\\(|\\bassert\\b|\\?[^:]|\\|\\||&&"))
    who = F.concat(F.when(F.col("receiver").isNull() | (F.col("receiver") == ""), F.lit("")).otherwise(F.concat("receiver", F.lit("."))), n)
    return findings(c, "unchecked-return", "reliability", "CWE-252", "medium", "warning", F.concat(F.lit("The result of `"), who, F.lit("()` is thrown away: failures go unseen")), snippet=F.trim("text"), fix="Check the result", evidence={"receiver": "receiver"})


@register("null-deref", "reliability")
def null_deref(f: Facts) -> DataFrame:
    """Variables set to null and used in the same method without a check in between."""
    d = f.of_language(f.dfg_defs, "rust", "bash", but=True).where(F.col("expression").rlike("^\\s*(null|None|undefined)\\s*$"))
    d = f.in_method(d.select("file", F.col("id").alias("def_id"), F.col("line").alias("def_line"), "variable"), "def_line", ["def_id"], "left")
    u = f.dfg_uses.where("def_id is not null").select("file", "def_id", F.col("line").alias("use_line"))
    p = d.join(u, ["file", "def_id"]).where("use_line > def_line and (m_end is null or use_line <= m_end)").dropDuplicates(["file", "def_id", "use_line"])
    p = f.with_text(p, "use_line")
    received = f.calls.select("file", F.col("line").alias("use_line"), F.col("receiver").alias("variable")).distinct().withColumn("received", F.lit(True))
    p = p.join(received, ["file", "use_line", "variable"], "left")
    quoted = F.regexp_replace("variable", "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
    has = lambda text, *parts: F.rlike(text, F.concat(*[F.lit(x) if x is not None else quoted for x in parts]))
    p = p.where((F.col("received") | has(F.col("text"), "\\b", None, "\\s*\\.")) & ~has(F.col("text"), "\\b", None, "\\s*\\?\\s*\\."))
    p = p.withColumn("guard", F.concat(
        F.lit("\\b"), quoted, F.lit("\\b\\s*[!=]==?\\s*(null|None|undefined)|(null|None|undefined)\\s*[!=]==?\\s*\\b"), quoted,
        F.lit("\\b|\\bis\\s+not\\s+None\\b.*\\b"), quoted, F.lit("\\b|\\b"), quoted, F.lit("\\b.*\\bis\\s+not\\s+None\\b|if\\s*\\(\\s*"), quoted,
        F.lit("\\s*[)!&|]|if\\s+"), quoted, F.lit("\\s*:|\\b"), quoted, F.lit("\\b\\s*\\.\\s*isPresent\\(\\)|\\bOptional\\b|\\b(?:requireNonNull|checkNotNull|notNull|assertNotNull)\\s*\\(\\s*"), quoted, F.lit("\\b"),
    ))
    between = f.source_lines.select("file", F.col("line").alias("g_line"), F.col("text").alias("g_text"))
    guarded = p.select("file", "def_id", "use_line", "def_line", "guard").join(between, "file").where((F.col("g_line") > F.col("def_line")) & (F.col("g_line") < F.col("use_line")) & F.expr("g_text rlike guard"))
    p = p.join(guarded.select("file", "def_id", "use_line").distinct(), ["file", "def_id", "use_line"], "left_anti")
    p = joins.first_match(p, ["file", "variable", "use_line"], ["def_id"])
    return findings(p, "null-deref", "reliability", "CWE-476", "high", "error", F.format_string("'%s' is null since line %d and is used at line %d without a check", "variable", "def_line", "use_line"), "use_line", snippet=F.trim("text"), fix="Check for null before use", evidence={"variable": "variable", "assigned_null_at": "def_line"})


@register("resource-leak", "reliability")
def resource_leak(f: Facts) -> DataFrame:
    """Resources that are opened into a variable and never closed in the method, or closed outside of a finally block."""
    o = opened(f)
    closes = _on_variable(f, o, True).groupBy("file", "call_id").agg(F.min("at").alias("close_line"))
    text = f.with_text(o, "open_line")
    body = f.source_lines.select("file", F.col("line").alias("b_line"), F.col("text").alias("b_text"))
    inside = joins.range_join(body, o.select("file", "call_id", "variable", "m_start", "m_end"), ["file"], "b_line", "m_start", "m_end")
    seen = inside.groupBy("file", "call_id").agg(F.bool_or(F.col("b_text").rlike("\\bfinally\\b")).alias("finally"), F.bool_or(F.col("b_text").rlike("^\\s*return\\b") & F.array_contains(identifiers("b_text"), F.col("variable"))).alias("returned"))
    o = text.join(closes, ["file", "call_id"], "left").join(seen, ["file", "call_id"], "left")
    o = o.where(~F.coalesce("returned", F.lit(False)) & ~F.col("text").rlike("\\btry\\s*\\(|\\bwith\\b|\\bthis\\.") & (F.col("close_line").isNull() | ~F.coalesce("finally", F.lit(False))))
    never = F.col("close_line").isNull()
    return findings(o, "resource-leak", "reliability", "CWE-772", F.when(never, "high").otherwise("medium"), F.when(never, "error").otherwise("warning"), F.when(never, F.format_string("`%s` from line %d is never closed", "variable", "open_line")).otherwise(F.format_string("`%s` from line %d is not closed in a finally block", "variable", "open_line")), "open_line", snippet=F.trim("text"), fix="Close the resource on all paths", evidence={"resource": "resource", "variable": "variable"})


@register("double-close", "reliability")
def double_close(f: Facts) -> DataFrame:
    """Two closes of a resource in its method, unless a `finally` stands before each of them."""
    o = f.of_language(opened(f), "bash", but=True)
    fin = f.source_lines.where(F.col("text").rlike("\\bfinally\\b")).select("file", F.col("line").alias("fin_line"))
    first = joins.range_join(fin, o.select("file", "call_id", "m_start", "m_end"), ["file"], "fin_line", "m_start", "m_end").groupBy("file", "call_id").agg(F.min("fin_line").alias("fin"))
    c = _on_variable(f, o, True).groupBy("file", "call_id", "variable", "open_line").agg(F.sort_array(F.collect_list("at")).alias("lines"))
    c = c.where(F.size("lines") >= 2).join(first, ["file", "call_id"], "left").where(F.col("fin").isNull() | (F.get("lines", F.lit(0)) < F.col("fin")))
    listed = F.array_join(F.transform("lines", lambda x: x.cast("string")), " and ")
    return findings(c, "double-close", "reliability", "CWE-675", "medium", "warning", F.concat(F.lit("Double close: `"), "variable", F.lit("` is closed at lines "), listed), "open_line", fix="Close the resource once, in a finally block", evidence={"variable": "variable", "close_lines": "lines"})


@register("use-after-close", "reliability")
def use_after_close(f: Facts) -> DataFrame:
    """Calls on a resource after the first close that follows its opening."""
    o = f.of_language(opened(f), "bash", but=True)
    first = _on_variable(f, o, True).groupBy("file", "call_id").agg(F.min("at").alias("close_line"))
    u = _on_variable(f, o.join(first, ["file", "call_id"]), False).where("at > close_line")
    return findings(u, "use-after-close", "reliability", "CWE-672", "high", "error", F.format_string("`%s.%s()` at line %d comes after the close at line %d", "variable", "at_name", "at", "close_line"), "at", fix="Use the resource only while it is open", evidence={"variable": "variable", "open_line": "open_line", "close_line": "close_line"})


def post_dominators(f: Facts) -> DataFrame:
    """file, id, enter, leave: the dominator tree over reversed edges, from a file's exit block (else its first block without successors)."""
    b, e = f.cfg_blocks, f.cfg_edges
    ends = b.join(e.select("file", F.col("from").alias("id")).distinct(), ["file", "id"], "left_anti").where("type != 'exit'").select("file", "id", F.lit(1).alias("k"))
    exits = b.where("type = 'exit'").select("file", "id", F.lit(0).alias("k"))
    root = joins.first_match(exits.unionByName(ends), ["file"], ["k", "id"]).select("file", "id")
    return graph.dominator_tree(b, e, root, ["file"], "id", "to", "from").select("file", "id", "enter", "leave")


@register("cleanup-verify", "reliability")
def cleanup_verify(f: Facts) -> DataFrame:
    """Closes that do not lie on all paths from the opening: the close's block does not post-dominate the opening's."""
    o = f.of_language(opened(f), "bash", but=True)
    c = joins.first_match(_on_variable(f, o, True), ["file", "call_id"], ["at_id"])
    blocks = f.cfg_blocks.select("file", F.col("id").alias("block"), "start_line", "end_line")
    at = lambda df, line, name: joins.enclosing(df, blocks, ["file"], line, "start_line", "end_line", ["block"], ["call_id"]).withColumnRenamed("block", name).drop("start_line", "end_line")
    c = at(at(c, "open_line", "open_block"), "at", "close_block")
    tree = post_dominators(f)
    c = c.join(tree.select("file", F.col("id").alias("open_block"), F.col("enter").alias("o_enter")), ["file", "open_block"]).join(tree.select("file", F.col("id").alias("close_block"), "enter", "leave"), ["file", "close_block"])
    c = c.where("not (o_enter between enter and leave)")
    return findings(c, "cleanup-verify", "reliability", "CWE-772", "medium", "warning", F.format_string("`%s` from line %d may stay open: the close at line %d is not on all paths", "variable", "open_line", "at"), "open_line", fix="Use try-with-resources or a finally block", evidence={"resource": "resource", "variable": "variable", "close_line": "at"})


@register("swallowed-exception", "reliability")
def swallowed_exception(f: Facts) -> DataFrame:
    """Catch bodies without a throw, a log or a return of something. A body ends where its braces balance."""
    p = f.of_language(f.exception_pairs, "rust", "bash", but=True).select("file", "catch_start").distinct()
    p = f.in_method(p, "catch_start", ["catch_start"], "left")
    lines = f.source_lines.select("file", F.col("line").alias("b_line"), "text")
    body = p.join(lines, "file").where("b_line >= catch_start and (m_end is null or b_line <= m_end)")
    per = Window.partitionBy("file", "catch_start").orderBy("b_line")
    opens, shuts = F.length(F.regexp_replace("text", "[^{]", "")), F.length(F.regexp_replace("text", "[^}]", ""))
    lead = F.length(F.regexp_replace(F.regexp_extract("text", "^[^{]*", 0), "[^}]", ""))
    body = body.withColumn("opened", F.sum(opens).over(per)).withColumn("started_before", F.coalesce(F.lag("opened").over(per), F.lit(0)) > 0)
    body = body.withColumn("depth", F.sum(F.when(F.col("started_before"), opens - shuts).when(opens > 0, opens - (shuts - lead)).otherwise(F.lit(0))).over(per))
    end = body.where("opened > 0 and depth <= 0").groupBy("file", "catch_start").agg(F.min("b_line").alias("body_end"))
    body = body.join(end, ["file", "catch_start"], "left").where("body_end is null or b_line <= body_end")
    acts = F.col("text").rlike("\\b(throw|raise|log|logger|console\\.(error|warn|log|debug|info)|System\\.(out|err)\\.|print(?:ln|f)?|warn|error|debug|info|fatal|LOGGER|LOG|logging\\.(warning|error|debug|info|critical))\\b|\\breturn\\s+\\S")
    silent = body.groupBy("file", "catch_start").agg(F.bool_or(acts).alias("acts")).where("not acts")
    return findings(silent, "swallowed-exception", "reliability", "CWE-390", "medium", "warning", F.format_string("The catch block at line %d neither throws, logs nor returns", "catch_start"), "catch_start", fix="Log the exception or throw it again")


@register("broad-catch", "reliability")
def broad_catch(f: Facts) -> DataFrame:
    """Catches of the most general exception types."""
    p = f.with_text(f.exception_pairs.select("file", F.col("catch_start").alias("line")).distinct()).join(f.files.select("file", "language"), "file")
    p = p.withColumn("caught", F.when(F.col("language") == "java", F.regexp_extract("text", "catch\\s*\\(\\s*(Exception|Throwable|RuntimeException|Error)\\s", 1)).when((F.col("language") == "python") & F.col("text").rlike("^\\s*except\\s*:"), "Exception").when(F.col("language") == "python", F.regexp_extract("text", "except\\s+(Exception|BaseException)\\b", 1)))
    return findings(p.where("caught != ''"), "broad-catch", "reliability", "CWE-396", "low", "warning", F.format_string("Broad catch: `%s` at line %d hides unexpected errors", "caught", "line"), fix="Catch the types that the code can handle")


@register("infinite-loop", "reliability")
def infinite_loop(f: Facts) -> DataFrame:
    """Natural loops without an edge that leaves them and without a word that ends them."""
    b, e = f.cfg_blocks, f.of_language(f.cfg_edges, "bash", but=True)
    back = e.where("type = 'back'").select("file", F.col("from").alias("tail"), F.col("to").alias("head")).distinct()
    fwd = e.where("type != 'back'").select("file", "from", "to").distinct()
    keyed = fwd.join(back, "file").select("file", "tail", "head", "from", "to")
    heads = back.withColumn("id", F.col("head"))
    # the body: what leads to the tail without passing the header
    inside = graph.reached(back.withColumn("id", F.col("tail")), keyed, ["file", "tail", "head"], "id", "to", "from", stop=heads).select("file", "tail", "head", "id").unionByName(heads.select("file", "tail", "head", "id")).distinct()
    out = inside.join(fwd.withColumnRenamed("from", "id"), ["file", "id"]).select("file", "tail", "head", F.col("to").alias("id")).join(inside, ["file", "tail", "head", "id"], "left_anti").select("file", "tail", "head").distinct()
    lines = b.select("file", F.col("id").alias("tail"), F.col("end_line").alias("loop_end"))
    heads = b.select("file", F.col("id").alias("head"), F.col("start_line").alias("loop_start"))
    loops = back.join(out, ["file", "tail", "head"], "left_anti").join(lines, ["file", "tail"]).join(heads, ["file", "head"])
    words = f.source_lines.where(F.col("text").rlike("\\b(break|return|throw|raise|exit|panic)\\b")).select("file", F.col("line").alias("w_line"))
    ends = joins.range_join(words, loops, ["file"], "w_line", "loop_start", "loop_end").select("file", "tail", "head").distinct()
    return findings(loops.join(ends, ["file", "tail", "head"], "left_anti"), "infinite-loop", "reliability", "CWE-835", "medium", "warning", F.format_string("No way out of the loop at lines %d to %d", "loop_start", "loop_end"), "loop_start", "loop_end", fix="Add a condition that ends the loop")


@register("unhandled-exception", "reliability")
def unhandled_exception(f: Facts) -> DataFrame:
    """The first throw of a method outside of try blocks and not after one of its catches."""
    python = F.col("language") == "python"
    t = f.source_lines.join(f.files.where("language in ('javascript', 'typescript', 'python')").select("file", "language"), "file")
    t = t.where(F.when(python, F.col("text").rlike("^\\s*raise\\b")).otherwise(F.col("text").rlike("^\\s*throw\\s+")))
    t = f.in_method(t, "line", ["line"], "left")
    pairs = f.exception_pairs.where("catch_start > try_start")
    covered = t.select("file", "line").join(pairs, "file").where("line >= try_start and line < catch_start").select("file", "line").distinct()
    catches = f.in_method(f.exception_pairs.select("file", "catch_start").distinct(), "catch_start", ["catch_start"]).select("file", "m_start", "catch_start")
    after = t.select("file", "line", "m_start").join(catches, ["file", "m_start"]).where("line >= catch_start").select("file", "line").distinct()
    t = t.join(covered, ["file", "line"], "left_anti").join(after, ["file", "line"], "left_anti")
    first = joins.first_match(t, ["file", F.coalesce(F.col("m_start"), -F.col("line"))], ["line"])
    return findings(first, "unhandled-exception", "reliability", "CWE-390", "medium", "warning", F.format_string("The throw at line %d in `%s` lies in no try block", F.col("line"), F.coalesce("m_name", F.lit("<anonymous>"))), snippet=F.trim("text"), fix="Catch it, or say in the signature that it is thrown")
