"""Passes on loops, blocking calls and allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import identifiers
from ..operators import joins
from .findings import findings
from .registry import register

# Fixed values.
DB_METHODS = "executeQuery executeUpdate prepareStatement prepareCall findById findAll saveAll deleteById existsById findByIdAndUpdate findByIdAndDelete findOneAndUpdate findOneAndDelete countDocuments aggregate distinct findByPk findAndCountAll bulkCreate bulkUpdate findFirst findUnique findMany createMany updateMany deleteMany fetch".split()
DB_METHODS_ON_CLIENTS = "query execute find findOne save create update delete insert upsert remove get post put patch request load lookup".split()
CLIENT_PREFIX = "(?i)^(db|conn|connection|pool|client|repo|repository|orm|em|entityManager|sequelize|mongoose|prisma|axios|http|https|api|svc|service|dao|store|cache|gql|graphql|mongo|redis|sql|pg|mysql|sqlite|dynamo|cosmos|elastic|es|solr|neo4j|cassandra|couchbase|firestore|supabase|drizzle|knex|typeorm|mikro)"
CLIENT_SUFFIX = "(Repository|Repo|Dao|DataSource|DbContext|Client|Service|Store|Cache|Gateway|Adapter|Provider|Manager|Handler|Proxy|Facade|Connection|Pool|Session|Template|Mapper|Access|Query|Command|Storage|Bucket|Table|Collection)$"
IN_MEMORY_SUFFIX = "(Index|Map|Lookup|Dict|ById|ByName|ByKey|ByType|ByPath|ByFile|ByLine)$"
IN_MEMORY_NAMES = "map set dict lookup index cache seen visited idom memo registry".split()
NUMERIC_NAMES = "(?i)^(i|j|k|n|m|x|y|z|count|sum|total|size|index|len|length|num|idx|score|counter|offset|pos|col|row|result|ret|value|acc|bits|byte|bytes|flag|flags|step|delta|diff|dist|min|max|avg|mean|page|line|err|error)$"
NUMERIC_SUFFIX = "(Count|Sum|Total|Size|Index|Length|Offset|Position|Score|Counter|Num|Amount|Val|Idx|Len|Max|Min|Avg|Delta|Diff|Step|Flag|Flags|Bits|Byte|Bytes|Calls|Items|Nodes|Edges|Blocks|Lines|Chars|Entries|Records|Rows)$"
GROWERS = {"java": "add put offer push addAll addFirst addLast enqueue insert".split(), "python": "append extend update add insert".split(), "rust": "push insert push_back push_front".split()}
GROWERS_ELSE = "push set add unshift append prepend".split()
SHRINKERS = "clear remove delete shift pop removeFirst removeLast poll pollFirst pollLast dequeue discard drain".split()
CRYPTO = "createHash hashSync pbkdf2Sync scryptSync generateKeyPairSync generateKeySync deriveKeySync".split()
HANDLER_ANNOTATIONS = "Get Post Put Patch Delete All Options Head Route Handler".split()
HANDLER_NAMES = "handle handler dispatch invoke serve".split()
HANDLER_PARAMS = "req res request response ctx c event".split()
ALLOCATIONS = {
    "javascript": "\\bnew\\s+(Array|Map|Set|Object|WeakMap|WeakSet|Error|RegExp|Date|Buffer|Uint8Array|Int8Array|Float32Array|ArrayBuffer)\\s*[(<]|\\bArray\\.from\\s*\\(|\\bstructuredClone\\s*\\(",
    "java": "\\bnew\\s+(ArrayList|HashMap|HashSet|LinkedList|TreeMap|TreeSet|PriorityQueue|ArrayDeque|StringBuilder|StringBuffer|CopyOnWriteArrayList|ConcurrentHashMap)\\s*[(<]",
    "python": "\\b(list|dict|set|tuple|bytearray|defaultdict|OrderedDict|Counter|deque)\\s*\\(\\s*\\)|\\[\\s*\\]|\\{\\s*\\}(?!\\s*[}\\]])",
    "rust": "\\b(Vec|HashMap|HashSet|BTreeMap|BTreeSet|VecDeque|LinkedList|String|Box|Rc|Arc)\\s*::\\s*new\\s*\\(",
}


def _first_loop(f: Facts, points: DataFrame, line: str, ids: list[str]) -> DataFrame:
    return joins.enclosing(points, f.loops, ["file"], line, "loop_start", "loop_end", ["loop_tail", "loop_head"], ids)


@register("n-plus-one", "performance")
def n_plus_one(f: Facts) -> DataFrame:
    """Database or network calls inside a loop."""
    name, who = F.col("method_name"), F.coalesce(F.col("receiver"), F.lit(""))
    memory = who.rlike(IN_MEMORY_SUFFIX) | F.lower(who).isin(IN_MEMORY_NAMES)
    client = who.rlike(CLIENT_PREFIX) | who.rlike(CLIENT_SUFFIX)
    calls = f.calls.where(name.isin(DB_METHODS) | (name.isin(DB_METHODS_ON_CLIENTS) & ~memory & client))
    hit = _first_loop(f, calls, "line", ["call_id"])
    return findings(hit, "n-plus-one", "performance", "CWE-1049", "medium", "warning", F.format_string("N+1 query: `%s()` is called inside the loop at lines %d to %d", "method_name", "loop_start", "loop_end"), fix="Fetch everything at once before the loop", evidence={"loop_start": "loop_start", "loop_end": "loop_end", "receiver": "receiver"})


@register("string-concat-loop", "performance")
def string_concat_loop(f: Facts) -> DataFrame:
    """`x +=` with a string in a loop, one finding a line."""
    t = f.source_lines.withColumn("variable", F.regexp_extract("text", "\\b([a-zA-Z_$][a-zA-Z0-9_$]*)\\s*\\+=", 1)).where("variable != ''")
    after = F.expr("substring(text, locate('+=', text) + 2)")
    t = t.where(~F.col("variable").rlike(NUMERIC_NAMES) & ~F.col("variable").rlike(NUMERIC_SUFFIX) & ~after.rlike("^\\s*[\\d.]"))
    hit = _first_loop(f, t, "line", ["line"])
    return findings(hit, "string-concat-loop", "performance", "CWE-1046", "low", "warning", F.format_string("'%s' grows by += in a loop, which copies it each time", "variable"), snippet=F.trim("text"), fix="Collect the parts and join them after the loop", evidence={"variable": "variable", "loop_start": "loop_start", "loop_end": "loop_end"})


def _inside(f: Facts, calls: DataFrame, methods: DataFrame) -> DataFrame:
    m = methods.select("file", F.col("name").alias("inside"), F.col("start_line").alias("m_start"), F.col("end_line").alias("m_end"), "type_ord", "method_ord")
    return joins.enclosing(calls, m, ["file"], "line", "m_start", "m_end", ["type_ord", "method_ord"], ["call_id"])


@register("sync-io-async", "performance")
def sync_io_async(f: Facts) -> DataFrame:
    """Blocking calls inside async functions."""
    calls = f.of_language(f.calls, "javascript", "typescript", "python").where(F.col("method_name").rlike("Sync$") | (F.col("method_name") == "sleep"))
    hit = _inside(f, calls, f.methods.where(F.array_contains("modifiers", "async")))
    return findings(hit, "sync-io-async", "performance", "CWE-1050", "medium", "warning", F.format_string("`%s()` blocks inside the async function '%s'", "method_name", "inside"), fix="Use the asynchronous form and await it", evidence={"blocking_method": "method_name", "async_method": "inside"})


@register("blocking-main-thread", "performance")
def blocking_main_thread(f: Facts) -> DataFrame:
    """Blocking or costly calls inside request handlers."""
    by_param = f.params.where(F.lower("name").isin(HANDLER_PARAMS)).select("file", "type_ord", "method_ord").distinct().withColumn("p", F.lit(True))
    handlers = f.methods.join(by_param, ["file", "type_ord", "method_ord"], "left")
    handlers = handlers.where(F.coalesce("p", F.lit(False)) | F.col("name").isin(HANDLER_NAMES) | F.coalesce(F.arrays_overlap("annotations", F.array(*map(F.lit, HANDLER_ANNOTATIONS))), F.lit(False)))
    crypto = F.col("method_name").isin(CRYPTO)
    calls = f.of_language(f.calls, "javascript", "typescript").where(crypto | F.col("method_name").rlike("Sync$"))
    hit = _inside(f, calls, handlers)
    return findings(hit, "blocking-main-thread", "performance", "CWE-1050", "medium", "warning", F.format_string("`%s()` blocks inside the request handler '%s'", "method_name", "inside"), fix="Use the asynchronous form or a worker", evidence={"method": "method_name", "handler": "inside", "reason": F.when(crypto, "crypto").otherwise("sync-suffix")})


@register("redundant-loop-computation", "performance")
def redundant_loop(f: Facts) -> DataFrame:
    """Sizes, key lists and maths of variables that the loop does not change."""
    js = F.col("language").isin("javascript", "typescript")
    name = "([A-Za-z_$][A-Za-z0-9_$]*)"
    kinds = [("", f"\\b{name}\\s*\\.\\s*(?:length|size\\(\\)|count\\(\\))"), ("-obj", f"\\bObject\\s*\\.\\s*(?:keys|values|entries)\\s*\\(\\s*{name}\\s*\\)"), ("-math", f"\\bMath\\s*\\.\\s*(?:sqrt|pow|abs|floor|ceil|round|log|log2|log10)\\s*\\(\\s*{name}\\s*[,)]")]
    lines = joins.range_join(f.source_lines, f.loops, ["file"], "line", "loop_start", "loop_end").join(f.files.where("language != 'bash'").select("file", "language"), "file")
    found = None
    for suffix, pattern in kinds:
        hit = lines.withColumn("expr", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).withColumn("variable", F.regexp_extract("expr", pattern, 1)).withColumn("suffix", F.lit(suffix))
        if not suffix:
            hit = hit.where(~(js & F.col("expr").rlike("length$")))
        found = hit if found is None else found.unionByName(hit)
    d = f.dfg_defs.select("file", "variable", F.col("line").alias("d_line"))
    ids = ["file", "line", "expr", "loop_tail", "loop_head"]
    changed = found.join(d, ["file", "variable"]).where("d_line between loop_start and loop_end").select(*ids).distinct()
    hit = joins.first_match(found.join(changed, ids, "left_anti"), ["file", "line", "expr"], ["loop_tail", "loop_head"])
    return findings(hit, "redundant-loop-computation", "performance", "CWE-1050", "low", "note", F.format_string("`%s` gives the same in each round of the loop", "expr"), snippet=F.trim("text"), fix="Compute it once before the loop", evidence={"variable": "variable", "loop_start": "loop_start", "loop_end": "loop_end"}, id_suffix=F.col("suffix"))


@register("unbounded-collection", "performance")
def unbounded_collection(f: Facts, skip: tuple[str, ...] = ()) -> DataFrame:
    """Collections that an open-ended loop fills, and neither empties nor checks the size of."""
    lang = F.col("language")
    grows = F.when(lang == "java", F.col("method_name").isin(GROWERS["java"])).when(lang == "python", F.col("method_name").isin(GROWERS["python"])).when(lang == "rust", F.col("method_name").isin(GROWERS["rust"])).otherwise(F.col("method_name").isin(GROWERS_ELSE))
    loops = f.loops.join(f.files.where("language != 'bash'").select("file", "language"), "file")
    lines = joins.range_join(f.source_lines, loops.select("file", "loop_start", "loop_end").distinct(), ["file"], "line", "loop_start", "loop_end")
    bounded = lines.where(((F.col("line") == F.col("loop_start")) & F.col("text").rlike("\\bfor\\s*\\(.*\\b(?:of|in)\\b|\\bfor\\s+\\w+\\s+in\\b|\\bfor\\s*\\([^;]*:[^;]*\\)|\\.(?:forEach|map|flatMap|filter|reduce)\\s*\\(")) | F.col("text").rlike("(?i)\\b(?:size|length|count|len)\\s*\\(\\)?\\s*[<>]=?\\s*\\d|\\b(?:MAX|LIMIT|CAPACITY|MAX_SIZE)\\b")).select("file", "loop_start", "loop_end").distinct()
    loops = loops.join(bounded, ["file", "loop_start", "loop_end"], "left_anti")
    calls = joins.range_join(f.calls.select("file", "line", "receiver", "method_name"), loops, ["file"], "line", "loop_start", "loop_end")
    per = ["file", "receiver", "loop_start", "loop_end"]
    shrunk = calls.where(F.col("method_name").isin(SHRINKERS) & F.col("receiver").isNotNull()).select(*per).distinct()
    hit = calls.where(grows & F.col("receiver").isNotNull() & ~F.col("receiver").isin("this", "self", "", *skip)).groupBy(*per).agg(F.min("line").alias("line")).join(shrunk, per, "left_anti")
    hit = joins.first_match(hit, ["file", "receiver", "loop_start"], ["loop_end"])
    return findings(hit, "unbounded-collection", "performance", "CWE-770", "medium", "warning", F.format_string("`%s` grows in the loop at lines %d to %d without a limit", "receiver", "loop_start", "loop_end"), fix="Limit its size or empty it now and then", evidence={"receiver": "receiver", "loop_start": "loop_start", "loop_end": "loop_end"}, id_suffix=F.concat(F.lit("-"), "receiver"))


@register("serial-await", "performance")
def serial_await(f: Facts) -> DataFrame:
    """Two awaits in a row in one function, at most four lines apart, that do not need each other; the first pair of each function."""
    t = f.of_language(f.source_lines, "javascript", "typescript").where(F.col("text").rlike("\\bawait\\s")).withColumn("bound", F.regexp_extract("text", "(?:const|let|var)?\\s*(\\w+)\\s*=\\s*await\\s", 1))
    t = f.in_method(t, "line", ["line"], "left").withColumn("where", F.coalesce(F.concat_ws(".", "m_type", "m_name", "m_start"), F.concat(F.lit("top."), F.col("line").cast("string"))))
    t = t.withColumn("where", F.when(F.col("m_start").isNull(), F.concat(F.lit("top."), F.col("line").cast("string"))).otherwise(F.col("where")))
    next_ = Window.partitionBy("file").orderBy("line")
    p = t.select("*", *[F.lead(c).over(next_).alias(f"{c}2") for c in ("line", "text", "bound", "where")]).where("`where` = where2 and line2 - line <= 4")
    uses = lambda text, name: (F.col(name) != "") & F.array_contains(identifiers(text), F.col(name))
    p = p.where(~uses("text2", "bound") & ~uses("text", "bound2"))
    d = f.dfg_defs.select("file", "variable", "line")
    same = p.select("file", "line", "line2").join(d, ["file", "line"]).join(d.withColumnRenamed("line", "line2"), ["file", "variable", "line2"]).select("file", "line").distinct()
    p = joins.first_match(p.join(same, ["file", "line"], "left_anti"), ["file", "where"], ["line"])
    return findings(p, "serial-await", "performance", None, "low", "note", F.format_string("The awaits at lines %d and %d do not need each other", "line", "line2"), "line", "line2", F.trim("text"), "Wait for both at once", evidence={"first_await_line": "line", "second_await_line": "line2", "function_line": F.coalesce("m_start", "line")})


@register("excessive-allocation", "performance")
def excessive_allocation(f: Facts) -> DataFrame:
    """Collections that a loop makes anew in each round, one finding a line."""
    t = f.source_lines.join(f.files.select("file", F.when(F.col("language") == "typescript", "javascript").otherwise(F.col("language")).alias("language")), "file")
    made = F.lit("")
    for language, pattern in ALLOCATIONS.items():
        made = F.when(F.col("language") == language, F.regexp_extract("text", pattern, 0)).otherwise(made)
    t = t.withColumn("made", F.trim(F.regexp_replace(made, "\\s+", " "))).where((F.col("made") != "") & ~F.col("text").rlike("(?i)\\bpool\\b|\\bcache\\b|\\breuse\\b|\\bpreallocat|\\brecycl"))
    hit = _first_loop(f, t, "line", ["line"])
    return findings(hit, "excessive-allocation", "performance", "CWE-770", "medium", "warning", F.format_string("`%s` is made anew in each round of the loop at lines %d to %d", "made", "loop_start", "loop_end"), snippet=F.trim("text"), fix="Make it once before the loop and use it again", evidence={"allocation": "made", "loop_start": "loop_start", "loop_end": "loop_end"})
