"""Dependency manifests and lock files as rows of the dependencies table: name, version, ecosystem, scope, purl, license."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import purl

ORDER = {"prod": 0, "dev": 1, "optional": 2}


def _rows(df: DataFrame, name, version, ecosystem: str, scope) -> DataFrame:
    text = lambda x: x if isinstance(x, Column) else F.col(x)
    v = F.coalesce(F.nullif(F.trim(text(version)), F.lit("")), F.lit(""))
    d = df.select(text(name).alias("name"), v.alias("version"), F.lit(ecosystem).alias("ecosystem"), (F.lit(scope) if isinstance(scope, str) else scope).alias("scope")).where("name != ''")
    return d.withColumn("purl", purl(F.col("ecosystem"), F.col("name"), F.col("version"))).withColumn("license", F.lit(None).cast("string"))


def npm(manifests: DataFrame, text: str = "text") -> DataFrame:
    """package.json: dependencies, devDependencies and optionalDependencies."""
    out = None
    for key, scope in (("dependencies", "prod"), ("devDependencies", "dev"), ("optionalDependencies", "optional")):
        m = manifests.select(F.explode(F.from_json(F.get_json_object(text, f"$.{key}"), "map<string,string>")).alias("n", "v"))
        one = _rows(m, "n", F.regexp_replace("v", "^[~^>=<\\s]+", ""), "npm", scope)
        out = one if out is None else out.unionByName(one)
    return out


def npm_lock(locks: DataFrame, text: str = "text") -> DataFrame:
    """package-lock.json: `packages` of versions 2 and 3, `dependencies` of version 1."""
    kind = "map<string,struct<version:string,dev:boolean,optional:boolean>>"
    scope = F.when(F.coalesce("p.dev", F.lit(False)), "dev").when(F.coalesce("p.optional", F.lit(False)), "optional").otherwise("prod")
    new = locks.select(F.explode(F.from_json(F.get_json_object(text, "$.packages"), kind)).alias("n", "p")).where("n != ''")
    old = locks.where(F.get_json_object(text, "$.packages").isNull()).select(F.explode(F.from_json(F.get_json_object(text, "$.dependencies"), kind)).alias("n", "p"))
    return _rows(new, F.regexp_replace("n", "^.*node_modules/", ""), "p.version", "npm", scope).unionByName(_rows(old, "n", "p.version", "npm", scope))


def _blocks(df: DataFrame, text: str, ecosystem: str) -> DataFrame:
    """[[package]] blocks of lock files."""
    b = df.select(F.explode(F.split(F.col(text), r"\[\[package\]\]")).alias("b"))
    return _rows(b, F.regexp_extract("b", r'(?m)^\s*name\s*=\s*"([^"]+)"', 1), F.regexp_extract("b", r'(?m)^\s*version\s*=\s*"([^"]+)"', 1), ecosystem, "prod")


def cargo_lock(locks: DataFrame, text: str = "text") -> DataFrame:
    return _blocks(locks, text, "cargo")


def poetry_lock(locks: DataFrame, text: str = "text") -> DataFrame:
    return _blocks(locks, text, "pypi")


def requirements(files: DataFrame, text: str = "text") -> DataFrame:
    """requirements.txt: names with a pinned or bounded version."""
    t = files.select(F.explode(F.split(F.col(text), "\r?\n")).alias("s")).withColumn("s", F.trim(F.regexp_replace("s", "(^|\\s)#.*|;.*", ""))).where("s != '' and not s like '-%'")
    return _rows(t, F.regexp_extract("s", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1), F.regexp_extract("s", r"(?:==|>=|~=|<=)\s*([0-9][^\s,]*)", 1), "pypi", "prod")


def _sections(files: DataFrame, text: str) -> DataFrame:
    """Sections of a TOML text: head and body."""
    s = files.select(F.explode(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=\[)")).alias("s"))
    return s.select(F.trim(F.regexp_extract("s", r"^\[+([^\]]*)\]", 1)).alias("head"), F.regexp_replace("s", r"^\[+[^\n]*\n?", "").alias("body"))


def _toml_pairs(files: DataFrame, text: str, heads: str) -> DataFrame:
    s = _sections(files, text).where(F.col("head").rlike(heads))
    p = s.select("head", F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").rlike(r'^\s*"?[A-Za-z0-9_.-]+"?\s*='))
    v = F.coalesce(F.nullif(F.regexp_extract("line", r'version\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract("line", r'=\s*"([^"]*)"', 1))
    return p.select("head", F.regexp_extract("line", r'^\s*"?([A-Za-z0-9_.-]+)', 1).alias("n"), F.regexp_replace(v, "^[~^>=<\\s]+", "").alias("v"))


def pyproject(files: DataFrame, text: str = "text") -> DataFrame:
    """pyproject.toml: the project's list and poetry's tables."""
    p = _toml_pairs(files, text, r"^tool\.poetry(\.group\.[^.]+)?\.(dev-)?dependencies$").where("n != 'python'")
    poetry = _rows(p, "n", "v", "pypi", F.when(F.col("head").rlike("dev|group"), "dev").otherwise("prod"))
    listed = _sections(files, text).where("head = 'project'").select(F.regexp_extract("body", r"(?s)(?:^|\n)dependencies\s*=\s*\[(.*?)\n?\]", 1).alias("l"))
    each = listed.select(F.explode(F.regexp_extract_all("l", F.lit(r'"([^"]+)"'), F.lit(1))).alias("s"))
    return poetry.unionByName(_rows(each, F.regexp_extract("s", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1), F.regexp_extract("s", r"(?:==|>=|~=|<=)\s*([0-9][^\s,]*)", 1), "pypi", "prod"))


def cargo(files: DataFrame, text: str = "text") -> DataFrame:
    p = _toml_pairs(files, text, r"^(dev-|build-)?dependencies$")
    return _rows(p, "n", "v", "cargo", F.when(F.col("head") == "dev-dependencies", "dev").otherwise("prod"))


def gradle(files: DataFrame, text: str = "text") -> DataFrame:
    plain = F.regexp_replace(F.col(text), r"(?s)/\*.*?\*/|(?<!:)//[^\n]*", "")
    g = files.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?:api|implementation|compile|compileOnly|runtimeOnly|testImplementation|testCompile|testRuntimeOnly)\s*\(?\s*['\"][^'\"]+['\"]"), F.lit(0))).alias("s"))
    parts = F.split(F.regexp_extract("s", r"['\"]([^'\"]+)['\"]", 1), ":")
    return _rows(g, F.concat_ws(":", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), F.coalesce(F.get(parts, F.lit(2)), F.lit("")), "maven", F.when(F.col("s").startswith("test"), "dev").otherwise("prod"))


def maven(files: DataFrame, text: str = "text") -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)<!--.*?-->", ""), r"(?s)<dependencyManagement>.*?</dependencyManagement>", "")
    d = files.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    tag = lambda t: F.regexp_extract("d", rf"<{t}>\s*([^<]*?)\s*</{t}>", 1)
    return _rows(d, F.concat_ws(":", tag("groupId"), tag("artifactId")), tag("version"), "maven", F.when(tag("scope") == "test", "dev").when(tag("optional") == "true", "optional").otherwise("prod"))


def go_mod(files: DataFrame, text: str = "text") -> DataFrame:
    g = files.select(F.explode(F.split(F.col(text), "\r?\n")).alias("s")).where(F.col("s").rlike(r"^\s*(require\s+)?[\w.-]+\.[\w./~-]+\s+v\d") & ~F.col("s").rlike("^\\s*(replace|exclude|module)\\b"))
    return _rows(g, F.regexp_extract("s", r"^\s*(?:require\s+)?(\S+)\s+v", 1), F.regexp_extract("s", r"\sv(\d\S*)", 1), "go", "prod")


def collect(frames: list[DataFrame]) -> DataFrame:
    """All of them; equal ones (ecosystem, name, version) once, with the scope that binds most."""
    from functools import reduce

    from ..operators.joins import first_match

    every = reduce(lambda a, b: a.unionByName(b), frames)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), "scope"), F.lit(9))
    return first_match(every, ["ecosystem", "name", "version"], [rank])


def maven_parents(poms: DataFrame, most: int = 6) -> DataFrame:
    """root, parent, hops: the chain of parent poms of each module, at most six up; a cycle ends it. poms: root, parent_relative_path."""
    from ..functions.text import normalised_path
    from ..operators import graph

    up = F.regexp_replace(F.coalesce(F.nullif("parent_relative_path", F.lit("")), F.lit("../pom.xml")), "/?pom\\.xml$", "")
    e = poms.where("parent_relative_path is not null").select(F.lit("").alias("project"), F.col("root").alias("src"), normalised_path(F.concat_ws("/", "root", up)).alias("dst"))
    e = e.join(poms.select(F.col("root").alias("dst")), "dst", "left_semi").where("src != dst")
    return graph.closure(e.select("project", "src", "dst"), ["project"], "src", "dst", at_most=most).where("src != dst").select(F.col("src").alias("root"), F.col("dst").alias("parent"), "hops")
