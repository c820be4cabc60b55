"""Scalar functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.joins import identifiers, simple_name

__all__ = ["identifiers", "simple_name", "any_of", "entropy", "glob_to_regex", "strip_generics", "purl", "compare_versions", "satisfies", "is_vulnerable", "whole_word", "normalised_path", "sha16"]


def any_of(names) -> str:
    """A regular expression that is one of the names."""
    return "^(" + "|".join(re.escape(n) for n in names) + ")$"


def glob_to_regex(glob: str) -> str:
    """`**` any path, `*` any part of a name, `?` one character of it; anchored at both ends."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def whole_word(text: Column, word: Column) -> Column:
    """The word occurs in the text as an identifier: equality of tokens, no regular expression made from data."""
    return F.array_contains(identifiers(text), word)


def strip_generics(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "<.*>", ""))


def sha16(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits for each character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def normalised_path(path: Column) -> Column:
    """`.` and `..` resolved."""
    step = lambda a, x: F.when((x == "") | (x == "."), a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == "..", a).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


_KINDS = {"npm": "npm", "pypi": "pypi", "maven": "maven", "cargo": "cargo", "go": "golang"}


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """Package URL: pkg:<type>/<namespace>/<name>@<version>, parts percent-encoded."""
    kind = reduce(lambda a, kv: a.when(ecosystem == kv[0], F.lit(kv[1])), _KINDS.items(), F.when(F.lit(False), F.lit("")))
    plain = F.when(ecosystem == "pypi", F.regexp_replace(F.lower(name), "_", "-")).when(ecosystem == "maven", F.regexp_replace(name, ":", "/")).otherwise(name)
    encode = lambda x: F.regexp_replace(F.regexp_replace(F.url_encode(x), "\\+", "%20"), "%2A", "*")
    path = F.array_join(F.transform(F.split(plain, "/"), encode), "/")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), path, F.when((version.isNull()) | (version == ""), F.lit("")).otherwise(F.concat(F.lit("@"), encode(version))))


def _parts(version: Column) -> Column:
    """Major, minor and patch as numbers, and whether there is a pre-release."""
    core = F.regexp_replace(F.trim(version), "^[vV=]+", "")
    number = lambda i: F.coalesce(F.expr("int(0)") if False else F.regexp_extract(core, r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?", i).try_cast("int"), F.lit(0))
    pre = F.regexp_extract(core, r"^[\d.]+-([0-9A-Za-z.-]+)", 1)
    return F.struct(number(1).alias("a"), number(2).alias("b"), number(3).alias("c"), (pre == "").alias("release"), pre.alias("pre"))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; a pre-release comes before its release."""
    x, y = _parts(a), _parts(b)
    return F.when(x == y, F.lit(0)).when(x < y, F.lit(-1)).otherwise(F.lit(1))


def satisfies(version: Column, spec: str) -> Column:
    """Version ranges: ^ ~ comparisons, `a - b`, x and * wildcards, `||` between alternatives, blanks between conditions."""

    def bound(major: int, minor: int, patch: int) -> Column:
        return F.lit(f"{major}.{minor}.{patch}")

    def compare(op: str, v: Column) -> Column:
        d = compare_versions(version, v)
        return {">=": d >= 0, ">": d > 0, "<=": d <= 0, "<": d < 0, "=": d == 0}[op]

    def one(term: str) -> Column:
        m = re.fullmatch(r"(\^|~>?|>=|<=|>|<|=)?\s*v?(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(-[0-9A-Za-z.-]+)?(?:\+.*)?", term)
        if m is None:
            return F.lit(False)
        op, raw, pre = m[1] or "", [m[2], m[3], m[4]], m[5] or ""
        nums = [int(x) if x is not None and x.isdigit() else None for x in raw]
        if nums[0] is None:
            return F.lit(True)
        low = F.lit(".".join(str(x or 0) for x in nums) + pre)
        if op == "^":
            k = next((i for i, x in enumerate(nums) if x), 0 if nums[1] is None else 1 if nums[2] is None else 2)
            high = [x or 0 for x in nums[: k + 1]]
        elif op.startswith("~") or (op in ("", "=") and None in nums):
            k = 0 if nums[1] is None else 1
            high = [x or 0 for x in nums[: k + 1]]
        else:
            return compare(op or "=", low)
        high[-1] += 1
        high += [0] * (3 - len(high))
        return compare(">=", low) & compare("<", bound(*high))

    def every(part: str) -> Column:
        part = part.strip()
        if part in ("", "*", "x", "latest"):
            return F.lit(True)
        if m := re.fullmatch(r"(\S+)\s+-\s+(\S+)", part):
            return compare(">=", F.lit(m[1])) & compare("<=", F.lit(m[2]))
        terms = re.findall(r"(?:\^|~>?|>=|<=|>|<|=)?\s*[^\s,]+", part)
        return reduce(lambda a, b: a & b, [one(re.sub(r"\s+", "", t)) for t in terms])

    return reduce(lambda a, b: a | b, [every(p) for p in spec.split("||")])


def is_vulnerable(version: Column, patched: list[str], unaffected: list[str]) -> Column:
    """Neither in an unaffected range nor in a patched one."""
    hit = [satisfies(version, s) for s in [*unaffected, *patched]]
    return ~reduce(lambda a, b: a | b, hit, F.lit(False))
