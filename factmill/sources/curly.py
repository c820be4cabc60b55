"""Facts of languages with braces (Java, JavaScript, TypeScript, Go, C#, Rust), read by a lexer one file at a time.

No grammar is at hand, so structure comes from what such languages share: comments and strings are blanked out, braces are matched,
and declarations are recognised by their heads. What a head does not tell (a receiver's type without a declaration, say) stays null.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

from ..facts import SCHEMAS

LANGUAGES = ("java", "javascript", "typescript", "go", "csharp", "rust")
TABLES = ("types", "methods", "params", "fields", "calls", "call_args", "dfg_defs", "dfg_uses", "dfg_chains", "cfg_blocks", "cfg_edges")

# Fixed values.
KEYWORDS = frozenset("if for while switch catch return new else do try finally throw synchronized function func fn def await yield case instanceof typeof sizeof super this match loop select defer go lambda using lock foreach unless with in of".split())
MODIFIERS = frozenset("public private protected static final abstract async synchronized native default override virtual sealed internal readonly export pub unsafe const".split())
_SKIP = re.compile(r"""//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_TYPE = re.compile(r"((?:@[\w.]+(?:\([^)]*\))?\s+)*)((?:\b(?:%s)\s+)*)\b(class|interface|enum|record|struct|trait)\s+(\w+)(?:<[^{(]*?>)?\s*(?:\([^)]*\)\s*)?([^{;]*)\{" % "|".join(MODIFIERS))
_GO_TYPE = re.compile(r"\btype\s+(\w+)\s+(struct|interface)\s*\{")
_METHOD = re.compile(r"((?:@[\w.]+(?:\([^)]*\))?\s+)*)((?:\b(?:%s)\s+)*)(?:<[^>]*>\s*)?(?:([\w.<>\[\],?&\s]+?)\s+)?\b(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*[\w<>\[\]|. ]+)?\s*(?:throws\s+[\w.,\s]+)?\{" % "|".join(MODIFIERS))
_FUNCTION = re.compile(r"((?:@[\w.]+(?:\([^)]*\))?\s+)*)((?:\b(?:export|default|async|pub|unsafe|const)\s+)*)\b(?:function\s*\*?|func|fn)\s+(?:\(\s*\w*\s*\*?(\w+)\s*\)\s*)?(\w+)\s*(?:<[^>]*>)?\(([^()]*(?:\([^()]*\)[^()]*)*)\)[^{;]*\{")
_ARROW = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(async\s+)?(?:\(([^()]*)\)|(\w+))\s*(?::\s*[\w<>\[\]|. ]+)?=>\s*\{")
_CALL = re.compile(r"(\bnew\s+)?((?:[\w$]+(?:\([^()]*\))?\s*(?:\.|\?\.|::)\s*)*)([\w$]+)\s*\(")
_DEF = re.compile(r"(?:\b(?:let|const|var|mut|final)\s+)+([\w$]+)\s*(?::\s*[^=;]+)?=(?![=>])\s*([^;\n]*)|\b([A-Z][\w.]*(?:<[^=;()]*>)?(?:\[\])*|int|long|double|float|boolean|bool|char|byte|short|string|String)\s+([a-z_$][\w$]*)\s*=(?!=)\s*([^;\n]*)|(?<![\w.])([a-z_$][\w$]*)\s*:?=(?![=>])\s*([^;\n]*)", re.M)
_DECLARED = re.compile(r"\b([A-Z][\w.]*)(?:<[^;(){}]*>)?(?:\[\])*\s+([a-z_$][\w$]*)\s*(?=[=;,):])")
_FIELD = re.compile(r"^\s*((?:(?:%s)\s+)*)([A-Z][\w.]*(?:<[^;(){}]*>)?(?:\[\])*|int|long|double|float|boolean|char|byte|short|string)\s+(\w+)\s*(?:=[^;]*)?;" % "|".join(MODIFIERS), re.M)
_IDENTIFIER = re.compile(r"(?<![\w.$\"'])[A-Za-z_$][\w$]*")
_LOOP = re.compile(r"\b(for|while|foreach|loop)\b[^{;]*(?:;[^{;]*){0,2}\{")
_TRY = re.compile(r"\btry\b[^{]*\{")
_CATCH = re.compile(r"\s*catch\b[^{]*\{")


class _File:
    def __init__(self, text: str, file: str, language: str):
        self.file, self.language = file, language
        # strings keep their quotes and length, so that places stay
        self.raw = text
        self.code = _SKIP.sub(lambda m: m[0] if m[0][0] in "\"'`" and len(m[0]) < 3 else (m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]) if m[0][0] in "\"'`" else re.sub(r"[^\n]", " ", m[0]), text)
        self.starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        self.rows = {k: [] for k in TABLES}
        self.ends = self._braces()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def _braces(self) -> dict[int, int]:
        stack, out = [], {}
        for m in re.finditer(r"[{}]", self.code):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                out[stack.pop()] = m.start()
        for at in stack:
            out[at] = len(self.code)
        return out

    def add(self, table, *values):
        self.rows[table].append((self.file, *values))

    def _arguments(self, open_: int) -> list[tuple[int, int]]:
        """Places of a call's arguments."""
        depth, at, out, i = 0, open_ + 1, [], open_
        while i < min(len(self.code), open_ + 20_000):
            c = self.code[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth == 0:
                    break
            elif c == "," and depth == 1:
                out.append((at, i))
                at = i + 1
            i += 1
        if self.code[at:i].strip() or out:
            out.append((at, i))
        return out

    def read(self) -> dict[str, list[tuple]]:
        code = self.code
        types = [(0, len(code), "<module>")]
        self.add("types", 0, "<module>", "module", None, None, [], [], 0, 0)
        heads = [(m.start(), m.end() - 1, m[4], m[3], m[1], m[5], m[2]) for m in _TYPE.finditer(code)]
        heads += [(m.start(), m.end() - 1, m[1], m[2], "", "", "") for m in _GO_TYPE.finditer(code)] if self.language == "go" else []
        for start, brace, name, kind, notes, rest, _ in sorted(heads):
            ext = re.search(r"\bextends\s+([\w.<>]+)", rest)
            imp = re.search(r"\bimplements\s+([^{]+)", rest)
            end = self.ends[brace]
            kind = {"struct": "class", "record": "class", "trait": "interface"}.get(kind, kind)
            self.add("types", len(types), name, kind, None, ext[1] if ext else None, [x.strip() for x in imp[1].split(",")] if imp else [], re.findall(r"@([\w.]+)", notes), self.line(start + len(notes)), self.line(end))
            types.append((brace, end, name))
        owner = lambda at: max((i for i, (a, b, _) in enumerate(types) if a <= at <= b), key=lambda i: types[i][0])
        methods = []
        found = [(m.start(), m.end() - 1, m[4], m[3], m[1], m[2], m[5], m[3]) for m in _METHOD.finditer(code) if m[4] not in KEYWORDS and (m[3] or "").strip() not in ("new", "return", "else", "throw", "await", "function", "func", "fn", "case")]
        if self.language in ("javascript", "typescript", "go", "rust"):
            found = [x for x in found if types[owner(x[0])][2] != "<module>" and self.language in ("javascript", "typescript")]
            found += [(m.start(), m.end() - 1, m[4], None, m[1], m[2], m[5], m[3]) for m in _FUNCTION.finditer(code)]
            found += [(m.start(), m.end() - 1, m[1], None, "", m[2] or "", m[3] or m[4] or "", None) for m in _ARROW.finditer(code)]
        count = [0] * len(types)
        taken = set()
        for start, brace, name, result, notes, mods, params, go_type in sorted(found):
            if brace in taken:
                continue
            taken.add(brace)
            t = owner(start)
            if self.language in ("go", "rust") and go_type:
                t = next((i for i, x in enumerate(types) if x[2] == go_type), t)
            n, count[t] = count[t], count[t] + 1
            end = self.ends[brace]
            head = code[start + len(notes) : brace]
            first = self.line(start + len(notes) + len(head) - len(head.lstrip()))
            self.add("methods", t, n, types[t][2] if types[t][2] != "<module>" else "", name, (result or "").strip() or None, re.findall(r"@([\w.]+)", notes), [x for x in (mods or "").split()], first, self.line(end))
            methods.append((brace, end, name, t, n, params, first))
        self._bodies(types, methods, owner)
        return self.rows

    def _bodies(self, types, methods, owner):
        code = self.code
        ordered = sorted(methods, key=lambda m: m[0])
        begins = [m[0] for m in ordered]

        def inside(at):
            """The innermost method around a place: the nearest that begins before it and has not ended."""
            i = bisect_right(begins, at) - 1
            while i >= 0 and ordered[i][1] < at:
                i -= 1
            return ordered[i] if i >= 0 else None

        for m in _FIELD.finditer(code):
            if inside(m.start(3)) is None and (t := owner(m.start(3))):
                self.add("fields", t, m[3], m[2], m[1].split(), [])
        declared: dict[str, str] = {}
        for m in _DECLARED.finditer(code):
            declared.setdefault(m[2], m[1])
        scopes: dict[int, dict[str, int]] = {}
        events = []
        for brace, _, _, t, n, params, first in methods:
            for i, p in enumerate([x.strip() for x in re.sub(r"<[^<>]*>", "", params).split(",") if x.strip()]):
                p = re.sub(r"@\w+(\([^)]*\))?\s*|\b(final|const|mut|ref|out|params)\s+|=.*$", "", p).strip()
                if ":" in p:
                    name, kind = p.split(":", 1)[0].strip(" ?&"), p.split(":", 1)[1].strip()
                elif self.language == "go" and " " in p:
                    name, kind = p.split(None, 1)
                elif " " in p:
                    kind, name = p.rsplit(None, 1)
                else:
                    name, kind = p.strip("."), None
                if re.fullmatch(r"[\w$]+", name):
                    self.add("params", t, n, i, name, kind, [], first)
                    if kind and kind[:1].isupper():
                        declared.setdefault(name, kind)
                    scopes.setdefault(brace, {})[name] = self._define(name, first, 0, "param", None)
        for m in _DEF.finditer(code):
            name, value, at = (m[1], m[2], m.start(1)) if m[1] else (m[4], m[5], m.start(4)) if m[4] else (m[6], m[7], m.start(6))
            if name in KEYWORDS:
                continue
            where = m.start(2) if m[1] else m.start(5) if m[4] else m.start(7)
            events.append((at, 1, name, where, where + len(value or "")))
        names = {e[0] for e in events}
        for m in _IDENTIFIER.finditer(code):
            if m[0] not in KEYWORDS and m.start() not in names:
                events.append((m.start(), 0, m[0], 0, 0))
        # a definition takes effect after its right-hand side
        pending: list[tuple[int, str, int, int, int]] = []
        for at, kind, name, a, b in sorted(events):
            if pending and min(pending)[0] <= at:
                for x in sorted(x for x in pending if x[0] <= at):
                    self._settle(x, scopes, inside)
                pending = [x for x in pending if x[0] > at]
            if kind:
                pending.append((b, name, at, a, b))
            else:
                scope = scopes.setdefault((inside(at) or (0,))[0], {})
                if name in scope:
                    self.add("dfg_uses", len(self.rows["dfg_uses"]), name, self.line(at), at - self.starts[self.line(at) - 1], scope[name])
        for x in sorted(pending):
            self._settle(x, scopes, inside)
        for m in _CALL.finditer(code):
            name, chain = m[3], re.sub(r"\s+", "", m[2]).rstrip(".:?")
            if name in KEYWORDS:
                continue
            if code[max(0, m.start(3) - 9) : m.start(3)].rstrip().endswith(("function", "func", "fn")):
                continue
            args = self._arguments(m.end() - 1)
            after = code[args[-1][1] + 1 if args else m.end() + 1 :][:200].lstrip()
            own = inside(m.start(3))
            if any(h[2] == name and self.line(m.start(3)) == h[6] for h in methods) and after.startswith(("{", "throws", ":")):
                continue
            n = len(self.rows["calls"])
            receiver = chain or None
            kind = None if receiver is None else declared.get(receiver, receiver if re.fullmatch(r"[A-Z]\w*", receiver) else None)
            line = self.line(m.start(3))
            self.add("calls", n, name, receiver, re.sub(r"<.*>", "", kind) if kind else None, None, line, m.start(3) - self.starts[line - 1], own[2] if own else None, bool(m[1]), None)
            for i, (a, b) in enumerate(args):
                text = self.raw[a:b].strip()
                literal = re.fullmatch(r"""["'`]([^"'`]*)["'`]|(-?\d[\w.]*|true|false|null)""", text)
                self.add("call_args", n, i, text, text if re.fullmatch(r"[\w$]+", text) and not literal else None, (literal[1] if literal[1] is not None else literal[2]) if literal else None, None)
        self._blocks(methods)

    def _define(self, name, line, column, kind, expression) -> int:
        n = len(self.rows["dfg_defs"])
        self.add("dfg_defs", n, name, line, column, kind, expression)
        return n

    def _settle(self, pending, scopes, inside):
        _, name, at, a, b = pending
        scope = scopes.setdefault((inside(at) or (0,))[0], {})
        used = [(x[0], scope[x[0]]) for x in _IDENTIFIER.finditer(self.code, a, b) if x[0] in scope]
        line = self.line(at)
        d = self._define(name, line, at - self.starts[line - 1], "local", self.raw[a:b].strip()[:500] or None)
        for via, source in dict.fromkeys(used):
            self.add("dfg_chains", source, d, via)
        scope[name] = d

    def _blocks(self, methods):
        """Per method an entry, a body and an exit; a header and a body for each loop; exception edges from try to catch."""

        def block(kind, a, b):
            n = len(self.rows["cfg_blocks"])
            self.add("cfg_blocks", n, kind, a, b)
            return n

        for brace, end, _, _, _, _, first in methods:
            last = self.line(end)
            entry, body, leave = block("entry", first, first), block("normal", min(first + 1, last), last), block("exit", last, last)
            self.add("cfg_edges", entry, body, "sequential")
            self.add("cfg_edges", body, leave, "sequential")
            for m in _LOOP.finditer(self.code, brace, end):
                close = self.ends.get(m.end() - 1, end)
                head, inner = block("loop", self.line(m.start()), self.line(m.start())), block("normal", self.line(m.end()), self.line(close))
                for e in ((body, head, "sequential"), (head, inner, "true"), (inner, head, "back")):
                    self.add("cfg_edges", *e)
                if not re.match(r"while\s*\(\s*true\s*\)|for\s*\(\s*;\s*;|loop\b|for\s*\{", m[0]):
                    self.add("cfg_edges", head, leave, "false")
            for m in _TRY.finditer(self.code, brace, end):
                close = self.ends.get(m.end() - 1, end)
                tried = block("normal", self.line(m.end()), self.line(close))
                self.add("cfg_edges", body, tried, "sequential")
                at = close + 1
                while c := _CATCH.match(self.code, at):
                    to = self.ends.get(c.end() - 1, end)
                    begin = c.start() + len(c[0]) - len(c[0].lstrip())
                    self.add("cfg_edges", tried, block("normal", self.line(begin), self.line(to)), "exception")
                    at = to + 1


def read(text: str, file: str, language: str) -> dict[str, list[tuple]]:
    """Rows of each fact table."""
    return _File(text, file, language).read()


def _table(name: str, columns: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [r for f, lang, t in zip(pdf["file"], pdf["language"], pdf["text"], strict=True) for r in read(t or "", f, lang)[name]]
        yield pd.DataFrame(rows, columns=columns)


def facts(scanned: DataFrame, name: str) -> DataFrame:
    """One of the fact tables of the scan's files in these languages."""
    schema = scanned.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    return scanned.where(scanned["language"].isin(*LANGUAGES)).select("file", "language", "text").mapInPandas(partial(_table, name, schema.names), schema)
