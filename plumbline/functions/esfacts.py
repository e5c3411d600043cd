"""es_facts: the facts that one ECMAScript or TypeScript module states, as rows of the schema that pyfacts has.

Found by patterns over text whose comments and strings are blanked, so a module is never refused. Names of modules get a mark of
their own (es: for files of the scan, npm: for packages), so that languages never meet by accident. There are no calls inside a
module (func, call) and no star bindings: `export * from` is an edge.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.store import dealt
from .pyfacts import COLUMNS, SCHEMA

SUFFIXES = (".js", ".mjs", ".jsx", ".ts", ".mts", ".tsx")
_suffix = re.compile(r"\.(?:m?js|jsx|m?ts|tsx)$")
#: Words that stand before a parenthesis without being called, and names that every host knows.
KEYWORDS = frozenset("if for while switch catch function return typeof await new super import with in of void delete do else yield async constructor get set".split())
GLOBALS = tuple("Array ArrayBuffer BigInt Boolean Date Error Function Infinity Intl JSON Map Math NaN Number Object Promise Proxy RangeError Reflect RegExp Set String Symbol SyntaxError TypeError URL URLSearchParams WeakMap WeakSet clearInterval clearTimeout console decodeURIComponent document encodeURIComponent exports fetch globalThis isFinite isNaN module parseFloat parseInt process queueMicrotask require setInterval setTimeout structuredClone this window".split())
_globals = frozenset(GLOBALS)

_blank = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/", re.S
)
_name = r"[A-Za-z_$][\w$]*"
_from = re.compile(rf"\b(import|export)\s+(?:type\s+)?((?:[\w$*{{}},\s])+?)\s*from\s*(?P<q>['\"`])[^'\"`]*(?P=q)")
_bare = re.compile(r"\bimport\s*(?P<q>['\"])[^'\"]*(?P=q)")
_required = re.compile(rf"\b(?:const|let|var)\s+({_name}|\{{[^}}]*\}})\s*=\s*require\s*\(\s*(?P<q>['\"])[^'\"]*(?P=q)\s*\)")
_dynamic = re.compile(r"\bimport\s*\(\s*(?:(?P<q>['\"`])[^'\"`]*(?P=q))?")
_exported = re.compile(rf"\bexport\s+(default\s+)?(?:declare\s+)?(?:(?:async\s+)?(function)\b\s*\*?\s*({_name})?|(?:abstract\s+)?(class)\b\s*((?!extends\b){_name})?|(?:const\s+)?(const|let|var|enum|interface|type)\b\s+({_name})|(\{{[^}}]*\}})(?!\s*from)|(?=\S))")
_declared = re.compile(rf"\b(?:function\b\s*\*?|class|enum|interface|type|const|let|var)\s+((?!extends\b){_name}|\{{[^}}]*\}}|\[[^\]]*\])")
_extends = re.compile(rf"\bextends\s+({_name}(?:\s*\.\s*{_name})*)")
_called = re.compile(rf"(?<![\w$.])({_name}(?:\s*\??\.\s*{_name})*)\s*(?:<[\w$\s,.\[\]|]*>)?\(")
_arrow = re.compile(rf"(?<![\w$.])({_name})\s*=>")
_method = re.compile(r"\s*(?::\s*[\w$<>\[\]., |]+)?\{")
_heads = re.compile(rf"\bfunction\b\s*\*?\s*(?:{_name})?\s*$|\bcatch\s*$")


def _blanked(text: str) -> str:
    """Text of the same length without what comments and strings say; quotes and line ends stay."""

    def plain(m: re.Match) -> str:
        s = m.group()
        hollow = re.sub(r"[^\n]", " ", s)
        return s[0] + hollow[1:-1] + s[-1] if s[0] in "'\"`" and len(s) > 1 else hollow

    return _blank.sub(plain, text)


def _target(module_id: str, spec: str) -> str:
    """The dotted name that a specifier means: that of a file seen from this one, or of a package."""
    if not re.match(r"\.{1,2}(?:/|$)", spec):
        return "npm:" + spec
    at = module_id.split("/")[:-1]
    for part in spec.split("/"):
        at = at[:-1] if part == ".." else at if part in ("", ".") else [*at, part]
    return dotted("/".join(at))


def dotted(path: str) -> str:
    parts = _suffix.sub("", path).split("/")
    return "es:" + ".".join(parts[:-1] if parts[-1] == "index" else parts)


def _listed(braces: str) -> Iterator[tuple[str, str]]:
    """(name, the name it gets) of {a, b as c, d: e, type F, g = 1}."""
    for part in braces.strip("{}[] \n\t\r").split(","):
        words = re.findall(_name, part.split("=")[0])
        words = words[1:] if len(words) > 1 and words[0] == "type" and words[1] != "as" else words
        if words:
            yield words[0], words[-1]


class _Module:
    def __init__(self, module_id: str, text: str):
        self.id, self.text, self.code = module_id, text, _blanked(text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.pair, self.depth, stack = {}, [], []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            if m.group() in "([{":
                stack.append(m.start())
                self.depth.append((m.start(), len(stack)))
            elif stack:
                self.pair[stack.pop()] = m.start()
                self.depth.append((m.start(), len(stack)))
        self.edges = [d for d, _ in self.depth]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def top(self, at: int) -> bool:
        k = bisect_right(self.edges, at) - 1
        return k < 0 or self.depth[k][1] == 0

    def spec(self, m: re.Match) -> str:
        a = m.start("q") + 1
        return self.text[a : self.code.index(m.group("q"), a)]

    def imports(self) -> Iterator[dict]:
        found = []
        for m in _from.finditer(self.code):
            target, clause, line = _target(self.id, self.spec(m)), m.group(2), self.line(m.start())
            braces = re.search(r"\{[^}]*\}", clause)
            names = [(a, b) for a, b in _listed(braces.group())] if braces else []
            rest = clause.replace(braces.group(), "") if braces else clause
            star = re.search(rf"\*(?:\s+as\s+({_name}))?", rest)
            default = re.match(rf"\s*({_name})", rest) if not star or rest.strip()[0] != "*" else None
            names += [("default", default.group(1))] if default else []
            whole = star or not names
            found += [(m.start(), k, {"kind": "from_import", "module": target, "level": 0, "name": a, "alias": b if b != a else None, "line": line}) for k, (a, b) in enumerate(names)]
            found += [(m.start(), len(names), {"kind": "import", "level": 0, "name": target, "alias": star and star.group(1), "line": line})] if whole else []
        for m in _required.finditer(self.code):
            target, line = _target(self.id, self.spec(m)), self.line(m.start())
            if m.group(1)[0] == "{":
                found += [(m.start(), k, {"kind": "from_import", "module": target, "level": 0, "name": a, "alias": b if b != a else None, "line": line}) for k, (a, b) in enumerate(_listed(m.group(1)))]
            else:
                found.append((m.start(), 0, {"kind": "import", "level": 0, "name": target, "alias": m.group(1), "line": line}))
        found += [(m.start(), 0, {"kind": "import", "level": 0, "name": _target(self.id, self.spec(m)), "line": self.line(m.start())}) for m in _bare.finditer(self.code)]
        yield from (row for _, _, row in sorted(found, key=lambda f: f[:2]))

    def _params(self, at: int) -> tuple[str, list[str]]:
        """The parameter list that opens at or after a place, as written on one line, and its names."""
        start = self.code.find("(", at)
        inner = self.code[start + 1 : self.pair.get(start, start + 1)] if start >= 0 else ""
        parts, held, deep = [], "", 0
        for c in inner + ",":
            deep += (c in "([{<") - (c in ")]}>")
            if c == "," and deep <= 0:
                parts, held = [*parts, held], ""
            else:
                held += c
        names = [re.match(_name, p.strip().lstrip(".").strip()) for p in parts]
        return f"({', '.join(n.group() for n in names if n)})", [n.group() for n in names if n]

    def ports(self) -> Iterator[dict]:
        for m in _exported.finditer(self.code):
            default, function, f_name, klass, c_name, other, o_name, braces = m.groups()
            line = self.line(m.start())
            if function:
                signature, params = self._params(m.end())
                yield {"kind": "function", "name": "default" if default else f_name, "line": line, "signature": signature, "params": params}
            elif klass:
                base = _extends.match(self.code, m.end() + len(self.code[m.end() :]) - len(self.code[m.end() :].lstrip()))
                yield {"kind": "class", "name": "default" if default else c_name, "line": line, "signature": (c_name or "default") + (f"({base.group(1)})" if base else ""), "params": []}
            elif other:
                yield {"kind": "export", "name": o_name, "line": line, "signature": "", "params": []}
            elif braces:
                yield from ({"kind": "export", "name": b, "line": line, "signature": "", "params": []} for _, b in _listed(braces))
            elif default:
                yield {"kind": "export", "name": "default", "line": line, "signature": "", "params": []}
        for m in _from.finditer(self.code):
            if m.group(1) == "export" and "{" in m.group(2):
                yield from ({"kind": "export", "name": b, "line": self.line(m.start()), "signature": "", "params": []} for _, b in _listed(m.group(2)))

    def names(self) -> tuple[set[str], set[str]]:
        """(names of the module's own declarations, names bound anywhere below)."""
        own, below = set(), set()
        for m in _declared.finditer(self.code):
            names = [b for _, b in _listed(m.group(1))] if m.group(1)[0] in "{[" else [m.group(1)]
            if not re.match(r"\s*=\s*require\b", self.code[m.end() : m.end() + 40]):
                (own if self.top(m.start()) else below).update(names)
        for start, stop in self.pair.items():
            if self.code[start] == "(" and (_heads.search(self.code, max(0, start - 200), start) or re.match(r"\s*(?::[^=;{}()]*)?=>", self.code[stop + 1 : stop + 200]) or self._defines(start)):
                below.update(self._params(start)[1])
        below.update(m.group(1) for m in _arrow.finditer(self.code))
        return own, below

    def _defines(self, start: int) -> bool:
        """Whether the parenthesis opens the parameters of a method."""
        before = re.search(rf"({_name})\s*$", self.code[max(0, start - 100) : start])
        return bool(before and before.group(1) not in KEYWORDS - {"constructor", "get", "set"} and _method.match(self.code, self.pair.get(start, start) + 1))

    def references(self) -> Iterator[dict]:
        found = [(m.start(1), "inheritance", m.group(1)) for m in _extends.finditer(self.code)]
        for m in _called.finditer(self.code):
            root = re.match(_name, m.group(1)).group()
            heads = _heads.search(self.code, max(0, m.start() - 40), m.end() - 1)
            if root not in KEYWORDS and not heads and not ("." not in m.group(1) and self._defines(m.end() - 1)):
                found.append((m.start(1), "call", m.group(1)))
        for at, kind, chain in sorted(found):
            parts = re.findall(_name, chain)
            yield {"kind": kind, "name": parts[-1], "base": parts[0] if len(parts) > 1 else None, "line": self.line(at)}

    def dynamic(self) -> Iterator[dict]:
        for m in _dynamic.finditer(self.code):
            plain = m.group("q") and m.group("q") != "`"
            yield {"line": self.line(m.start()), "message": f"dynamic import of {self.spec(m)!r}" if plain else "dynamic import of non-literal target"}


def facts(module_id: str, content: bytes | str, only: frozenset[str] | None = None) -> Iterator[dict]:
    """Every fact of one module, or those of some kinds. Bytes that are not UTF-8 give a parse_error alone. Of GLOBALS only those
    that a reference asks for are local names."""
    asked = lambda *kinds: only is None or not only.isdisjoint(kinds)
    try:
        text = content if isinstance(content, str) else bytes(content).decode("utf-8-sig")
    except UnicodeDecodeError as e:
        if asked("parse_error"):
            yield {"fact": "parse_error", "line": 0, "message": f"unable to parse file: {e}"}
        return
    m = _Module(module_id, text)
    own, below = m.names() if asked("local", "def") else (set(), set())
    references = list(m.references()) if asked("reference", "local") else []
    below |= {r["base"] or r["name"] for r in references} & _globals
    if asked("module"):
        yield {"fact": "module"}
    groups = {"port": m.ports(), "import": m.imports(), "reference": references, "dynamic_import": m.dynamic(), "local": ({"name": n} for n in sorted(below)), "def": ({"name": n} for n in sorted(own))}
    for fact, rows in groups.items():
        for seq, row in enumerate(rows if asked(fact) else ()):
            yield {"fact": fact, "seq": seq} | row


def es_facts(files: DataFrame, *kinds: str) -> DataFrame:
    """Fact rows of a frame (module_id string, content binary or string), of all kinds or of those named. A null content
    states nothing."""
    only = frozenset(kinds) or None

    def stated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 50):
                part = frame.iloc[i : i + 50]
                rows = [{"module_id": m} | f for m, c in zip(part["module_id"], part["content"]) if c is not None for f in facts(m, c, only)]
                out = pd.DataFrame([[r.get(c) for c in COLUMNS] for r in rows], columns=COLUMNS, dtype=object)
                for c in ("seq", "line", "level"):
                    out[c] = out[c].astype("Int32")
                yield out

    return dealt(files.select("module_id", "content")).mapInPandas(stated, SCHEMA)
