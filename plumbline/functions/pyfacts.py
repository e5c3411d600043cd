"""py_facts: the facts that one Python source states, as flat rows. The only part of a scan that runs in Python."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.store import dealt
from .names import BUILTINS

#: One wide row for every kind of fact; `seq` is the place among the module's facts of that kind.
SCHEMA = (
    "module_id string, fact string, seq int, line int, name string, kind string, module string, level int, alias string, "
    "base string, signature string, params array<string>, docstring string, src string, dst string, message string"
)
COLUMNS = [c.strip().split()[0] for c in SCHEMA.split(",")]
TOP = "<module>"
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*FUNCTIONS, ast.ClassDef)
HIDDEN = frozenset(BUILTINS)
#: Fields that hold no node, or one that states nothing (contexts, operators); and the others of each class, as they come up.
PLAIN = {"ctx", "op", "ops", "id", "attr", "arg", "kind", "type_comment", "level", "module", "lineno"}
_holding: dict[type, tuple[str, ...]] = {ast.Constant: ()}


def parse(content: bytes | str) -> ast.Module:
    """The tree of a source; bytes are decoded by their mark or coding line. The source's own warnings stay unheard."""
    if isinstance(content, str):
        content = content.encode("utf-8", "surrogatepass")
    encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
    text = io.TextIOWrapper(io.BytesIO(content), encoding, line_buffering=True).read()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def _plain(expr: ast.expr) -> ast.expr:
    while isinstance(expr, ast.Subscript):
        expr = expr.value
    return expr


class Tree:
    """A source's tree, gone through once: `nodes` in the order of ast.walk, without contexts and operators, and the
    children of each."""

    def __init__(self, root: ast.Module):
        self.root, self.nodes, self.below = root, [root], {}
        self._bound: dict[ast.AST, set[str]] = {}
        for node in self.nodes:
            self.below[node] = own = []
            for name in _fields(type(node)):
                value = getattr(node, name, None)
                if value.__class__ is list:
                    own += [v for v in value if isinstance(v, ast.AST)]
                elif isinstance(value, ast.AST):
                    own.append(value)
            self.nodes += own

    def bound(self, scope: ast.AST) -> set[str]:
        """Parameters and stored names of a scope, and of those inside it."""
        if scope not in self._bound:
            names, stack = set(), list(self.below[scope])
            while stack:
                n = stack.pop()
                if isinstance(n, SCOPES):
                    names |= self.bound(n)
                    continue
                if isinstance(n, ast.arg):
                    names.add(n.arg)
                elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                    names.add(n.id)
                stack += self.below[n]
            self._bound[scope] = names
        return self._bound[scope]


def _fields(kind: type) -> tuple[str, ...]:
    if kind not in _holding:
        _holding[kind] = tuple(f for f in kind._fields if f not in PLAIN)
    return _holding[kind]


def _type_text(expr: ast.expr) -> str:
    expr = _plain(expr)
    return expr.value if isinstance(expr, ast.Constant) and isinstance(expr.value, str) else ast.unparse(expr)


def _parameters(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *filter(None, [args.vararg]), *args.kwonlyargs, *filter(None, [args.kwarg])]


def _signature(node: ast.AST) -> str:
    if isinstance(node, ast.ClassDef):
        return node.name + (f"({', '.join(map(_type_text, node.bases))})" if node.bases else "")
    bare = {id(a): ast.arg(a.arg) for a in _parameters(node.args)}
    old = node.args
    new = ast.arguments(
        posonlyargs=[bare[id(a)] for a in old.posonlyargs], args=[bare[id(a)] for a in old.args], vararg=old.vararg and bare[id(old.vararg)],
        kwonlyargs=[bare[id(a)] for a in old.kwonlyargs], kw_defaults=old.kw_defaults, kwarg=old.kwarg and bare[id(old.kwarg)], defaults=old.defaults,
    )
    return f"({ast.unparse(new)})" + (f" -> {_type_text(node.returns)}" if node.returns else "")


def first_sentence(text: str | None) -> str | None:
    """Up to the first '. ', or without one the first '.' at a line's end, or without one the first line."""
    text = (text or "").strip()
    for mark in (". ", ".\n", "\n"):
        head, found, _ = text.partition(mark)
        if found:
            return (head + mark[0]).strip()
    return text or None


def ports(tree: ast.Module) -> Iterator[dict]:
    """Public functions and classes of the top level, and the names in a plain __all__ list or tuple."""
    for s in tree.body:
        if isinstance(s, SCOPES) and not s.name.startswith("_"):
            is_class = isinstance(s, ast.ClassDef)
            yield {"kind": "class" if is_class else "function", "name": s.name, "line": s.lineno, "signature": _signature(s), "params": [] if is_class else [a.arg for a in _parameters(s.args)], "docstring": first_sentence(ast.get_docstring(s))}
        elif isinstance(s, ast.Assign) and isinstance(s.value, (ast.List, ast.Tuple)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets):
            for e in s.value.elts:
                if isinstance(e, ast.Constant) and isinstance(e.value, str):
                    yield {"kind": "export", "name": e.value, "line": e.lineno, "signature": "", "params": []}


def imports(nodes: list[ast.AST]) -> Iterator[dict]:
    for n in nodes:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            plain = isinstance(n, ast.Import)
            for a in n.names:
                yield {"kind": "import" if plain else "from_import", "module": None if plain else n.module, "level": 0 if plain else n.level, "name": a.name, "alias": a.asname, "line": n.lineno}


def _receiver(expr: ast.expr) -> str | None:
    while isinstance(expr, (ast.Attribute, ast.Call)):
        expr = expr.value if isinstance(expr, ast.Attribute) else expr.func
    return expr.id if isinstance(expr, ast.Name) else None


def _used(node: ast.AST) -> Iterator[tuple[str, ast.expr, int]]:
    if isinstance(node, ast.Call):
        yield "call", node.func, node.lineno
    elif isinstance(node, ast.ClassDef):
        yield from (("inheritance", b, b.lineno) for b in node.bases)
    elif isinstance(node, (ast.AnnAssign, ast.arg)) and node.annotation:
        yield "annotation", node.annotation, node.annotation.lineno
    elif isinstance(node, FUNCTIONS) and node.returns:
        yield "annotation", node.returns, node.returns.lineno
    if isinstance(node, SCOPES):
        yield from (("decorator", d, d.lineno) for d in node.decorator_list)


def references(nodes: list[ast.AST]) -> Iterator[dict]:
    """Calls, bases, decorators and annotations: the last name, and the name at the root of what stands before it."""
    for node in nodes:
        for kind, expr, line in _used(node):
            expr = _plain(expr)
            if isinstance(expr, ast.Constant) and isinstance(expr.value, str):
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        expr = ast.parse(expr.value, mode="eval").body
                except (SyntaxError, ValueError):
                    continue
            if isinstance(expr, ast.Name):
                yield {"kind": kind, "name": expr.id, "base": None, "line": line}
            elif isinstance(expr, ast.Attribute):
                yield {"kind": kind, "name": expr.attr, "base": _receiver(expr.value), "line": line}


def local_names(tree: Tree) -> set[str]:
    """Parameters and stored names of all functions together."""
    return set().union(*(tree.bound(n) for n in tree.nodes if isinstance(n, FUNCTIONS)))


def defined_names(tree: ast.Module) -> set[str]:
    """What direct statements of the module define: functions, classes, plain and annotated assignments to a name."""
    targets = [t for s in tree.body if isinstance(s, (ast.Assign, ast.AnnAssign)) for t in (s.targets if isinstance(s, ast.Assign) else [s.target])]
    return {s.name for s in tree.body if isinstance(s, SCOPES)} | {t.id for t in targets if isinstance(t, ast.Name)}


def dynamic_imports(nodes: list[ast.AST]) -> Iterator[dict]:
    for n in nodes:
        if isinstance(n, ast.Call):
            f = n.func
            root = f.value if isinstance(f, ast.Attribute) else None
            while isinstance(root, ast.Attribute):
                root = root.value
            if isinstance(f, ast.Name) and f.id == "__import__" or isinstance(f, ast.Attribute) and f.attr == "import_module" and isinstance(root, ast.Name) and root.id == "importlib":
                literal = n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str)
                yield {"line": n.lineno, "message": f"dynamic import of {n.args[0].value!r}" if literal else "dynamic import of non-literal target"}


class CallGraph:
    """Calls between the module-level functions and classes of one module.

    A call counts for the function or class of the top level around it, or for <module>. Names that an import, an
    assignment of the module, a builtin or any binding of an enclosing scope hides are no calls; nor is recursion. A
    second definition of a name is reported, and its calls count for <module>.
    """

    def __init__(self, tree: Tree, imported: list[dict]):
        self.tree = tree
        self.funcs: dict[str, int] = {}
        self.calls: set[tuple[str, str, int]] = set()
        self.repeated: list[dict] = []
        self._entered: dict[str, int] = {}
        self._define(tree.root.body)
        alias = [i["alias"] or i["name"] for i in imported if i["name"] != "*"]
        stored, stack = set(), [tree.root]
        while stack:
            n = stack.pop()
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                stored.add(n.id)
            elif not isinstance(n, (*SCOPES, ast.Lambda)):
                stack += tree.below[n]
        roots = {(i["alias"] or i["name"]).split(".")[0] for i in imported if i["kind"] == "import"}
        self._visible = {f for f in self.funcs if f not in HIDDEN} - roots - stored - set(alias)
        for s in tree.root.body:
            self._walk(s, TOP, frozenset(), False)

    def _define(self, body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, SCOPES):
                self.funcs.setdefault(s.name, s.lineno)
                continue
            for part in ("body", "orelse", "finalbody"):
                self._define(getattr(s, part, []))
            for case in getattr(s, "cases", []):
                self._define(case.body)

    def _walk(self, node: ast.AST, host: str, bound: frozenset[str], inside: bool) -> None:
        if inside and not self._visible:  # nothing more to find: no call, and no definition of the top level
            return
        if isinstance(node, SCOPES):
            if isinstance(node, ast.ClassDef):
                around = [*node.decorator_list, *node.bases, *node.keywords]
            else:
                around = [*node.decorator_list, *node.args.defaults, *filter(None, node.args.kw_defaults)]
            for n in around:
                self._walk(n, host, bound, inside)
            if not inside:
                host = self._enter(node)
            own = bound | self.tree.bound(node)
            for n in node.body:
                self._walk(n, host, own, True)
        elif isinstance(node, ast.Lambda):
            self._walk(node.body, host, bound | {a.arg for a in _parameters(node.args)}, True)
        else:
            if isinstance(node, ast.Call):
                passed = [a.value if isinstance(a, ast.Starred) else a for a in node.args]
                for n in [node.func, *passed, *(k.value for k in node.keywords)]:
                    if isinstance(n, ast.Name) and n.id in self._visible and n.id not in bound and n.id != host:
                        self.calls.add((host, n.id, node.lineno))
            for n in self.tree.below[node]:
                self._walk(n, host, bound, inside)

    def _enter(self, node) -> str:
        if node.name not in self._entered:
            self._entered[node.name] = node.lineno
            return node.name
        first = self.funcs.get(node.name, self._entered[node.name])
        self.repeated.append({"line": node.lineno, "message": f"duplicate module-level def {node.name!r}; intra graph keeps the first definition (line {first})"})
        return TOP


def facts(module_id: str, content: bytes | str, only: frozenset[str] | None = None) -> Iterator[dict]:
    """Every fact of one source, or those of some kinds. One that can't be parsed gives a parse_error alone."""
    try:
        root = parse(content)
    except (SyntaxError, ValueError, RecursionError) as e:
        message = f"syntax error: {e.msg}" if isinstance(e, SyntaxError) else f"unable to parse file: {e}"
        if only is None or "parse_error" in only:
            yield {"fact": "parse_error", "line": getattr(e, "lineno", 0) or 0, "message": message}
        return
    asked = lambda *kinds: only is None or not only.isdisjoint(kinds)
    if asked("module"):
        yield {"fact": "module"}
    if only is not None and only <= {"module", "port", "def"}:
        tree, found = None, []
    else:
        tree = Tree(root)
        found = list(imports(tree.nodes))
    graph = CallGraph(tree, found) if asked("duplicate_def", "func", "call") else None
    groups = {
        "port": lambda: ports(root), "import": lambda: found, "reference": lambda: references(tree.nodes), "dynamic_import": lambda: dynamic_imports(tree.nodes), "duplicate_def": lambda: graph.repeated,
        "local": lambda: ({"name": n} for n in sorted(local_names(tree))), "def": lambda: ({"name": n} for n in sorted(defined_names(root))),
        "func": lambda: [*({"name": n, "line": i} for n, i in graph.funcs.items()), *([{"name": TOP, "line": 0}] if any(c[0] == TOP for c in graph.calls) else [])],
        "call": lambda: ({"src": a, "dst": b, "line": i} for a, b, i in sorted(graph.calls)),
    }
    for fact, rows in groups.items():
        for seq, row in enumerate(rows() if asked(fact) else ()):
            yield {"fact": fact, "seq": seq} | row


def py_facts(files: DataFrame, *kinds: str) -> DataFrame:
    """Fact rows of a frame (module_id string, content binary or string), of all kinds or of those named. A null content
    states nothing."""
    only = frozenset(kinds) or None

    def stated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 50):
                part = frame.iloc[i : i + 50]
                rows = [{"module_id": m} | f for m, c in zip(part["module_id"], part["content"]) if c is not None for f in facts(m, bytes(c) if not isinstance(c, str) else c, only)]
                out = pd.DataFrame([[r.get(c) for c in COLUMNS] for r in rows], columns=COLUMNS, dtype=object)
                for c in ("seq", "line", "level"):
                    out[c] = out[c].astype("Int32")
                yield out

    return dealt(files.select("module_id", "content")).mapInPandas(stated, SCHEMA)
