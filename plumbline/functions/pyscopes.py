"""py_scopes: the scopes of one Python source, what is bound and what is called in it, as rows with places. Which scope a name
belongs to is not decided here but by joins (operators/scopes.py)."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.store import dealt
from .pyfacts import FUNCTIONS, SCOPES, _parameters, imports, parse

#: A place is a node's number: a node comes before what it holds, a scope's body after all else of it.
#: scope: kind, name, line; pos to stop is all of it, pos to bound holds its bindings, body to stop is what it hides names from.
#: bind: a parameter (kind arg) or stored name (kind name) at pos. call: a name called or handed to a call at pos.
#: def: a function or class that direct statements of the module define. import: a name that an import brings.
SCHEMA = "module_id string, fact string, kind string, name string, line int, pos int, bound int, body int, stop int"
COLUMNS = [c.strip().split()[0] for c in SCHEMA.split(",")]


class _Places:
    def __init__(self, tree: ast.Module):
        self.rows: list[dict] = []
        self.at = 0
        self._all(tree.body, True)

    def _all(self, nodes, counts: bool) -> None:
        for n in nodes:
            self._node(n, counts)

    def _node(self, n: ast.AST, counts: bool) -> None:
        """`counts` is off where calls are no calls: in parameters, annotations and the defaults of lambdas."""
        self.at += 1
        pos = self.at
        if isinstance(n, ast.arg) or isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
            is_arg = isinstance(n, ast.arg)
            self.rows.append({"fact": "bind", "kind": "arg" if is_arg else "name", "name": n.arg if is_arg else n.id, "line": n.lineno, "pos": pos})
        if isinstance(n, (*SCOPES, ast.Lambda)):
            self._scope(n, pos, counts)
            return
        if isinstance(n, ast.Call) and counts:
            held = [n.func, *(a.value if isinstance(a, ast.Starred) else a for a in n.args), *(k.value for k in n.keywords)]
            names = dict.fromkeys(h.id for h in held if isinstance(h, ast.Name))
            self.rows += [{"fact": "call", "name": name, "line": n.lineno, "pos": pos} for name in names]
        self._all(ast.iter_child_nodes(n), counts)

    def _scope(self, n: ast.AST, pos: int, counts: bool) -> None:
        if isinstance(n, ast.Lambda):
            first, body, kind = [], [n.body], "lambda"
        else:
            kind, body = ("class", n.body) if isinstance(n, ast.ClassDef) else ("function", n.body)
            first = [*n.decorator_list, *n.bases, *n.keywords] if kind == "class" else [*n.decorator_list, *n.args.defaults, *filter(None, n.args.kw_defaults)]
        args = [] if kind == "class" else _parameters(n.args)
        self._all(args, False)
        own = self.at
        self._all(first, counts)
        if kind == "lambda":
            self._all([*n.args.defaults, *filter(None, n.args.kw_defaults)], False)
        else:
            self._all([*filter(None, [getattr(n, "returns", None)]), *getattr(n, "type_params", [])], False)
        start = self.at + 1
        self._all(body, counts if kind == "lambda" else True)
        self.rows.append({"fact": "scope", "kind": kind, "name": getattr(n, "name", None), "line": n.lineno, "pos": pos, "bound": own if kind == "lambda" else self.at, "body": start, "stop": self.at})


def _defined(body: list[ast.stmt]) -> Iterator[dict]:
    """Functions and classes of the module's own statements and of the branches of these, but for except clauses."""
    todo = list(body)
    while todo:
        s = todo.pop()
        if isinstance(s, SCOPES):
            yield {"fact": "def", "kind": "function" if isinstance(s, FUNCTIONS) else "class", "name": s.name, "line": s.lineno}
        else:
            for held in (s, *getattr(s, "cases", [])):
                todo += [b for part in ("body", "orelse", "finalbody") for b in getattr(held, part, [])]


def scope_facts(content: bytes | str) -> list[dict]:
    """All rows of one source; none if it can't be parsed."""
    try:
        tree = parse(content)
        rows = _Places(tree).rows
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = list(imports(list(ast.walk(tree))))
    brought = {i["alias"] or i["name"] for i in found if i["name"] != "*"}
    brought |= {(i["alias"] or i["name"]).split(".")[0] for i in found if i["kind"] == "import"}
    return [*rows, *_defined(tree.body), *({"fact": "import", "name": n} for n in sorted(brought))]


def py_scopes(files: DataFrame) -> DataFrame:
    """Scope rows of a frame (module_id string, content binary or string). A null content states nothing."""

    def stated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 50):
                part = frame.iloc[i : i + 50]
                rows = [{"module_id": m} | f for m, c in zip(part["module_id"], part["content"]) if c is not None for f in scope_facts(bytes(c) if not isinstance(c, str) else c)]
                out = pd.DataFrame([[r.get(c) for c in COLUMNS] for r in rows], columns=COLUMNS, dtype=object)
                for c in ("line", "pos", "bound", "body", "stop"):
                    out[c] = out[c].astype("Int32")
                yield out

    return dealt(files.select("module_id", "content")).mapInPandas(stated, SCHEMA)
