"""Facts of single sources against expectations written by hand."""

import pytest

from plumbline.functions.pyfacts import facts, first_sentence


def of(source, fact, *keys):
    return [tuple(r.get(k) for k in keys) if len(keys) > 1 else r.get(keys[0]) for r in facts("m.py", source) if r["fact"] == fact]


def test_ports():
    source = (
        'def run(a, /, b: int = 2, *rest, key="k", **more) -> List[int]:\n    """Runs it. Twice."""\n\n'
        "async def wait(*, n=1): pass\ndef _hidden(): pass\n"
        "class Shop(Base, Generic['T'], metaclass=Meta):\n    '''Sells\n    things.'''\n    def method(self): pass\n"
        "__all__ = ['run', 'late', *x]\n__all__ += ['no']\n__all__: list = ['no']\nif True:\n    def inner(): pass\n"
    )
    got = of(source, "port", "kind", "name", "line", "signature", "params", "docstring")
    assert got == [
        ("function", "run", 1, "(a, /, b=2, *rest, key='k', **more) -> List", ["a", "b", "rest", "key", "more"], "Runs it."),
        ("function", "wait", 4, "(*, n=1)", ["n"], None),
        ("class", "Shop", 6, "Shop(Base, Generic)", [], "Sells"),
        ("export", "run", 10, "", [], None), ("export", "late", 10, "", [], None),
    ]


@pytest.mark.parametrize("text, first", [(None, None), ("", None), ("One", "One"), ("One. Two\nThree.\nx", "One."), ("One\nTwo. Three", "One\nTwo."), ("One.\nTwo", "One."), ("One\nTwo", "One"), ("  a. b", "a.")])
def test_first_sentence(text, first):
    assert first_sentence(text) == first


def test_imports_at_any_depth():
    source = "import a.b as c, d\ndef f():\n    from . import x\n    from ..p.q import y as z, w\nfrom k import *\n"
    got = of(source, "import", "kind", "module", "level", "name", "alias", "line")
    assert got == [
        ("import", None, 0, "a.b", "c", 1), ("import", None, 0, "d", None, 1), ("from_import", "k", 0, "*", None, 5),
        ("from_import", None, 1, "x", None, 3), ("from_import", "p.q", 2, "y", "z", 4), ("from_import", "p.q", 2, "w", None, 4),
    ]


def test_references():
    source = "@deco\n@lib.wrap(1)\nclass A(pkg.Base[int], 'Quoted'):\n    x: Optional[Y] = f(1)\ndef g(a: 'mod.T', b: 'not valid!') -> R | None:\n    a.b().c[0]()\n    super().m()\n    (lambda: 0)()\n"
    got = sorted(of(source, "reference", "kind", "name", "base", "line"), key=str)
    assert got == sorted([
        ("decorator", "deco", None, 1), ("call", "wrap", "lib", 2), ("inheritance", "Base", "pkg", 3), ("inheritance", "Quoted", None, 3),
        ("annotation", "Optional", None, 4), ("call", "f", None, 4), ("annotation", "T", "mod", 5),
        ("call", "c", "a", 6), ("call", "b", "a", 6), ("call", "m", "super", 7), ("call", "super", None, 7),
    ], key=str)


def test_name_sets():
    source = "a = b.c = 1\nx: int = 2\n(p, q) = 1, 2\nfor i in y: pass\ndef f(u, *v):\n    w = 1\n    def g(h): k = 2\n    [n for n in u]\nclass C:\n    s = 1\n"
    assert of(source, "def", "name") == ["C", "a", "f", "x"]
    assert of(source, "local", "name") == ["h", "k", "n", "u", "v", "w"]


def test_dynamic_imports():
    source = "__import__('x')\nimportlib.import_module(name)\nimportlib.util.import_module(\"it's\")\nother.import_module('y')\n"
    assert of(source, "dynamic_import", "line", "message") == [(1, "dynamic import of 'x'"), (2, "dynamic import of non-literal target"), (3, 'dynamic import of "it\'s"')]


def test_parse_errors_and_encodings():
    assert of("def f(:\n", "parse_error", "line", "message") == [(1, "syntax error: invalid syntax")]
    assert of(b"# coding: latin-1\ns = '\xe9'\n", "def", "name") == ["s"] and of(b"\xef\xbb\xbfx = 1\n", "def", "name") == ["x"]
    assert of(b"s = '\xe9'\n", "parse_error", "line")[0] == 0 and of(b"# coding: nonsense\n", "parse_error", "line") == [0]
    assert of("a\x00b = 1", "parse_error", "message") and of("", "module", "fact") == ["module"]


CALLS = {
    "direct, later, recursive": ("def a(): b(); a()\ndef b(): pass\n", {("a", "b", 1)}),
    "class and its method": ("class A:\n    def m(self): f(); A()\ndef f(): pass\n", {("A", "f", 2)}),
    "top level": ("def f(): pass\nf(); f()\n", {("<module>", "f", 2)}),
    "callbacks": ("def f(): pass\ndef g(): pass\ndef h(): run(f, key=g); run(*f)\n", {("h", "f", 3), ("h", "g", 3)}),
    "attributes are none": ("def f(): pass\ndef g(x): x.f()\n", set()),
    "locals and parameters hide": ("def f(): pass\ndef g(f): f()\ndef h():\n    f = 1\n    f()\n", set()),
    "imports hide": ("from x import f\ndef f(): pass\ndef g(): f()\n", set()),
    "dotted imports hide the root": ("import f.x\ndef f(): pass\ndef g(): f()\n", set()),
    "builtins hide": ("def print(): pass\ndef g(): print()\n", set()),
    "assignments of the module hide": ("def f(): pass\nf = f\ndef g(): f()\n", set()),
    "comprehensions hide": ("def f(): pass\ndef g(): return [f() for f in x]\n", set()),
    "nested functions and lambdas": ("def f(): pass\ndef g():\n    def h(): f()\n    m = lambda: f()\nk = lambda f: f()\nm = lambda x: f()\n", {("g", "f", 3), ("g", "f", 4), ("<module>", "f", 6)}),
    "decorators and defaults": ("def f(x=None): pass\n@f\ndef g(): pass\n@f()\ndef h(a=f()): pass\n", {("<module>", "f", 4), ("<module>", "f", 5)}),
    "conditional": ("if x:\n    def f(): pass\nelse:\n    def f2(): f()\n", {("f2", "f", 4)}),
    "match": ("match x:\n    case 1:\n        def f(): pass\ndef g(): f()\n", {("g", "f", 4)}),
    "second body of a repeated def": ("def f(): pass\ndef g(): pass\ndef g(): f()\n", {("<module>", "f", 3)}),
    "under except: a host, no node": ("def f(): pass\ntry:\n    pass\nexcept E:\n    def g(): f()\ndef h(): g()\n", {("g", "f", 5)}),
}


@pytest.mark.parametrize("case", CALLS)
def test_calls(case):
    source, expected = CALLS[case]
    assert set(of(source, "call", "src", "dst", "line")) == expected


def test_functions_and_repeats():
    source = "def b(): a()\ndef a(): pass\ndef b(): pass\na()\n"
    assert of(source, "func", "name", "line") == [("b", 1), ("a", 2), ("<module>", 0)]
    assert of(source, "duplicate_def", "line", "message") == [(3, "duplicate module-level def 'b'; intra graph keeps the first definition (line 1)")]
    twice = "try: pass\nexcept A:\n    def f(): pass\nexcept B:\n    def f(): pass\n"
    assert of(twice, "duplicate_def", "line") == [5] and of(twice, "func", "name") == []


def test_a_tree_is_gone_through_once():
    """A function inside many others is not walked again for each of them."""
    import ast

    from plumbline.functions.pyfacts import Tree

    depth = 60
    text = "".join(f"{' ' * i}def f{i}(a{i}):\n" for i in range(depth)) + " " * depth + "x = 1\n"
    tree = Tree(ast.parse(text))
    seen = []

    class Below(dict):
        def __getitem__(self, node):
            seen.append(node)
            return dict.__getitem__(self, node)

    tree.below = Below(tree.below)
    assert tree.bound(tree.root) == {"x"} | {f"a{i}" for i in range(depth)}
    assert len(seen) <= len(tree.nodes)
    assert set(tree.nodes) == {n for n in ast.walk(tree.root) if not isinstance(n, ast.expr_context)}


def test_facts_of_some_kinds_are_those_of_all():
    text = "import os\n__all__ = ['a']\ndef a(x: int):\n    return b(x)\ndef b(y):\n    z = __import__('q')\ndef b():\n    pass\na(1)\n"
    every = list(facts("m", text))
    for kind in {f["fact"] for f in every}:
        assert list(facts("m", text, frozenset([kind]))) == [f for f in every if f["fact"] == kind]
    assert list(facts("m", "def (", frozenset(["port"]))) == [] and len(list(facts("m", "def (", frozenset(["parse_error"])))) == 1
