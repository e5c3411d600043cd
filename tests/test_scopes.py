"""Intervals by brute force; calls by joins of scopes against the walk over each source's tree."""

import json
import random

from test_facts import CALLS

from plumbline.functions.pyfacts import facts
from plumbline.functions.pyscopes import py_scopes
from plumbline.operators.intervals import dyadic, holding
from plumbline.operators.scopes import meant, scope_calls
from plumbline.plans.corpus import TEXTS
from plumbline.plans.shape_queries import SHAPES
from plumbline.sources.store import settled

ODD = (
    "def f(): pass\ng = lambda x=(lambda f: f()): f()\n",
    "def f(): pass\ng = lambda f=f(): f()\nh = lambda: (lambda f: f(f))(f())\n",
    "def f(): pass\ndef g():\n    if (f := 1): pass\n    return lambda: f()\n",
    "def f(): pass\ndef g(a: (lambda f: f()) = 1): f()\n",
    "def f(): pass\nx: (lambda f: f()) = f()\n",
    "def f(): pass\n@(lambda f: f)\nclass A(f(), metaclass=f()):\n    def m(self, f=f()): f()\n    def n(self): f()\n",
    "def f(): pass\ndef g():\n    class B:\n        def h(self):\n            f = 1\n    f()\n",
    "def f(): pass\ndef g():\n    def h(): f()\n    return h\ndef g(): f()\n",
    "def f(): pass\nasync def g():\n    async for f in x: f()\nwith f() as y: f(y, *y, k=f)\n",
    "for f in x:\n    def f(): f()\n",
    "while 1:\n    def f(): pass\nelse:\n    def g(): f()\n",
    "from a import b as f, c\ndef f(): c()\ndef c(): f()\n",
    "def f(): f = 1; g()\ndef g[T: f](x: T): f(lambda: f())\n",
)


def test_calls_by_joins_are_those_of_the_walk(spark):
    sources = [s for s, _ in CALLS.values()] + [t.replace("%1$d", "1").replace("%2$d", "2") for t in (*TEXTS, *SHAPES)] + list(ODD)
    for module in (json.decoder, random):  # real code
        with open(module.__file__, encoding="utf-8") as file:
            sources.append(file.read())
    for name in ("argparse", "ast", "dataclasses", "inspect", "typing", "unittest.mock"):
        with open(__import__(name, fromlist=["x"]).__file__, encoding="utf-8") as file:
            sources.append(file.read())
    files = [(f"m{i}.py", s.encode()) for i, s in enumerate(sources)] + [("none.py", None), ("empty.py", b"")]
    got = scope_calls(settled(py_scopes(spark.createDataFrame(files, "module_id string, content binary"))))
    expected = {(m, f["src"], f["dst"], f["line"]) for m, s in files if s is not None for f in facts(m, s) if f["fact"] == "call"}
    rows = [tuple(r) for r in got.select("module_id", "src", "dst", "line").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and len(expected) > 500


def test_innermost_binding(spark):
    source = "def f(a):\n    def g(a):\n        return a(lambda a: a(f))\n    return a(g)\na(f)\n"
    rows = settled(py_scopes(spark.createDataFrame([("m.py", source)], "module_id string, content string")))
    got = {(r["line"], r["name"], r["scope_kind"], r["scope_name"], r["host"]) for r in meant(rows).collect()}
    assert got == {(3, "a", "function", "g", "f"), (3, "a", "lambda", None, "f"), (3, "f", None, None, "f"), (4, "a", "function", "f", "f"), (4, "g", None, None, "f"), (5, "a", None, None, "<module>"), (5, "f", None, None, "<module>")}
    assert meant(rows.limit(0)).count() == 0 and scope_calls(rows.limit(0)).count() == 0


def test_holding_by_brute_force(spark):
    r = random.Random(3)
    points = [(r.choice("abc"), i, r.choice([r.randint(0, 40), r.randint(0, 5000)])) for i in range(400)] + [("d", 400, 5), (None, 401, 5), ("a", 402, None)]
    spans = []
    for i in range(300):
        a = r.choice([r.randint(0, 40), r.randint(0, 5000)])
        spans.append((r.choice("abc"), i, a, a + r.choice([0, 1, 2, 7, 8, 63, 64, 1000, -1])))
    spans += [("a", 300, 0, 1 << 20), ("a", 301, 3, None), ("a", 302, None, 3), ("e", 303, 0, 9), (None, 304, 0, 9), ("b", 299, 0, 0)]
    p, s = spark.createDataFrame(points, "k string, p int, at int"), spark.createDataFrame(spans, "k string, s int, a int, b int")
    got = sorted((x["p"], x["s"]) for x in holding(p, s, ["k"], "at", "a", "b").collect())
    expected = sorted((q, t) for k, q, at in points for j, t, a, b in spans if None not in (k, at, a, b) and k == j and a <= at <= b)
    assert got == expected
    assert holding(p, s.limit(0), ["k"], "at", "a", "b").count() == 0


def test_blocks_are_few_and_cover_once(spark):
    from pyspark.sql import functions as F

    ends = [(a, b) for a in range(0, 40) for b in range(a, 40)] + [(0, (1 << 30) - 1), (1, (1 << 30) - 2), (123_456_789, 2_000_000_000)]
    df = spark.createDataFrame(ends, "a int, b int").withColumn("d", dyadic(F.col("a"), F.col("b")))
    for a, b, d in df.collect():
        parts = sorted((x["block"] << x["level"], (x["block"] + 1 << x["level"]) - 1) for x in d)
        assert parts[0][0] == a and parts[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:]))
        assert len(d) <= 2 * (b - a + 1).bit_length()


def test_nothing_is_sent_through_the_driver(spark):
    rows = settled(py_scopes(spark.createDataFrame([(f"m{i}.py", "def f(a):\n    return g(a)\ndef g(b):\n    return b\n") for i in range(50)], "module_id string, content string")))
    found = scope_calls(rows)
    assert {tuple(r)[1:] for r in found.collect()} == {("f", "g", 2)} and found.count() == 50
    assert "Broadcast" not in found._jdf.queryExecution().toString()
