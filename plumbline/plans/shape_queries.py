"""Queries over more shapes of code: what hides a name, who a call counts for, odd interfaces; a module for each customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pyfacts import py_facts
from . import bindings as b
from .registry import query

#: One customer in six has each of these texts; %1$d is the customer.
SHAPES = (
    # 0: a comprehension's variable and a lambda's parameter hide a name in their function
    "def tool_%1$d(x):\n    return x\n\ndef comp(xs):\n    return [tool_%1$d(tool_%1$d) for tool_%1$d in xs]\n\ndef lam():\n    return lambda tool_%1$d: tool_%1$d(1)\n\ndef plain():\n    return [tool_%1$d(y) for y in range(3)]\n",
    # 1: what a class binds is hidden inside it; calls of methods count for the class
    "def helper_%1$d():\n    pass\n\nclass Outer_%1$d:\n    helper_%1$d = None\n\n    def run(self):\n        return helper_%1$d()\n\n    def other(self):\n        return sibling_%1$d(helper_%1$d)\n\ndef sibling_%1$d(f):\n    return f\n",
    # 2: the name of an except clause hides nothing
    "def go_%1$d():\n    pass\n\ntry:\n    go_%1$d()\nexcept ValueError as gone:\n    go_%1$d()\n\ndef after():\n    try:\n        go_%1$d()\n    except OSError as go_%1$d:\n        pass\n",
    # 3: interfaces: a tuple of exports, a metaclass, parameters by position or by name only, texts of several lines
    "__all__ = (\"alpha_%1$d\", \"Beta_%1$d\")\n\nclass Beta_%1$d(Base, metaclass=Meta):\n    \"\"\"Beta of all. More.\"\"\"\n\ndef alpha_%1$d(a, b=1, /, c=2, *, d, e=3, **f) -> \"Out[int]\":\n    \"\"\"Alpha\n    goes on.\"\"\"\n\nasync def later_%1$d(*args: int, g: str = \"x\"):\n    pass\n",
    # 4: no recursion, a nested definition, names that are passed on
    "def base_%1$d():\n    return base_%1$d()\n\ndef wraps_%1$d(f):\n    return f\n\n@wraps_%1$d\ndef made_%1$d():\n    def base_%1$d():\n        pass\n    return base_%1$d()\n\ndef uses(**kw):\n    return wraps_%1$d(f=made_%1$d, *[base_%1$d])\n",
    # 5: the body of a class, defaults, a definition under a condition
    "def start_%1$d():\n    return 1\n\nclass Holder_%1$d:\n    value = start_%1$d()\n\n    def method(self, x=start_%1$d()):\n        return start_%1$d()\n\nif start_%1$d():\n    def cond_%1$d(y=start_%1$d()):\n        return Holder_%1$d()\n",
)


def shapes(spark, sf_dir):
    k, text = F.col("c_custkey"), F.lit(None).cast("string")
    for i, form in enumerate(SHAPES):
        text = F.when(k % len(SHAPES) == i, F.format_string(form, k)).otherwise(text)
    return b.table(spark, sf_dir, "customer").select(F.format_string("shapes/c%d.py", k).alias("module_id"), F.encode(text, "UTF-8").alias("content"))


#: Every name of a text ends with the customer's number but for those without a #.
OF = "WITH c AS (SELECT 'shapes/c' || c_custkey || '.py' AS m, CAST(c_custkey AS VARCHAR) AS k, c_custkey % 6 AS v FROM customer)"


@query("shape_calls", f"""{OF}
SELECT m AS module_id, replace(src, '#', k) AS src, replace(dst, '#', k) AS dst, line FROM c JOIN (VALUES
  (0, 'plain', 'tool_#', 11), (1, 'Outer_#', 'sibling_#', 11), (2, '<module>', 'go_#', 5), (2, '<module>', 'go_#', 7), (2, 'after', 'go_#', 11),
  (4, 'made_#', 'base_#', 11), (4, 'uses', 'wraps_#', 14), (4, 'uses', 'made_#', 14),
  (5, 'Holder_#', 'start_#', 5), (5, 'Holder_#', 'start_#', 7), (5, 'Holder_#', 'start_#', 8), (5, '<module>', 'start_#', 10), (5, '<module>', 'start_#', 11), (5, 'cond_#', 'Holder_#', 12)) x(kind, src, dst, line) ON v = kind""")
def shape_calls(spark, sf_dir):
    return py_facts(shapes(spark, sf_dir), "call").select("module_id", "src", "dst", "line")


@query("shape_nodes", f"""{OF}
SELECT m AS module_id, seq, replace(name, '#', k) AS name, line FROM c JOIN (VALUES
  (0, 0, 'tool_#', 1), (0, 1, 'comp', 4), (0, 2, 'lam', 7), (0, 3, 'plain', 10), (1, 0, 'helper_#', 1), (1, 1, 'Outer_#', 4), (1, 2, 'sibling_#', 13),
  (2, 0, 'go_#', 1), (2, 1, 'after', 9), (2, 2, '<module>', 0), (3, 0, 'Beta_#', 3), (3, 1, 'alpha_#', 6), (3, 2, 'later_#', 10),
  (4, 0, 'base_#', 1), (4, 1, 'wraps_#', 4), (4, 2, 'made_#', 8), (4, 3, 'uses', 13), (5, 0, 'start_#', 1), (5, 1, 'Holder_#', 4), (5, 2, 'cond_#', 11), (5, 3, '<module>', 0)) x(kind, seq, name, line) ON v = kind""")
def shape_nodes(spark, sf_dir):
    return py_facts(shapes(spark, sf_dir), "func").select("module_id", "seq", "name", "line")


@query("shape_ports", f"""{OF}
SELECT m AS module_id, seq, kind, replace(name, '#', k) AS name, line, replace(signature, '#', k) AS signature, params, docstring FROM c JOIN (VALUES
  (3, 0, 'export', 'alpha_#', 1, '', '', NULL), (3, 1, 'export', 'Beta_#', 1, '', '', NULL), (3, 2, 'class', 'Beta_#', 3, 'Beta_#(Base)', '', 'Beta of all.'),
  (3, 3, 'function', 'alpha_#', 6, '(a, b=1, /, c=2, *, d, e=3, **f) -> Out[int]', 'a,b,c,d,e,f', 'Alpha'),
  (3, 4, 'function', 'later_#', 10, '(*args, g=''x'')', 'args,g', NULL),
  (0, 0, 'function', 'tool_#', 1, '(x)', 'x', NULL), (0, 1, 'function', 'comp', 4, '(xs)', 'xs', NULL), (0, 2, 'function', 'lam', 7, '()', '', NULL), (0, 3, 'function', 'plain', 10, '()', '', NULL),
  (1, 0, 'function', 'helper_#', 1, '()', '', NULL), (1, 1, 'class', 'Outer_#', 4, 'Outer_#', '', NULL), (1, 2, 'function', 'sibling_#', 13, '(f)', 'f', NULL),
  (2, 0, 'function', 'go_#', 1, '()', '', NULL), (2, 1, 'function', 'after', 9, '()', '', NULL),
  (4, 0, 'function', 'base_#', 1, '()', '', NULL), (4, 1, 'function', 'wraps_#', 4, '(f)', 'f', NULL), (4, 2, 'function', 'made_#', 8, '()', '', NULL), (4, 3, 'function', 'uses', 13, '(**kw)', 'kw', NULL),
  (5, 0, 'function', 'start_#', 1, '()', '', NULL), (5, 1, 'class', 'Holder_#', 4, 'Holder_#', '', NULL)) x(own, seq, kind, name, line, signature, params, docstring) ON v = own""")
def shape_ports(spark, sf_dir):
    rows = py_facts(shapes(spark, sf_dir), "port")
    return rows.select("module_id", "seq", "kind", "name", "line", "signature", F.array_join("params", ",").alias("params"), "docstring")
