"""Queries over a corpus of two languages that grows with the tables; and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frontends import FRONT_ENDS, all_facts, readable
from ..sources.store import settled
from . import bindings as b
from .registry import query
from .scan import RESOLVING, STATED, TOLD, scan_facts, stated_table

#: One customer in four has each of these modules; %1$d is the customer, %2$d the nation.
WEB = (
    # 0: names, a default, a namespace, a package; strings and comments say nothing
    ("ts", "import { make, Base as Own_%1$d } from \"../base\";\nimport * as all from '../base.js'\nimport React, { useState } from 'react';\n// import { no } from '../gone'\nexport class Page_%1$d extends Own_%1$d {\n  show(make_%1$d: number): void {\n    all.make(useState(\"import x from 'y'\"));\n  }\n}\nexport const value_%1$d = make(1, () => React.render());\n"),
    # 1: a module that is missing, a package's path, a name of the module and one of a function
    ("js", "const { make, gone_%1$d: lost } = require('../base');\nimport '@shop/style/n%2$d.css';\nfunction helper(a, b = 2) {\n  return lost(a(b));\n}\nexport default function (x) {\n  return helper(make(x), missing_%1$d());\n}\nimport('./late_%1$d');\nimport(x);\n"),
    # 2: Python beside, of the same names
    ("py", "from ..base import make\nimport react\nmake(react.x())\n"),
    # 3: nothing reads it
    ("vue", "<template></template>\n"),
)


def mixed(spark, sf_dir):
    """(module_id, content): for each nation web/n<k>/base/index.ts and base.py, for each customer a module in pages."""
    n, k, m = F.col("n_nationkey"), F.col("c_custkey"), F.col("c_nationkey")
    es = F.format_string("/** Base. */\nexport abstract class Base {}\nexport async function make(a: Map<string, number>, ...rest) {\n  return new Base_%1$d();\n}\nclass Base_%1$d extends Base {}\nexport { Base_%1$d as inner };\n", n)
    py = F.lit("def make(x):\n    return x\n")
    two = F.array(F.struct(F.format_string("web/n%d/base/index.ts", n).alias("module_id"), es.alias("content")), F.struct(F.format_string("web/n%d/base.py", n).alias("module_id"), py.alias("content")))
    nation = b.table(spark, sf_dir, "nation").select(F.explode(two).alias("f")).select("f.*")
    path = text = F.lit(None).cast("string")
    for i, (suffix, form) in enumerate(WEB):
        mine = k % len(WEB) == i
        path, text = F.when(mine, F.format_string(f"web/n%2$d/pages/c%1$d.{suffix}", k, m)).otherwise(path), F.when(mine, F.format_string(form, k, m)).otherwise(text)
    return nation.unionByName(b.table(spark, sf_dir, "customer").select(path.alias("module_id"), text.alias("content")))


def _tables(spark, sf_dir, name):
    """A table of the mixed corpus's graph, settled; one that needs no resolution comes of the facts of its kind."""
    files = mixed(spark, sf_dir)
    if name in STATED:
        return settled(stated_table(all_facts(files, FRONT_ENDS, STATED[name]), name))
    found = scan_facts(all_facts(files, FRONT_ENDS, *RESOLVING, *(TOLD if name == "diagnostics" else ())), readable(files, FRONT_ENDS).select("module_id"))
    try:
        return settled(found.tables()[name])
    finally:
        found.release()


OF = """c AS (SELECT c_custkey % 4 AS v, CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS n, 'web/n' || c_nationkey || '/pages/c' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.py' ELSE '.vue' END AS m FROM customer),
g AS (SELECT CAST(n_nationkey AS VARCHAR) AS n, 'web/n' || n_nationkey AS w FROM nation)"""
IN = "replace(replace(replace({0}, '%k', k), '%n', n), '%b', 'web/n' || n || '/base')"


@query("mixed_edges", f"""WITH {OF}
SELECT m AS source, {IN.format('target')} AS target, {IN.format('port')} AS "targetPort", kind, sites FROM c JOIN (VALUES
  (0, '%b/index.ts', 'make', 'from_import', '1'), (0, '%b/index.ts', 'Base', 'from_import', '1'), (0, '%b/index.ts', NULL, 'import', '2'), (0, 'npm:react', 'default', 'from_import', '3'), (0, 'npm:react', 'useState', 'from_import', '3'),
  (0, '%b/index.ts', 'Base', 'inheritance', '5'), (0, '%b/index.ts', 'make', 'call', '7,10'), (0, 'npm:react', 'useState', 'call', '7'), (0, 'npm:react', 'render', 'call', '10'),
  (1, '%b/index.ts', 'make', 'from_import', '1'), (1, '%b/index.ts', NULL, 'from_import', '1'), (1, 'npm:@shop/style/n%n.css', NULL, 'import', '2'), (1, '%b/index.ts', NULL, 'call', '4'), (1, '%b/index.ts', 'make', 'call', '7'),
  (2, '%b.py', 'make', 'from_import', '1'), (2, 'react', NULL, 'import', '2'), (2, '%b.py', 'make', 'call', '3'), (2, 'react', 'x', 'call', '3')
) x(own, target, port, kind, sites) ON v = own""")
def mixed_edges(spark, sf_dir):
    rows = _tables(spark, sf_dir, "edges")
    return rows.select("source", "target", "targetPort", "kind", F.array_join(F.transform("sites", lambda x: x.cast("string")), ",").alias("sites"))


@query("mixed_ports", f"""WITH {OF}
SELECT w || '/base/index.ts' AS "moduleId", kind, {IN.format('name')} AS name, line, signature, params FROM (SELECT g.*, '' AS k FROM g), (VALUES
  ('class', 'Base', 2, 'Base', ''), ('function', 'make', 3, '(a, rest)', 'a,rest'), ('export', 'inner', 7, '', '')) x(kind, name, line, signature, params)
UNION ALL SELECT w || '/base.py', 'function', 'make', 1, '(x)', 'x' FROM g
UNION ALL SELECT m, kind, {IN.format('name')}, line, {IN.format('signature')}, params FROM c JOIN (VALUES
  (0, 'class', 'Page_%k', 5, 'Page_%k(Own_%k)', ''), (0, 'export', 'value_%k', 10, '', ''), (1, 'function', 'default', 6, '(x)', 'x')) x(own, kind, name, line, signature, params) ON v = own""")
def mixed_ports(spark, sf_dir):
    return _tables(spark, sf_dir, "ports").select("moduleId", "kind", "name", "line", "signature", F.array_join("params", ",").alias("params"))


@query("mixed_diagnostics", f"""WITH {OF}
SELECT m AS "moduleId", kind, line, {IN.format('message')} AS message FROM c JOIN (VALUES
  (1, 'dynamic_import', 9, 'dynamic import of ''./late_%k'''), (1, 'dynamic_import', 10, 'dynamic import of non-literal target'), (1, 'unresolved_symbol', 7, 'unresolved symbol ''missing_%k'''),
  (3, 'parse_error', 0, 'no front end reads .vue files')) x(own, kind, line, message) ON v = own""")
def mixed_diagnostics(spark, sf_dir):
    return _tables(spark, sf_dir, "diagnostics").select("moduleId", "kind", "line", "message")
