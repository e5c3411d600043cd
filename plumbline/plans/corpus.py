"""A corpus of Python sources that grows with the tables: a package for each nation, a module for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One customer in KINDS has each of these texts; %1$d is the customer, %2$d the nation.
KINDS = 8
TEXTS = (
    # 0: names that a star import may bring
    "from .base import *\nfirst_%1$d(1)\nthird_%1$d.go()\nsecond_%1$d(len(str(2)))\n",
    # 1: relative imports; a submodule goes before a name; a name that is nowhere; a private name
    "from . import base, gone_%1$d\nfrom .. import n%2$d as own\nfrom .base import make, _hidden as hid\nbase.make(1)\nown.build(2)\nhid()\nvalue: base.Base_%2$d = make(3)\n",
    # 2: decorators and annotations
    "import functools\nfrom .base import Base_%2$d, make\n\n@make\ndef run_%1$d(a: Base_%2$d, b: \"Base_%2$d\" = None, *c: list[int]) -> Base_%2$d:\n    \"\"\"Runs. Twice.\"\"\"\n    kept: Base_%2$d = a\n    return kept\n\n@functools.wraps(run_%1$d)\nclass Box_%1$d(Base_%2$d):\n    field: int = 0\n",
    # 3: exports and dynamic imports
    "import importlib\n__all__ = [\"alpha_%1$d\", \"_beta\"]\nalpha_%1$d = importlib.import_module(\"shop.n%2$d.base\")\n_beta = __import__(alpha_%1$d)\nmissing_%1$d()\n",
    # 4: a second definition, and names that bindings hide
    "def twice(a):\n    return a\n\ndef helper(twice):\n    return twice(1)\n\ndef twice(a, b):\n    return helper(b)\n\ndef caller():\n    helper = 3\n    return helper(twice(1))\n\nprint(len(twice(2)), key=caller)\n",
    # 5: two star imports, one of them of the standard library
    "from os import *\nfrom shop.n%2$d.base import *\nlost_%1$d()\nlost_%1$d(1)\nmake(2)\n",
    # 6: not Python
    "def broken_%1$d(:\n",
    # 7: another encoding, an escape that is none, definitions inside statements
    "# -*- coding: latin-1 -*-\nimport acme_%2$d.tools as t\ntry:\n    def caf\u00e9_%1$d(x=t.run()):\n        \"\"\"Caf\u00e9. Open.\"\"\"\n        return \"\\d\"\nexcept t.Error:\n    def never_%1$d():\n        pass\nif t:\n    class Late_%1$d(t.Base):\n        def own(self):\n            return caf\u00e9_%1$d()\ncaf\u00e9_%1$d()\n",
)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module_id, content binary): shop/__init__.py; for each nation its package with base.py; for each customer a module
    there, of one of the kinds in turn."""
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    n = F.col("n_nationkey")
    init = F.format_string('"""Nation. Its customers."""\nfrom .base import Base_%1$d, make as build\n__all__ = ["Base_%1$d", "build"]\n', n)
    base = F.format_string('class Base_%1$d:\n    """A base."""\n\ndef make(x: "Base_%1$d", *rest: int) -> "list[Base_%1$d]":\n    return Base_%1$d()\n\ndef _hidden():\n    return make(1)\n', n)
    nation = table("nation").select(F.explode(F.array(F.struct(F.format_string("shop/n%d/__init__.py", n).alias("module_id"), init.alias("text")), F.struct(F.format_string("shop/n%d/base.py", n).alias("module_id"), base.alias("text")))).alias("f")).select("f.*")
    top = table("region").where("r_regionkey = 0").select(F.lit("shop/__init__.py").alias("module_id"), F.lit('"""Shop."""\n').alias("text"))
    k, m = F.col("c_custkey"), F.col("c_nationkey")
    text = F.lit(None).cast("string")
    for i, form in enumerate(TEXTS):
        text = F.when(k % KINDS == i, F.format_string(form.replace("\\d", "\\d"), k, m)).otherwise(text)
    own = table("customer").select(F.format_string("shop/n%d/c%d.py", m, k).alias("module_id"), F.when(k % KINDS == 7, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("content"))
    return nation.unionByName(top).select("module_id", F.encode("text", "UTF-8").alias("content")).unionByName(own)
