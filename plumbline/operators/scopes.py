"""Which binding a name means, and who calls whom inside a module, by joins of places with scopes (functions/pyscopes.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import BUILTINS
from ..functions.pyfacts import TOP
from .intervals import holding

M = ["module_id"]
# All tables here grow with the sources, and in Parquet files they take a small part of their size in memory: so joins sort,
# and none is sent through the driver, whatever the size of its file.


def _scopes(rows: DataFrame) -> DataFrame:
    return rows.where("fact = 'scope'").select("module_id", F.col("pos").alias("scope"), F.col("kind").alias("scope_kind"), F.col("name").alias("scope_name"), F.col("line").alias("scope_line"), "bound", "body", "stop")


def scope_bindings(rows: DataFrame) -> DataFrame:
    """(module_id, scope, name): the names that each scope binds. A function or class binds what is bound anywhere in it, a
    lambda its parameters."""
    binds = rows.where("fact = 'bind'").select("module_id", "name", F.col("pos").alias("at"))
    return holding(binds, _scopes(rows).select("module_id", "scope", "bound"), M, "at", "scope", "bound").select("module_id", "scope", "name").distinct()


def module_bindings(rows: DataFrame) -> DataFrame:
    """(module_id, name): names stored outside all functions, classes and lambdas."""
    binds = rows.where("fact = 'bind' and kind = 'name'").select("module_id", "name", F.col("pos").alias("at"))
    held = holding(binds.select("module_id", "at"), _scopes(rows).select("module_id", "scope", "stop"), M, "at", "scope", "stop").select("module_id", "at")
    return binds.join(held.hint("merge"), ["module_id", "at"], "left_anti").select("module_id", "name").distinct()


def hosts(rows: DataFrame) -> DataFrame:
    """(module_id, scope, host): the functions and classes that stand in no other, and whom their calls count for: the first of
    a name for itself, later ones for the module."""
    own = _scopes(rows).where("scope_kind <> 'lambda'")
    held = holding(own.select("module_id", F.col("scope").alias("at")), own.select("module_id", "scope", "body", "stop"), M, "at", "body", "stop").select("module_id", F.col("at").alias("scope"))
    outer = own.join(held.hint("merge"), ["module_id", "scope"], "left_anti").select("module_id", "scope", "scope_name")
    first = outer.groupBy("module_id", "scope_name").agg(F.min("scope").alias("__first"))
    return outer.join(first.hint("merge"), ["module_id", "scope_name"]).select("module_id", "scope", F.when(F.col("scope") == F.col("__first"), F.col("scope_name")).otherwise(TOP).alias("host"))


def meant(rows: DataFrame) -> DataFrame:
    """A row for each call and name that it calls or is handed: module_id, pos, name, line, host (whom it counts for), and the innermost scope
    around it that binds the name: scope, scope_kind, scope_name, scope_line (null where none does)."""
    uses = rows.where("fact = 'call'").select("module_id", "pos", "name", "line")
    around = holding(uses.drop("line"), _scopes(rows).drop("bound"), M, "pos", "body", "stop").drop("body", "stop")
    marked = around.join(scope_bindings(rows).withColumn("__own", F.lit(True)).hint("merge"), ["module_id", "scope", "name"], "left")
    told = marked.join(hosts(rows).hint("merge"), ["module_id", "scope"], "left").groupBy("module_id", "pos", "name").agg(
        F.max(F.when(F.col("__own"), F.struct("scope", "scope_kind", "scope_name", "scope_line"))).alias("__in"), F.max("host").alias("host")
    )
    return uses.join(told.hint("merge"), ["module_id", "pos", "name"], "left").select("module_id", "pos", "name", "line", F.coalesce("host", F.lit(TOP)).alias("host"), "__in.*")


def scope_calls(rows: DataFrame, builtins: tuple[str, ...] = BUILTINS) -> DataFrame:
    """(module_id, src, dst, line): calls between the functions and classes of each module, as the facts of kind `call` have
    them. What a scope around, an import, an assignment of the module or a builtin binds is none; nor is recursion."""
    names = rows.where("fact = 'def'").select("module_id", "name").distinct().where(~F.col("name").isin(*builtins))
    hidden = rows.where("fact = 'import'").select("module_id", "name").unionByName(module_bindings(rows))
    visible = names.join(hidden.hint("merge"), ["module_id", "name"], "left_anti")
    free = meant(rows).where("scope is null and name <> host").join(visible.hint("merge"), ["module_id", "name"])
    return free.select("module_id", F.col("host").alias("src"), F.col("name").alias("dst"), "line").distinct()
