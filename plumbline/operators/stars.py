"""Star imports expanded: which names a module hands on, through any chain of re-exports, and what they resolve to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import settled


def star_imports(imports: DataFrame, index: DataFrame) -> DataFrame:
    """(module_id, seq, target, at): the star imports of modules of the scan; at is the module they take from."""
    found = index.select(F.col("dotted").alias("__d"), F.col("target").alias("at"))
    stars = imports.where("kind = 'from_import' and name = '*'").select("module_id", "seq", "target")
    return stars.join(found, F.col("target") == F.col("__d")).drop("__d").where("module_id <> at")


def own_names(facts: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listed, names): the modules that have an __all__, and (module_id, name) of what each module hands on by itself:
    the strings of its __all__, or else its definitions and imported names without a leading underscore. An __all__ that is
    not a plain list or tuple of strings hands on what it shows: nothing."""
    exports = facts.where("fact = 'port' and kind = 'export'").select("module_id", "name")
    defined = facts.where("fact in ('def', 'func') and name <> '<module>'").select("module_id", "name")
    listed = defined.where("name = '__all__'").select("module_id").unionByName(exports.select("module_id")).distinct()
    bound = imports.where("name <> '*'").select("module_id", F.coalesce("alias", F.substring_index("name", ".", 1)).alias("name"))
    open_ = defined.unionByName(bound).where(~F.col("name").startswith("_")).join(listed.select(F.col("module_id").alias("__m")), F.col("module_id") == F.col("__m"), "left_anti")
    return listed, exports.unionByName(open_).distinct()


def public_names(facts: DataFrame, imports: DataFrame, index: DataFrame) -> DataFrame:
    """(module_id, name): all names that a star import of a module brings.

    What a module hands on by itself goes on to those that star-import it and have no __all__ of their own, and from there
    further. Where no module has two such imports, ways are told by pointers: before round k all names from less than 2 ** k
    imports away are known, each module takes those of the one 2 ** k imports on, and pointers are doubled; so there are as
    many rounds as the logarithm of the longest chain. Else only what was new in the last round is passed on, by one import a
    round. Either way, what a module has already is left out, and modules that import each other in a circle end as soon as
    nothing is new. Each round's names are written.
    """
    listed, own = own_names(facts, imports)
    edges = star_imports(imports, index).select("module_id", "at").distinct().join(listed.select(F.col("module_id").alias("__m")), F.col("module_id") == F.col("__m"), "left_anti")
    step = settled(edges.select(F.col("module_id").alias("to"), F.col("at").alias("of")))
    single = step.groupBy("to").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    known = new = settled(own)
    while True:
        passed = step.join(known if single else new, F.col("of") == F.col("module_id")).where(~F.col("name").startswith("_")).select(F.col("to").alias("module_id"), "name").distinct()
        had = known.select(F.col("module_id").alias("__m"), F.col("name").alias("__n"))
        new = settled(passed.join(had, (F.col("module_id") == F.col("__m")) & (F.col("name") == F.col("__n")), "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        if single:
            step = settled(step.join(step.select(F.col("to").alias("__to"), F.col("of").alias("__of")), F.col("of") == F.col("__to")).select("to", F.col("__of").alias("of")))


def star_bindings(facts: DataFrame, imports: DataFrame, index: DataFrame) -> DataFrame:
    """(module_id, seq, key, entry_module, entry_port): what star imports bind, as if each name were imported by itself from
    the module after `from`. Only names that the importer refers to are bound, so a long list of names costs nothing; a name
    that the importer binds or defines itself is left alone, as it may hide the imported one."""
    names = public_names(facts, imports, index)
    stars = star_imports(imports, index).select(F.col("module_id").alias("to"), "seq", "target", F.col("at").alias("of"))
    asked = facts.where("fact = 'reference'").select(F.col("module_id").alias("__r"), F.coalesce("base", "name").alias("key")).distinct()
    own = facts.where("fact in ('local', 'def', 'func')").select(F.col("module_id").alias("__o"), F.col("name").alias("__k")).distinct()
    met = stars.join(asked, F.col("to") == F.col("__r")).join(names, (F.col("of") == F.col("module_id")) & (F.col("key") == F.col("name")))
    free = met.join(own, (F.col("to") == F.col("__o")) & (F.col("key") == F.col("__k")), "left_anti")
    return free.select(F.col("to").alias("module_id"), "seq", "key", F.col("target").alias("entry_module"), F.col("key").alias("entry_port"))
