"""Resolution of imports and references against the module index: cascades of left joins, each decided by one CASE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.names import BUILTINS, STDLIB

#: Order of the stages in which a module's rows come about: ties in results go to the earlier stage.
PARSE, REPEATED, DYNAMIC, IMPORT, REFERENCE, STAR = range(6)


def module_index(files: DataFrame) -> DataFrame:
    """(dotted, target): every file by its dotted name. Of two files with one name the package wins, then the first path."""
    named = files.select("module_id", paths.dotted(F.col("module_id")).alias("dotted")).where("dotted <> ''")
    rank = F.struct((~F.col("module_id").endswith("__init__.py")).alias("r"), F.col("module_id").alias("target"))
    return named.groupBy("dotted").agg(F.min(rank).alias("m")).select("dotted", "m.target")


def longest_prefix(names: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """(name, target, exact) for the distinct values of a column that are in the index, or a dotted prefix of which is:
    the longest. Each distinct name becomes a row for each of its prefixes; that is an equality join, not a range one."""
    parts = names.select(F.col(column).alias("name")).where("name is not null").distinct().select("name", F.explode(paths.prefixes(F.col("name"))).alias("p"))
    hits = parts.select("name", "p.k", "p.prefix").join(index, F.col("prefix") == F.col("dotted"))
    best = hits.groupBy("name").agg(F.max(F.struct("k", "target", "prefix")).alias("b"))
    return best.select("name", "b.target", (F.col("b.prefix") == F.col("name")).alias("exact"))


def classified(df: DataFrame, column: str, index: DataFrame, stdlib: tuple[str, ...], *, by_root: bool = False) -> DataFrame:
    """df with cls (local, stdlib, third_party) and at, the module of a local name; a null name has neither.

    A standard-library name counts as such only in full (os, not os.path), unless by_root.
    """
    found = longest_prefix(df, column, index).select(F.col("name").alias("__n"), F.col("target").alias("at"))
    known = F.substring_index(F.col(column), ".", 1) if by_root else F.col(column)
    cls = F.when(F.col("at").isNotNull(), "local").when(known.isin(list(stdlib)), "stdlib").when(F.col(column).isNotNull(), "third_party")
    return df.join(found, F.col(column) == F.col("__n"), "left").withColumn("cls", cls).drop("__n")


def _exact(df: DataFrame, column: str, index: DataFrame, to: str) -> DataFrame:
    found = index.select(F.col("dotted").alias("__d"), F.col("target").alias(to))
    return df.join(found, F.col(column) == F.col("__d"), "left").drop("__d")


def _with_port(df: DataFrame, names: DataFrame, module: str, name: str, to: str) -> DataFrame:
    """df with `to`: the name if it is a port of the module, else null. names is distinct, so no row is doubled."""
    found = names.select(F.col("module_id").alias("__m"), F.col("name").alias("__p"))
    return df.join(found, (F.col(module) == F.col("__m")) & (F.col(name) == F.col("__p")), "left").withColumn(to, F.col("__p")).drop("__m", "__p")


def located_imports(facts: DataFrame, index: DataFrame) -> DataFrame:
    """Import rows with target (the dotted module that is meant) and sub (the submodule that the name may be, in Python)."""
    rows = facts.where("fact = 'import'").select("module_id", "seq", "line", "kind", "module", "level", "name", "alias")
    base = paths.directory(F.col("module_id"))
    target = F.when(F.col("kind") == "import", F.col("name")).otherwise(paths.absolute(F.col("module"), F.col("level"), base))
    rows = rows.withColumn("target", target).withColumn("sub", F.when((F.col("kind") == "from_import") & ~F.col("target").startswith("es:"), paths.joined(F.col("target"), F.col("name"))))
    return _exact(rows, "sub", index, "sub_at")


def symbol_table(imports: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(module_id, key, entry_module, entry_port): what each bound name of a module stands for; entry_port is null where
    it is a module. An alias or from-import takes its name whatever had it; the root of a dotted import only takes a free
    one. So: the last firm binding, else the first loose one. extra (module_id, seq, key, entry_module, entry_port) are
    further firm bindings, such as those of expanded star imports."""
    plain = F.col("kind") == "import"
    key = F.coalesce("alias", "name")
    root = F.substring_index("name", ".", 1)
    entry = F.struct(F.when(plain, F.col("name")).when(F.col("sub_at").isNotNull(), F.col("sub")).otherwise(F.col("target")).alias("entry_module"), F.when(~plain & F.col("sub_at").isNull(), F.col("name")).alias("entry_port"))
    firm = F.struct(key.alias("key"), F.lit(True).alias("firm"))
    loose = F.when(plain & (root != key), F.struct(root.alias("key"), F.lit(False).alias("firm")))
    bound = imports.where("name <> '*' or kind = 'import'").select("module_id", "seq", entry.alias("entry"), F.explode(F.array_compact(F.array(firm, loose))).alias("b"))
    if extra is not None:
        bound = bound.unionByName(extra.select("module_id", "seq", F.struct("entry_module", "entry_port").alias("entry"), F.struct("key", F.lit(True).alias("firm")).alias("b")))
    picked = bound.groupBy("module_id", F.col("b.key").alias("key")).agg(
        F.expr("max_by(entry, seq) filter (where b.firm)").alias("last"), F.expr("min_by(entry, seq) filter (where not b.firm)").alias("first")
    )
    best = F.coalesce("last", "first")
    return picked.select("module_id", "key", best["entry_module"].alias("entry_module"), best["entry_port"].alias("entry_port"))


def resolve_imports(imports: DataFrame, index: DataFrame, ports: DataFrame, stdlib: tuple[str, ...] = STDLIB, **how) -> DataFrame:
    """Each import row with edge_target, edge_port, external, unresolved; all null where it says nothing (stdlib). asked_at
    and asked_name are the module and the name whose port the answer hangs on.

    import: a local name, whole or by its longest prefix, is an edge to that module; another an edge to the full name.
    from: the submodule of that name wins, then the module with the port of that name, then a third-party module; a
    target that is local by a prefix alone leaves the name unresolved.
    """
    rows = classified(_exact(imports, "target", index, "exact_at"), "target", index, stdlib, **how)
    rows = _with_port(rows, ports, "exact_at", "name", "own_port")
    plain, third = F.col("kind") == "import", F.col("cls") == "third_party"
    inside = ~plain & (F.col("sub_at").isNotNull() | F.col("exact_at").isNotNull())
    return rows.select(
        "module_id", "kind", "line", F.lit(IMPORT).alias("stage"), "seq",
        F.when(plain & (F.col("cls") == "local"), F.col("at")).when(inside, F.coalesce("sub_at", "exact_at")).when(third, F.col("target")).alias("edge_target"),
        F.when(plain | F.col("sub_at").isNotNull(), None).when(F.col("exact_at").isNotNull(), F.col("own_port")).when(third, F.col("name")).alias("edge_port"),
        F.when(third & ~inside, F.col("target")).alias("external"),
        F.when(~plain & ~inside & (F.col("cls") == "local"), F.col("name")).alias("unresolved"),
        F.when(~plain, F.col("exact_at")).alias("asked_at"), F.when(~plain, F.col("name")).alias("asked_name"),
    )


def resolve_references(facts: DataFrame, symbols: DataFrame, index: DataFrame, ports: DataFrame, stdlib: tuple[str, ...] = STDLIB, builtins: tuple[str, ...] = BUILTINS, **how) -> DataFrame:
    """Each reference row with the same columns as resolve_imports.

    With a receiver: a local or defined one says nothing, then the symbol table decides, then a builtin says nothing.
    A bare name: the symbol table decides first, then local, defined and builtin names say nothing. What is left is
    unresolved.
    """
    rows = facts.where("fact = 'reference'").select("module_id", "seq", "line", "kind", "name", "base").withColumn("key", F.coalesce("base", "name"))
    own = facts.where("fact in ('local', 'def')").select(F.col("module_id").alias("__m"), F.col("name").alias("__k")).distinct()
    rows = rows.join(own, (F.col("module_id") == F.col("__m")) & (F.col("key") == F.col("__k")), "left").withColumn("own", F.col("__k").isNotNull()).drop("__m", "__k")
    table = symbols.select(F.col("module_id").alias("__m"), F.col("key").alias("__k"), "entry_module", "entry_port")
    rows = rows.join(table, (F.col("module_id") == F.col("__m")) & (F.col("key") == F.col("__k")), "left").withColumn("bound", F.col("__k").isNotNull()).drop("__m", "__k")
    rows = rows.withColumn("attr", F.coalesce(F.when(F.col("base").isNotNull(), F.col("name")), "entry_port"))
    rows = _with_port(classified(rows, "entry_module", index, stdlib, **how), ports, "at", "attr", "own_port")
    dotted = F.col("base").isNotNull()
    follows = F.col("bound") & ~(dotted & F.col("own"))
    third = follows & (F.col("cls") == "third_party")
    quiet = F.col("own") | F.col("key").isin(list(builtins))
    return rows.select(
        "module_id", "kind", "line", F.lit(REFERENCE).alias("stage"), "seq",
        F.when(follows & (F.col("cls") == "local"), F.col("at")).when(third, F.col("entry_module")).alias("edge_target"),
        F.when(follows & (F.col("cls") == "local"), F.col("own_port")).when(third, F.col("attr")).alias("edge_port"),
        F.when(third, F.col("entry_module")).alias("external"),
        F.when(~follows & ~quiet, F.when(dotted, F.concat("base", F.lit("."), "name")).otherwise(F.col("name"))).alias("unresolved"),
        F.when(follows, F.col("at")).alias("asked_at"), F.when(follows, F.col("attr")).alias("asked_name"),
    )


def star_notes(imports: DataFrame, deferred: DataFrame) -> DataFrame:
    """A diagnostic for each star import of a module with unresolved references: their number and first five names."""
    names = deferred.groupBy("module_id").agg(F.sort_array(F.collect_set("unresolved")).alias("names")).withColumnRenamed("module_id", "__m")
    stars = imports.where("kind = 'from_import' and name = '*'").join(names, F.col("module_id") == F.col("__m"))
    n, five = F.size("names"), F.array_join(F.transform(F.slice("names", 1, 5), paths.quoted), ", ")
    more = F.when(n > 5, F.concat(F.lit(" (+"), (n - 5).cast("string"), F.lit(" more)"))).otherwise("")
    target = F.coalesce(F.when(F.col("target") != "", F.col("target")), F.when(F.col("module") != "", F.col("module")), F.lit("."))
    message = F.concat(n.cast("string"), F.lit(" unresolved symbol(s) in this module may come from star import of "), paths.quoted(target), F.lit(" (e.g. "), five, more, F.lit("); per-site diagnostics aggregated"))
    return stars.select(F.lit("star_import_unresolved").alias("kind"), F.col("module_id").alias("moduleId"), "line", message.alias("message"), F.lit(STAR).alias("stage"), "seq")


def diagnostics(facts: DataFrame, imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """(kind, moduleId, line, message, stage, seq), one for each kind, module and line: the first that came about.

    Unresolved references of a module with a star import become one note for each such import.
    """
    stated = facts.where("fact in ('parse_error', 'duplicate_def', 'dynamic_import')").select(
        F.col("fact").alias("kind"), F.col("module_id").alias("moduleId"), "line", "message",
        F.when(F.col("fact") == "parse_error", PARSE).when(F.col("fact") == "duplicate_def", REPEATED).otherwise(DYNAMIC).alias("stage"), F.coalesce("seq", F.lit(0)).alias("seq"),
    )
    starred = imports.where("kind = 'from_import' and name = '*'").select(F.col("module_id").alias("__m")).distinct()
    lost = resolved.where("unresolved is not null").join(starred, F.col("module_id") == F.col("__m"), "left")
    put_off = (F.col("stage") == REFERENCE) & F.col("__m").isNotNull()
    single = lost.where(~put_off).select(F.lit("unresolved_symbol").alias("kind"), F.col("module_id").alias("moduleId"), "line", F.concat(F.lit("unresolved symbol "), paths.quoted(F.col("unresolved"))).alias("message"), "stage", "seq")
    return first_diagnostics(stated.unionByName(single).unionByName(star_notes(imports, lost.where(put_off))))


def first_diagnostics(every: DataFrame) -> DataFrame:
    """Of the diagnostics of one kind, moduleId and line the first by (stage, seq)."""
    first = every.groupBy("kind", "moduleId", "line").agg(F.min(F.struct("stage", "seq", "message")).alias("f"))
    return first.select("kind", "moduleId", "line", "f.message", "f.stage", "f.seq")
