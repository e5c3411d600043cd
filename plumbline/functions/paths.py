"""Column functions over module paths and dotted names. All are plain Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Files of ECMAScript and TypeScript; their dotted names start with es: so that they are never a Python module's.
ES_FILE = r"\.(m?js|jsx|m?ts|tsx)$"


def dotted(path: Column) -> Column:
    """pkg/core.py -> pkg.core, pkg/__init__.py -> pkg; '' for an __init__.py of the root. web/app.ts -> es:web.app,
    web/index.ts -> es:web."""
    stem = F.when(path.endswith("__init__.py"), F.rtrim(F.regexp_replace(path, r"__init__\.py$", ""), F.lit("/"))).otherwise(F.regexp_replace(path, r"\.py$", ""))
    es = F.concat(F.lit("es:"), F.translate(F.regexp_replace(F.regexp_replace(path, ES_FILE, ""), "(^|/)index$", ""), "/", "."))
    return F.when(path.rlike(ES_FILE), es).otherwise(F.translate(stem, "/", "."))


def directory(path: Column) -> Column:
    """The dotted name of a file's directory; '' in the root."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")


def joined(base: Column, name: Column) -> Column:
    """base.name, or name alone after an empty base."""
    return F.when(base == "", name).otherwise(F.concat(base, F.lit("."), name))


def absolute(module: Column, level: Column, base: Column) -> Column:
    """The dotted target of an import statement: `module` at level 0; else seen from the directory `base`, of which each
    level after the first drops a part, down to the root at most."""
    parts = F.when(base == "", F.array().cast("array<string>")).otherwise(F.split(base, r"\."))
    kept = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (level - 1), F.lit(0))), ".")
    return F.when(level == 0, module).when(F.coalesce(module, F.lit("")) == "", kept).otherwise(joined(kept, module))


def prefixes(name: Column) -> Column:
    """array<struct<k, prefix>> of a dotted name: a, a.b, a.b.c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("prefix")))


def quoted(text: Column) -> Column:
    """A string as Python's repr shows it, for text without control characters."""
    backslashed = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    single = F.concat(F.lit("'"), F.replace(backslashed, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), backslashed, F.lit('"'))).otherwise(single)


def component_order(path: Column) -> Column:
    """Sorts paths by component, as a file browser does: a/b.py before a-b/x.py before a.py."""
    return F.split(path, "/")


def is_noise(path: Column, noise: tuple[str, ...]) -> Column:
    """A path with a component in `noise`, or an __init__.py."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, noise))) | (F.element_at(F.split(path, "/"), -1) == "__init__.py")


def node_id(path: Column) -> Column:
    """A path as an identifier: extension dropped, parts without leading underscores, joined by two of them."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(F.ltrim(p, F.lit("_")), r"[^A-Za-z0-9_]", "_")), "__")
