"""Front ends by file name: what reads which language. Each gives fact rows of one schema (pyfacts.SCHEMA); all else of a scan is
the same for every language."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .esfacts import SUFFIXES, es_facts
from .pyfacts import COLUMNS, SCHEMA, py_facts

FrontEnd = Callable[..., DataFrame]
#: A further language is one more entry: a suffix, and a function from (module_id, content), and kinds if asked for, to facts.
FRONT_ENDS: dict[str, FrontEnd] = {".py": py_facts, **dict.fromkeys(SUFFIXES, es_facts)}


def _ends(path: Column, suffixes: list[str]) -> Column:
    return F.coalesce(F.substring_index(path, "/", -1).rlike(r".\.(?:" + "|".join(s.lstrip(".") for s in suffixes) + ")$"), F.lit(False))


def readable(files: DataFrame, front_ends: Mapping[str, FrontEnd] = FRONT_ENDS) -> DataFrame:
    """The files that a front end reads."""
    return files.where(_ends(F.col("module_id"), list(front_ends)))


def all_facts(files: DataFrame, front_ends: Mapping[str, FrontEnd] = FRONT_ENDS, *kinds: str) -> DataFrame:
    """The facts of files (module_id, content) in several languages, of all kinds or of those named, each read by the front end
    of its suffix. A file without one is no module and gives a parse_error that says so: what can't be read is listed, and the
    rest is scanned."""
    by_reader: dict[FrontEnd, list[str]] = {}
    for suffix, reader in front_ends.items():
        by_reader.setdefault(reader, []).append(suffix)
    path = F.col("module_id")
    suffix = F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]*)$", 1)
    message = F.concat(F.lit("no front end reads "), F.when(suffix == "", "a file without suffix").otherwise(F.concat(suffix, F.lit(" files"))))
    values = {"module_id": path, "fact": F.lit("parse_error"), "line": F.lit(0), "message": message}
    types = dict(c.strip().split() for c in SCHEMA.split(", "))
    out = files.where(~_ends(path, list(front_ends))).select(*(values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS))
    out = out if not kinds or "parse_error" in kinds else out.limit(0)
    for reader, suffixes in by_reader.items():
        out = out.unionByName(reader(files.where(_ends(path, suffixes)), *kinds))
    return out
