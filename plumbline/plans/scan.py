"""scan_codebase: source files in, a dependency graph of six tables out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.names import BUILTINS, STDLIB
from ..functions.frontends import all_facts, readable
from ..functions.pyfacts import py_facts
from ..operators import graph, resolve, stars
from ..sources.files import source_files


@dataclass
class Graph:
    """modules (id, path), ports (moduleId, seq, kind, name, line, signature, params, docstring), edges (source, target,
    targetPort, kind, sites, first), externals (id, name, kind), diagnostics (kind, moduleId, line, message, stage, seq),
    funcs (module_id, seq, name, line), calls (module_id, src, dst, line), and the facts they come from."""

    modules: DataFrame
    ports: DataFrame
    edges: DataFrame
    externals: DataFrame
    diagnostics: DataFrame
    funcs: DataFrame
    calls: DataFrame
    facts: DataFrame
    kept: list[DataFrame] = field(default_factory=list)

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if k not in ("facts", "kept")}

    def release(self) -> None:
        """Lets go of what was kept for the tables, which can still be read, from the sources anew."""
        for df in self.kept:
            df.unpersist()


def scan_files(files: DataFrame, *, front_ends: dict | None = None, **how) -> Graph:
    """The graph of a frame (module_id, content). Each source is parsed once; all else is joins and aggregates (scan_facts).
    All files are Python unless front_ends (functions/frontends.py) tell what reads which."""
    if front_ends is None:
        return scan_facts(py_facts(files), files.select("module_id"), **how)
    return scan_facts(all_facts(files, front_ends), readable(files, front_ends).select("module_id"), **how)


def scan_facts(stated: DataFrame, files: DataFrame, *, stdlib: tuple[str, ...] = STDLIB, builtins: tuple[str, ...] = BUILTINS, by_root: bool = False, expand_stars: bool = False) -> Graph:
    """The graph of facts that files (module_id) state, as py_facts gives them. With expand_stars the names that star imports
    of scanned modules bring count as imported; else a star import only explains what stays unresolved.

    The facts and what most tables share are kept in memory or on disk until release(); a lost part is made again.
    """
    kept: list[DataFrame] = []

    def _kept(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    facts = _kept(stated)
    index = _kept(resolve.module_index(files))
    imports = _kept(resolve.located_imports(facts, index))
    extra = stars.star_bindings(facts, imports, index) if expand_stars else None
    resolved = _kept(resolved_rows(facts, imports, index, port_names(facts), extra, stdlib=stdlib, builtins=builtins, by_root=by_root))
    return graph_of(facts, imports, resolved, kept)


def port_names(facts: DataFrame) -> DataFrame:
    """(module_id, name) of all ports."""
    return facts.where("fact = 'port'").select("module_id", "name").distinct()


def resolved_rows(facts: DataFrame, imports: DataFrame, index: DataFrame, names: DataFrame, extra: DataFrame | None = None, *, stdlib: tuple[str, ...] = STDLIB, builtins: tuple[str, ...] = BUILTINS, by_root: bool = False) -> DataFrame:
    """What the imports and references of facts resolve to, a row each; index and names may know more modules than facts."""
    found = resolve.resolve_imports(imports, index, names, stdlib, by_root=by_root)
    return found.unionByName(resolve.resolve_references(facts, resolve.symbol_table(imports, extra), index, names, stdlib, builtins, by_root=by_root))


#: Tables that facts of one kind state, without any resolution.
STATED = {"modules": "module", "ports": "port", "funcs": "func", "calls": "call"}
#: The kinds of facts that resolution reads, and those that diagnostics add.
RESOLVING = ("port", "import", "reference", "local", "def")
TOLD = ("parse_error", "duplicate_def", "dynamic_import")


def stated_table(facts: DataFrame, name: str) -> DataFrame:
    """One of the tables of STATED, from the facts of its kind."""
    own = facts.where(F.col("fact") == STATED[name])
    if name == "modules":
        return own.select(F.col("module_id").alias("id"), F.col("module_id").alias("path"))
    if name == "ports":
        return own.select(F.col("module_id").alias("moduleId"), "seq", "kind", "name", "line", "signature", "params", "docstring")
    return own.select("module_id", *(("seq", "name", "line") if name == "funcs" else ("src", "dst", "line")))


def graph_of(facts: DataFrame, imports: DataFrame, resolved: DataFrame, kept: list[DataFrame]) -> Graph:
    """The graph's tables from facts, their located imports and resolved rows."""
    modules, ports, funcs, calls = (stated_table(facts, name) for name in STATED)
    raw = resolved.where("edge_target is not null").select(F.col("module_id").alias("source"), F.col("edge_target").alias("target"), F.col("edge_port").alias("targetPort"), "kind", "line", "stage", "seq")
    return Graph(
        modules, ports, graph.merge_edges(raw), graph.distinct_externals(resolved, "external"), resolve.diagnostics(facts, imports, resolved),
        funcs, calls, facts, kept,
    )


def scan_codebase(spark: SparkSession, root: str, exclude_dirs: set[str] | None = None, **how) -> dict:
    """The graph of the Python files below root, or of those of all front_ends, as a dict of six keys, ready for JSON."""
    suffixes = tuple(how["front_ends"]) if how.get("front_ends") else (".py",)
    found = scan_files(source_files(spark, root, exclude_dirs, suffixes=suffixes), **how)
    try:
        return as_dict(found)
    finally:
        found.release()


def sections(g: Graph) -> dict[str, tuple[DataFrame, list]]:
    """The document's sections, each as a table of its elements in their published form, and the columns that order them: for
    graphs of any size, which executors write (sinks.write_sections) with null fields left out. An element of modules holds its
    module's ports, one of intra its functions and calls, as the document does; all else is flat."""
    port = F.struct("kind", "name", "line", "signature", "params", "docstring")
    own = g.ports.groupBy(F.col("moduleId").alias("__m")).agg(F.sort_array(F.collect_list(F.struct("seq", port.alias("p")))).alias("ps"))
    none = F.array().cast("array<struct<kind:string,name:string,line:int,signature:string,params:array<string>,docstring:string>>")
    modules = g.modules.join(own, F.col("id") == F.col("__m"), "left").select("id", "path", F.coalesce(F.col("ps.p"), none).alias("ports"))
    funcs = g.funcs.groupBy(F.col("module_id").alias("__f")).agg(F.sort_array(F.collect_list(F.struct("seq", "name", "line"))).alias("fs"))
    calls = g.calls.groupBy(F.col("module_id").alias("__c")).agg(F.sort_array(F.collect_list(F.struct("src", "dst", "line"))).alias("cs"))
    intra = g.modules.select("id").join(funcs, F.col("id") == F.col("__f"), "left").join(calls, F.col("id") == F.col("__c"), "left")
    listed = lambda c, kind, **names: F.coalesce(F.transform(c, lambda x: F.struct(*(x[a].alias(b) for b, a in names.items()))), F.array().cast(kind))
    intra = intra.select("id", listed("fs", "array<struct<name:string,line:int>>", name="name", line="line").alias("funcs"), listed("cs", "array<struct<from:string,to:string,line:int>>", **{"from": "src", "to": "dst", "line": "line"}).alias("calls"))
    edges = g.edges.select("source", "target", "kind", F.transform("sites", lambda n: F.struct(n.alias("line"))).alias("sites"), "targetPort", F.col("first").alias("__first"))
    by_line = [F.col("source"), F.col("target"), F.col("kind"), F.col("sites")[0]["line"], F.col("__first")]
    flat = g.ports.select("kind", "name", "line", "signature", "params", "docstring", "moduleId", F.col("seq").alias("__seq"))
    notes = g.diagnostics.select("kind", "moduleId", "line", "message", F.col("stage").alias("__stage"), F.col("seq").alias("__seq"))
    return {
        "modules": (modules, [paths.component_order(F.col("id"))]), "ports": (flat, [paths.component_order(F.col("moduleId")), F.col("__seq")]), "edges": (edges, by_line),
        "externalModules": (g.externals.select("id", "name", "kind"), [F.col("id")]), "diagnostics": (notes, [F.col(c) for c in ("moduleId", "line", "__stage", "__seq")]),
        "intra": (intra, [paths.component_order(F.col("id"))]),
    }


def as_dict(g: Graph) -> dict:
    """The graph in its published form and order, as one document on the driver. A graph is a summary of its sources and
    mostly fits; for one that doesn't see sections."""
    port = F.struct("kind", "name", "line", "signature", "params", "docstring")
    by_module = g.ports.groupBy(F.col("moduleId").alias("__m")).agg(F.sort_array(F.collect_list(F.struct("seq", port.alias("p")))).alias("ps"))
    rows = g.modules.join(by_module, F.col("id") == F.col("__m"), "left").orderBy(paths.component_order(F.col("id"))).collect()
    modules, flat, intra = [], [], {}
    for r in rows:
        own = [_port(x["p"]) for x in r["ps"] or []]
        modules.append({"id": r["id"], "path": r["path"], "ports": own})
        flat += [p | {"moduleId": r["id"]} for p in own]
        intra[r["id"]] = {"funcs": [], "calls": []}
    for r in g.funcs.orderBy("module_id", "seq").collect():
        intra[r["module_id"]]["funcs"].append({"name": r["name"], "line": r["line"]})
    for r in g.calls.orderBy("module_id", "src", "dst", "line").collect():
        intra[r["module_id"]]["calls"].append({"from": r["src"], "to": r["dst"], "line": r["line"]})
    edges = []
    for r in g.edges.orderBy(*graph.edge_order()).collect():
        edge = {"source": r["source"], "target": r["target"], "kind": r["kind"], "sites": [{"line": n} for n in r["sites"]]}
        edges.append(edge | ({"targetPort": r["targetPort"]} if r["targetPort"] is not None else {}))
    return {
        "modules": modules, "ports": flat, "edges": edges,
        "externalModules": [{"id": r["id"], "name": r["name"], "kind": r["kind"]} for r in g.externals.orderBy("id").collect()],
        "diagnostics": [{k: r[k] for k in ("kind", "moduleId", "line", "message")} for r in g.diagnostics.orderBy("moduleId", "line", "stage", "seq").collect()],
        "intra": intra,
    }


def _port(p) -> dict:
    out = p.asDict() | {"params": list(p["params"] or [])}
    return {k: v for k, v in out.items() if k != "docstring" or v is not None}
