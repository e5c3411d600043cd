"""Queries of expanded star imports and of incremental resolution; and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve, stars
from ..operators.order import placed
from ..sources.store import fresh_folder, settled
from ..functions.pyfacts import py_facts
from ..streaming.incremental import Incremental
from . import bindings as b
from . import corpus_queries as c
from .corpus import corpus
from .registry import query
from .scan import scan_files


def chained(spark, sf_dir):
    """(module_id, content): a module for each customer that star-imports that of the customer whom it refers to, so that
    names pass along chains and around cycles; one in seven has an __all__. Each calls names one and two steps away, a
    private name, and one that is nowhere."""
    known = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    refers = b.referrals(spark, sf_dir).where("source <> target").join(known, F.col("target") == F.col("id"), "left_semi").select("source", "target")
    one = refers.toDF("__a", "t")
    two = refers.toDF("__b", "g")
    rows = known.join(one, F.col("id") == F.col("__a"), "left").join(two, F.col("t") == F.col("__b"), "left")
    all_ = F.substring("id", 2, 20).cast("int") % 7 == 3
    head = F.when(F.col("t").isNull(), F.lit("pass")).otherwise(F.concat(F.lit("from stars."), F.col("t"), F.lit(" import *")))
    listed = F.when(all_, F.format_string('__all__ = ["name_%1$s", "_own_%1$s"]', "id")).otherwise("value = 0")
    body = F.format_string("def name_%1$s():\n    pass\ndef _own_%1$s():\n    pass\nname_%2$s()\nname_%3$s()\n_own_%2$s()\nlost_%1$s()\n", "id", F.coalesce("t", F.lit("none")), F.coalesce("g", F.lit("none")))
    return rows.select(F.concat(F.lit("stars/"), "id", F.lit(".py")).alias("module_id"), F.encode(F.concat(head, F.lit("\n"), listed, F.lit("\n"), body), "UTF-8").alias("content"))


CHAINED = f"""
{b.REFERRALS},
links AS (SELECT source AS m, target AS t FROM refers WHERE source <> target AND target IN (SELECT id FROM people)),
mods AS (SELECT id AS m, t, CAST(substr(id, 2) AS INTEGER) % 7 = 3 AS listed FROM people LEFT JOIN links ON id = m),
own AS (SELECT m, 'name_' || m AS name FROM mods UNION ALL SELECT m, '_own_' || m FROM mods WHERE listed UNION ALL SELECT m, 'value' FROM mods WHERE NOT listed),
names AS (SELECT m, name FROM own UNION SELECT l.m, n.name FROM names n JOIN links l ON n.m = l.t JOIN mods d ON d.m = l.m WHERE NOT d.listed AND NOT starts_with(n.name, '_'))"""


@query("star_names", f"WITH RECURSIVE {CHAINED} SELECT 'stars/' || m || '.py' AS module_id, name FROM names")
def star_names(spark, sf_dir):
    files = chained(spark, sf_dir)
    facts, index = settled(py_facts(files)), resolve.module_index(files)
    return stars.public_names(facts, resolve.located_imports(facts, index), index)


@query("star_calls", f"""
WITH RECURSIVE {CHAINED},
asked AS (SELECT m, t, 'name_' || t AS name, 7 AS line FROM mods WHERE t IS NOT NULL UNION ALL SELECT a.m, a.t, 'name_' || d.t, 8 FROM mods a JOIN mods d ON a.t = d.m WHERE d.t IS NOT NULL
          UNION ALL SELECT m, t, '_own_' || t, 9 FROM mods WHERE t IS NOT NULL)
SELECT 'stars/' || a.m || '.py' AS source, 'stars/' || a.t || '.py' AS target,
       CASE WHEN a.name = 'name_' || a.t OR a.name = '_own_' || a.t THEN a.name END AS targetPort, CAST(line AS VARCHAR) AS sites
FROM asked a JOIN names n ON n.m = a.t AND n.name = a.name WHERE a.name <> 'name_' || a.m""")
def star_calls(spark, sf_dir):
    found = scan_files(chained(spark, sf_dir), expand_stars=True)
    try:
        return settled(found.edges.where("kind = 'call'").select("source", "target", "targetPort", c.lines("sites").alias("sites")))
    finally:
        found.release()


#: What an expansion adds to the corpus: names of a scanned module, not those of the standard library's.
EXPANDED = c.EDGES.rstrip()[:-1] + "\n  UNION ALL SELECT m, b, 'make', 'call', [5], 4, 2 FROM c WHERE v = 5)"


@query("star_edges", f"{EXPANDED} SELECT row_number() OVER (ORDER BY source, target, kind, spots[1], stage, seq) AS place, source, target, port AS targetPort, kind, array_to_string(spots, ',') AS sites FROM e")
def star_edges(spark, sf_dir):
    found = scan_files(corpus(spark, sf_dir), expand_stars=True)
    try:
        return placed(settled(found.edges), *c.graph.edge_order()).withColumn("sites", c.lines("sites")).drop("first")
    finally:
        found.release()


@query("star_notes", f"""
WITH {c.CORPUS}
SELECT m AS moduleId, CAST(1 AS INTEGER) AS line, '3 unresolved symbol(s) in this module may come from star import of ''shop.n' || n || '.base'' (e.g. ''first_' || k || ''', ''second_' || k || ''', ''third_' || k || '.go''); per-site diagnostics aggregated' AS message FROM c WHERE v = 0
UNION ALL SELECT m, x.line, '1 unresolved symbol(s) in this module may come from star import of ''' || replace(x.name, '#', 'shop.n' || n || '.base') || ''' (e.g. ''lost_' || k || '''); per-site diagnostics aggregated' FROM c, (VALUES (1, 'os'), (2, '#')) x(line, name) WHERE v = 5""")
def star_notes(spark, sf_dir):
    """Only names that are nowhere are left to the notes."""
    found = scan_files(corpus(spark, sf_dir), expand_stars=True)
    try:
        return settled(found.diagnostics.where("kind = 'star_import_unresolved'").select("moduleId", "line", "message"))
    finally:
        found.release()


def _grown(spark, sf_dir):
    """The corpus in three batches: at first the bases of one region's nations are missing and those of another have other
    names; then the former come, then the latter come anew. The state, and the graph after the last batch."""
    every = corpus(spark, sf_dir)
    base = lambda r: b.table(spark, sf_dir, "nation").where(F.col("n_regionkey") == r).select(F.format_string("shop/n%d/base.py", "n_nationkey").alias("module_id"))
    late, other = (every.join(base(r), "module_id", "left_semi") for r in (0, 1))
    first = every.join(base(0).unionByName(base(1)), "module_id", "left_anti").unionByName(other.withColumn("content", F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("def make("), F.lit("def made(")), "UTF-8")))
    state = Incremental(spark, fresh_folder(spark, "incremental"))
    for number, files in enumerate((first, late, other)):
        found = state.apply(files, number)
    return state, found


@query("incremental_edges", f"{c.EDGES} SELECT source, target, port AS targetPort, kind, array_to_string(spots, ',') AS sites FROM e")
def incremental_edges(spark, sf_dir):
    """After the last batch the graph is that of a scan of all files."""
    return _grown(spark, sf_dir)[1].edges.select("source", "target", "targetPort", "kind", c.lines("sites").alias("sites"))


@query("incremental_touched", f"""
WITH {c.CORPUS}, r AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation)
SELECT 0 AS batch, m AS module_id FROM c UNION ALL SELECT 0, p FROM g UNION ALL SELECT 0, 'shop/__init__.py' UNION ALL SELECT 0, b FROM g JOIN r USING (n) WHERE r <> 0
UNION ALL SELECT 1, b FROM g JOIN r USING (n) WHERE r = 0 UNION ALL SELECT 1, p FROM g JOIN r USING (n) WHERE r = 0 UNION ALL SELECT 1, m FROM c JOIN r USING (n) WHERE r = 0 AND v IN (0, 1, 2, 5)
UNION ALL SELECT 2, b FROM g JOIN r USING (n) WHERE r = 1 UNION ALL SELECT 2, p FROM g JOIN r USING (n) WHERE r = 1 UNION ALL SELECT 2, m FROM c JOIN r USING (n) WHERE r = 1 AND v IN (1, 2)""")
def incremental_touched(spark, sf_dir):
    """Which modules each batch resolved: those that came, and those that asked for what it changed."""
    state, _ = _grown(spark, sf_dir)
    return state._read("touched").where("batch >= 0").select("batch", "module_id")
