"""Queries of what a change reaches, contracts, packages and the diagram, over all customers as modules; and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, diagram, graph, reach
from ..sources import sinks
from ..sources.store import fresh_folder
from . import bindings as b
from .registry import query

#: Segments as layers, the first at the top.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def sites(spark, sf_dir):
    """(id, path, changed) of the customers: segment, nation and customer as a path; those who owe count as changed."""
    path = F.concat("c_mktsegment", F.lit("/n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"))
    return b.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), path.alias("path"), (F.col("c_acctbal") < 0).alias("changed"))


def uses(spark, sf_dir):
    """The referrals between paths: source, target, kind."""
    at = sites(spark, sf_dir)
    rows = b.referrals(spark, sf_dir).select("source", "target", F.col("kinds")[0].alias("kind"))
    for end in ("source", "target"):
        rows = rows.join(at.select(F.col("id").alias("__i"), F.col("path").alias("__p")), F.col(end) == F.col("__i")).withColumn(end, F.col("__p")).drop("__i", "__p")
    return rows


USES = b.REFERRALS.replace("refers AS", "every AS") + """,
sites AS (SELECT 'c' || c_custkey AS id, c_mktsegment || '/n' || c_nationkey || '/c' || c_custkey AS path, c_acctbal < 0 AS changed FROM customer),
refers AS (SELECT x.path AS source, y.path AS target, kinds AS kind FROM every JOIN sites x ON source = x.id JOIN sites y ON target = y.id)"""
UNITS = b.REACH + """,
units AS (SELECT path AS id, coalesce(component, path) AS unit, changed FROM sites LEFT JOIN members ON path = members.id),
links AS (SELECT u.unit AS a, v.unit AS b, min([source, target]) AS e FROM refers JOIN units u ON source = u.id JOIN units v ON target = v.id WHERE u.unit <> v.unit GROUP BY ALL)"""
WALK = f"""
WITH RECURSIVE {USES}, {UNITS},
walk AS (SELECT unit, 0 AS hop, id AS origin FROM units WHERE changed UNION SELECT a, hop + 1, origin FROM walk JOIN links ON b = unit),
least AS (SELECT unit, min(hop) AS hop FROM walk GROUP BY unit),
near AS (SELECT unit, hop, min(origin) AS origin FROM walk JOIN least USING (unit, hop) GROUP BY ALL),
via AS (SELECT o.unit, min(e) AS e FROM near o JOIN links ON a = o.unit JOIN near p ON p.unit = b AND p.hop = o.hop - 1 AND p.origin = o.origin GROUP BY ALL),
touched AS (SELECT id, hop AS hops, origin, e[1] AS via_source, e[2] AS via_target FROM units JOIN near USING (unit) LEFT JOIN via USING (unit))"""


def _touched(spark, sf_dir):
    return reach.impact(uses(spark, sf_dir), sites(spark, sf_dir).where("changed").select(F.col("path").alias("id")))


@query("impact_hops", f"{WALK} SELECT * FROM touched")
def impact_hops(spark, sf_dir):
    """Whom the customers who owe may drag along: all that refer to them, however indirectly."""
    return _touched(spark, sf_dir)


@query("impact_sizes", f"{WALK} SELECT origin, count(*) AS n, max(hops) AS furthest FROM touched GROUP BY origin")
def impact_sizes(spark, sf_dir):
    return reach.impact_sizes(_touched(spark, sf_dir))


@query("condensed_links", f"WITH RECURSIVE {USES}, {UNITS} SELECT a, b, e[1] AS source, e[2] AS target FROM links")
def condensed_links(spark, sf_dir):
    return reach.condensed(uses(spark, sf_dir))[1]


PREFIXES = """
prefixes AS (
  SELECT path AS id, 0 AS depth, '' AS prefix FROM sites UNION ALL SELECT path, 1, split_part(path, '/', 1) FROM sites
  UNION ALL SELECT path, 2, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM sites UNION ALL SELECT path, 3, path FROM sites)"""
RULES = """
rules AS (
  SELECT 'no-building' AS rule, '' AS s, 'BUILDING' AS t, false AS allowed FROM region WHERE r_regionkey = 0
  UNION ALL SELECT 'tie-a', 'MACHINERY', 'FURNITURE', true FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'tie-b', 'MACHINERY', 'FURNITURE', false FROM region WHERE r_regionkey = 0
  UNION ALL SELECT 'own-' || n_nationkey, 'AUTOMOBILE/n' || n_nationkey, 'BUILDING', true FROM nation
  UNION ALL SELECT 'far-' || n_nationkey, 'MACHINERY', 'FURNITURE/n' || n_nationkey, n_regionkey = 1 FROM nation)"""


def rules(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n"), (F.col("n_regionkey") == 1).alias("first"))
    one = b.table(spark, sf_dir, "region").where("r_regionkey = 0")
    rule = lambda df, *cols: df.select(*(F.lit(c).alias(x) if isinstance(c, (str, bool)) else c.alias(x) for c, x in zip(cols, ("rule", "source", "target", "allowed"))))
    named = lambda head: F.concat(F.lit(head), F.col("n"))
    parts = [rule(one, "no-building", "", "BUILDING", False), rule(one, "tie-a", "MACHINERY", "FURNITURE", True), rule(one, "tie-b", "MACHINERY", "FURNITURE", False)]
    parts += [rule(n, named("own-"), named("AUTOMOBILE/n"), "BUILDING", True), rule(n, named("far-"), F.lit("MACHINERY"), named("FURNITURE/n"), F.col("first"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


@query("contract_rules", f"""
WITH {USES}, {PREFIXES}, {RULES},
e AS (SELECT DISTINCT source, target FROM refers WHERE source <> target),
hits AS (SELECT e.*, rule, allowed, row_number() OVER (PARTITION BY source, target ORDER BY x.depth + y.depth DESC, x.depth DESC, allowed, rule) AS k
         FROM e JOIN prefixes x ON source = x.id JOIN prefixes y ON target = y.id JOIN rules ON s = x.prefix AND t = y.prefix)
SELECT source, target, rule, coalesce(allowed, true) AS allowed FROM e LEFT JOIN (SELECT * FROM hits WHERE k = 1) h USING (source, target)""")
def contract_rules(spark, sf_dir):
    return contracts.decided(uses(spark, sf_dir), rules(spark, sf_dir))


LAYERS = f"""
layers AS (
  SELECT DISTINCT c_mktsegment AS layer, c_mktsegment AS pattern, list_position({list(SEGMENTS)}, c_mktsegment) - 1 AS rank FROM customer
  UNION ALL SELECT 'deep', 'BUILDING/n' || n_nationkey, 5 FROM nation WHERE n_regionkey = 2),
layered AS (SELECT id, layer, rank FROM (SELECT id, layer, rank, row_number() OVER (PARTITION BY id ORDER BY depth DESC, layer) AS k FROM prefixes JOIN layers ON prefix = pattern) WHERE k = 1)"""


@query("contract_layers", f"""
WITH {USES}, {PREFIXES}, {LAYERS},
e AS (SELECT DISTINCT source, target, x.layer AS source_layer, y.layer AS target_layer, y.rank - x.rank AS down FROM refers JOIN layered x ON source = x.id JOIN layered y ON target = y.id WHERE source <> target)
SELECT source, target, source_layer, target_layer, CASE WHEN down < 0 THEN 'upward' ELSE 'skips' END AS code FROM e WHERE down < 0 OR down > 1""")
def contract_layers(spark, sf_dir):
    rank = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")).cast("int") - 1
    top = b.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("layer"), F.col("c_mktsegment").alias("pattern"), rank.alias("rank")).distinct()
    deep = b.table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.lit("deep").alias("layer"), F.concat(F.lit("BUILDING/n"), F.col("n_nationkey").cast("string")).alias("pattern"), F.lit(5).alias("rank"))
    return contracts.layer_breaks(uses(spark, sf_dir), top.unionByName(deep), closed=True)


@query("contract_paths", f"""
WITH RECURSIVE {USES}, {UNITS}, {PREFIXES},
paths AS (SELECT 'path-' || n_nationkey AS rule, 'HOUSEHOLD' AS s, 'FURNITURE/n' || n_nationkey AS t FROM nation WHERE n_regionkey = 0
          UNION ALL SELECT 'all-' || n_nationkey, '', 'BUILDING/n' || n_nationkey FROM nation WHERE n_regionkey = 3),
linked AS (SELECT source AS id FROM refers WHERE source <> target UNION SELECT target FROM refers WHERE source <> target),
goals AS (SELECT rule, p.id, unit FROM paths JOIN prefixes p ON prefix = t JOIN linked USING (id) JOIN units USING (id)),
walk AS (SELECT rule, unit, 0 AS hop FROM goals UNION SELECT rule, a, hop + 1 FROM walk JOIN links ON b = unit),
least AS (SELECT rule, unit, min(hop) AS hop FROM walk GROUP BY ALL),
via AS (SELECT o.rule, o.unit, min(e) AS e FROM least o JOIN links ON a = o.unit JOIN least p ON p.rule = o.rule AND p.unit = b AND p.hop = o.hop - 1 GROUP BY ALL),
own AS (SELECT rule, p.id, unit FROM paths JOIN prefixes p ON prefix = s JOIN linked USING (id) JOIN units USING (id)),
inner_edges AS (SELECT source, min(target) AS target FROM refers JOIN units u ON source = u.id JOIN units v ON target = v.id WHERE u.unit = v.unit AND source <> target GROUP BY source)
SELECT o.rule, o.id, hop AS hops, e[1] AS via_source, e[2] AS via_target FROM own o JOIN least USING (rule, unit) JOIN via USING (rule, unit) WHERE hop > 0
UNION ALL SELECT DISTINCT o.rule, o.id, 0, source, target FROM own o JOIN inner_edges ON source = o.id JOIN goals g ON g.rule = o.rule AND g.unit = o.unit AND g.id <> o.id""")
def contract_paths(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n"), "n_regionkey")
    named = lambda head: F.concat(F.lit(head), F.col("n"))
    some = n.where("n_regionkey = 0").select(named("path-").alias("rule"), F.lit("HOUSEHOLD").alias("source"), named("FURNITURE/n").alias("target"))
    every = n.where("n_regionkey = 3").select(named("all-").alias("rule"), F.lit("").alias("source"), named("BUILDING/n").alias("target"))
    return contracts.forbidden_paths(uses(spark, sf_dir), some.unionByName(every))


@query("package_rollup", f"""
WITH {USES},
cut AS (SELECT k AS depth, array_to_string(string_split(source, '/')[1:k], '/') AS a, array_to_string(string_split(target, '/')[1:k], '/') AS b, kind FROM refers, (VALUES (1), (2), (3)) v(k))
SELECT depth, a AS source, b AS target, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n_raw FROM cut WHERE a <> b GROUP BY ALL""")
def package_rollup(spark, sf_dir):
    return graph.rolled_up(uses(spark, sf_dir)).withColumn("kinds", F.array_join("kinds", ","))


ARRANGED = f"""
WITH RECURSIVE {USES}, {UNITS},
way AS (SELECT DISTINCT unit, 0 AS layer FROM units WHERE unit NOT IN (SELECT b FROM links) UNION SELECT b, layer + 1 FROM way JOIN links ON a = unit),
nodes AS (SELECT id, unit, layer FROM units JOIN (SELECT unit, max(layer) AS layer FROM way GROUP BY unit) USING (unit)),
into_ AS (SELECT DISTINCT source, v.unit FROM refers JOIN units u ON source = u.id JOIN units v ON target = v.id WHERE u.unit <> v.unit),
arranged AS (
  SELECT id, unit, layer, row_number() OVER (ORDER BY unit, id) AS place FROM nodes WHERE layer = 0
  UNION ALL
  SELECT id, unit, layer, row_number() OVER (ORDER BY mean, unit, id)
  FROM (SELECT n.id, n.unit, n.layer, avg(p.place) AS mean FROM arranged p JOIN into_ i ON i.source = p.id JOIN nodes n ON n.unit = i.unit AND n.layer = p.layer + 1 GROUP BY n.id, n.unit, n.layer))"""


def _arranged(spark, sf_dir):
    return diagram.arranged(sites(spark, sf_dir).select(F.col("path").alias("id")), uses(spark, sf_dir))


@query("k5_layers", f"{ARRANGED} SELECT id, unit, layer, CAST(place AS BIGINT) AS place FROM arranged")
def k5_layers(spark, sf_dir):
    return _arranged(spark, sf_dir)


@query("k5_drawing", f"""{ARRANGED}, spots AS (SELECT *, (place - 1) * 180 + 20 AS x, layer * 100 + 20 AS y FROM arranged)
SELECT '<svg xmlns="http://www.w3.org/2000/svg" width="' || (max(place) * 180 + 20) || '" height="' || ((max(layer) + 1) * 100 + 20) || '">' AS text FROM spots UNION ALL SELECT '</svg>'
UNION ALL SELECT '<path class="edge" d="M' || (a.x + 80) || ' ' || (a.y + 40) || ' L' || (b.x + 80) || ' ' || b.y || '"/>' FROM (SELECT DISTINCT source, target FROM refers WHERE source <> target) JOIN spots a ON source = a.id JOIN spots b ON target = b.id
UNION ALL SELECT '<g class="node"><rect x="' || x || '" y="' || y || '" width="160" height="40"/><text x="' || (x + 80) || '" y="' || (y + 20) || '">' || id || '</text></g>' FROM spots""")
def k5_drawing(spark, sf_dir):
    """The drawing, written in its order by the executors and read again."""
    folder = fresh_folder(spark, "drawing")
    sinks.write_drawing(diagram.drawn(_arranged(spark, sf_dir), uses(spark, sf_dir)), folder)
    return spark.read.text(folder).withColumnRenamed("value", "text")
