"""Queries of the engine's operators over whole tables, and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.names import NOISE
from ..operators import digest, findings, graph, grouping, layout, resolve
from ..sources.store import settled
from . import bindings as b
from . import baseline_queries, corpus_queries, impact_queries, language_queries, resolution_queries, scope_queries, shape_queries  # noqa: F401  register their own
from .registry import QUERIES, SQL, query  # noqa: F401
from .scan import scan_files

def text(array):
    return F.array_join(array, ",")


@query("s7_module_index", f"WITH {b.PAGES} SELECT dotted, target FROM idx")
def module_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.module_index(b.page_files(spark, sf_dir))


@query("j2_longest_prefix", f"""
WITH {b.PAGES},
asked AS (SELECT DISTINCT dotted || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.part.deep' ELSE 'x' END AS name FROM named JOIN files USING (module_id)),
hits AS (SELECT name, target, dotted FROM asked JOIN idx ON name = dotted OR starts_with(name, dotted || '.'))
SELECT name, arg_max(target, length(dotted)) AS target, max(length(dotted)) = length(name) AS exact FROM hits GROUP BY name""")
def longest_prefix(spark, sf_dir):
    files = b.page_files(spark, sf_dir)
    tail = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, ".part.deep").otherwise("x")
    return resolve.longest_prefix(files.select(F.concat(paths.dotted(F.col("module_id")), tail).alias("n")), "n", resolve.module_index(files))


@query("j3_classify", f"""
WITH {b.PAGES},
asked AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN dotted WHEN 1 THEN 'os' WHEN 2 THEN 'os.path' ELSE 'lib' || page_id END AS name FROM named JOIN files USING (module_id)),
one AS (SELECT DISTINCT page_id, name FROM asked)
SELECT page_id, name, target AS at, CASE WHEN target IS NOT NULL THEN 'local' WHEN name = 'os' THEN 'stdlib' ELSE 'third_party' END AS cls
FROM one LEFT JOIN idx ON name = dotted""")
def classify(spark, sf_dir):
    files = b.page_files(spark, sf_dir)
    k = F.col("page_id") % 4
    name = F.when(k == 0, paths.dotted(F.col("module_id"))).when(k == 1, "os").when(k == 2, "os.path").otherwise(F.concat(F.lit("lib"), F.col("page_id").cast("string")))
    return resolve.classified(files.select("page_id", name.alias("name")), "name", resolve.module_index(files), ("os", "sys")).select("page_id", "name", "at", "cls")


@query("p2_relative_targets", f"""
WITH {b.PAGES},
d AS (SELECT page_id, page_id % 5 AS level, CASE WHEN page_id % 3 > 0 THEN 'm' || page_id END AS module,
             list_slice(string_split(module_id, '/'), 1, len(string_split(module_id, '/')) - 1) AS dirs FROM files),
e AS (SELECT page_id, level, module, array_to_string(dirs, '.') AS base FROM d),
f AS (SELECT page_id, level, module, base, array_to_string(list_slice(string_split(base, '.'), 1, greatest(len(string_split(base, '.')) - (level - 1), 0)), '.') AS kept FROM e)
SELECT page_id, CASE WHEN level = 0 THEN module WHEN module IS NULL THEN kept WHEN kept = '' THEN module ELSE kept || '.' || module END AS target FROM f""")
def relative_targets(spark, sf_dir):
    files = b.page_files(spark, sf_dir)
    module = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("m"), F.col("page_id").cast("string")))
    return files.select("page_id", paths.absolute(module, (F.col("page_id") % 5).cast("int"), paths.directory(F.col("module_id"))).alias("target"))


@query("r3_symbol_table", """
WITH i AS (
  SELECT o_custkey, o_orderkey AS seq, o_orderkey % 3 = 0 AS plain, 'n' || o_orderkey % 4 AS leaf, 'p' || o_orderkey % 5 AS pkg,
         CASE WHEN o_orderkey % 2 = 0 THEN 'a' || o_orderkey % 3 END AS alias FROM orders),
j AS (SELECT o_custkey, seq, plain, CASE WHEN plain THEN pkg || '.' || leaf ELSE leaf END AS name, pkg, leaf, alias FROM i),
k AS (
  SELECT o_custkey, seq, coalesce(alias, name) AS key, true AS firm, CASE WHEN plain THEN name ELSE pkg END AS em, CASE WHEN plain THEN NULL ELSE leaf END AS ep FROM j
  UNION ALL SELECT o_custkey, seq, pkg, false, name, NULL FROM j WHERE plain AND pkg <> coalesce(alias, name)),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, key ORDER BY firm DESC, CASE WHEN firm THEN -seq ELSE seq END) AS n FROM k)
SELECT CAST(o_custkey AS VARCHAR) AS module_id, key, em AS entry_module, ep AS entry_port FROM r WHERE n = 1""")
def symbol_table(spark, sf_dir):
    o = F.col("o_orderkey")
    leaf, pkg = F.concat(F.lit("n"), (o % 4).cast("string")), F.concat(F.lit("p"), (o % 5).cast("string"))
    plain = o % 3 == 0
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("module_id"), o.alias("seq"), F.when(plain, "import").otherwise("from_import").alias("kind"), F.when(plain, F.concat(pkg, F.lit("."), leaf)).otherwise(leaf).alias("name"),
        F.when(o % 2 == 0, F.concat(F.lit("a"), (o % 3).cast("string"))).alias("alias"), pkg.alias("target"), F.lit("").alias("sub"), F.lit(None).cast("string").alias("sub_at"),
    )
    return resolve.symbol_table(rows)


@query("a1_merge_edges", f"""
WITH {b.COMMERCE}
SELECT source, target, targetPort, kind, array_to_string(list_sort(list(DISTINCT line)), ',') AS sites, min(seq) AS first_seq FROM commerce GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY source, target, targetPort, kind"))
def merge_edges(spark, sf_dir):
    return graph.merge_edges(b.commerce(spark, sf_dir)).select("source", "target", "targetPort", "kind", text(F.transform("sites", lambda x: x.cast("string"))).alias("sites"), F.col("first.seq").alias("first_seq"))


@query("a2_externals", f"WITH {b.COMMERCE} SELECT DISTINCT targetPort AS id, targetPort AS name, 'third_party' AS kind FROM commerce")
def externals(spark, sf_dir):
    return graph.distinct_externals(b.commerce(spark, sf_dir), "targetPort")


@query("a3_first_diagnostic", """
SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS moduleId, CAST(floor(value) AS INTEGER) AS line, arg_min(props, event_id) AS message
FROM events GROUP BY event_type, user_id, floor(value)""")
def first_diagnostic(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("moduleId"), F.floor("value").cast("int").alias("line"), F.col("props").alias("message"), F.lit(resolve.DYNAMIC).alias("stage"), F.col("event_id").alias("seq")
    )
    return resolve.first_diagnostics(rows).select("kind", "moduleId", "line", "message")


@query("r7_star_notes", """
WITH d AS (SELECT DISTINCT n_name AS m, s_name AS u FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT m, list_sort(list(u)) AS names FROM d GROUP BY m)
SELECT 'star_import_unresolved' AS kind, n_name AS moduleId, CAST(n_nationkey AS INTEGER) AS line,
  len(names) || ' unresolved symbol(s) in this module may come from star import of ''' || r_name || ''' (e.g. '''
  || array_to_string(list_slice(names, 1, 5), ''', ''') || '''' || CASE WHEN len(names) > 5 THEN ' (+' || (len(names) - 5) || ' more)' ELSE '' END || '); per-site diagnostics aggregated' AS message
FROM nation JOIN region ON n_regionkey = r_regionkey JOIN g ON m = n_name""")
def star_notes(spark, sf_dir):
    nation, region = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "region")
    stars = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("module_id"), F.lit("from_import").alias("kind"), F.lit("*").alias("name"), F.col("r_name").alias("module"), F.col("r_name").alias("target"), F.col("n_nationkey").alias("line"), F.lit(0).alias("seq"))
    lost = b.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("module_id"), F.col("s_name").alias("unresolved"))
    return resolve.star_notes(stars, lost).select("kind", "moduleId", "line", "message")


@query("a12_pair_edges", f"WITH {b.COMMERCE} SELECT source, target, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n_raw FROM commerce GROUP BY source, target")
def pair_edges(spark, sf_dir):
    return graph.pair_edges(b.commerce(spark, sf_dir)).withColumn("kinds", text("kinds"))


@query("a13_degrees", f"""
WITH {b.REFERRALS}, inward AS (SELECT target, count(*) AS n FROM refers WHERE source <> target GROUP BY target),
outward AS (SELECT source, count(*) AS n, count(*) FILTER (far) AS x FROM refers JOIN people ON target = id WHERE source <> target GROUP BY source)
SELECT id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(o.x, 0) AS n_external FROM people LEFT JOIN inward i ON i.target = id LEFT JOIN outward o ON o.source = id""")
def degrees(spark, sf_dir):
    nodes, far = b.people(spark, sf_dir)
    return graph.degrees(nodes, b.referrals(spark, sf_dir), far)


@query("p9_dangling", f"WITH {b.COMMERCE} SELECT source, target, targetPort, kind, line, seq FROM commerce WHERE target IN (SELECT s_name FROM supplier WHERE s_acctbal > 0)")
def dangling(spark, sf_dir):
    known = b.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_name").alias("id")).unionByName(b.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("id")))
    return graph.without_dangling(b.commerce(spark, sf_dir), known).drop("stage")


@query("p8_production", f"WITH {b.PAGES} SELECT page_id, module_id FROM files WHERE module_id NOT LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\' AND NOT list_contains(string_split(module_id, '/'), 'de')")
def production(spark, sf_dir):
    return graph.production(b.page_files(spark, sf_dir), "module_id", (*NOISE, "de"))


@query("a8_transitions", f"WITH {b.TRANSITIONS} SELECT source, target, count(*) AS n_raw FROM steps WHERE target IS NOT NULL AND source <> target GROUP BY source, target")
def transitions(spark, sf_dir):
    return graph.pair_edges(graph.inner(b.transitions(spark, sf_dir))).drop("kinds")


@query("l5_transition_sites", f"""
WITH {b.TRANSITIONS}
SELECT source, target, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS sites FROM steps WHERE target IS NOT NULL AND source <> target GROUP BY source, target""")
def transition_sites(spark, sf_dir):
    return graph.merge_edges(graph.inner(b.transitions(spark, sf_dir))).select("source", "target", text(F.transform("sites", lambda x: x.cast("string"))).alias("sites"))


@query("a11_depth_scores", """
WITH p AS (SELECT l_orderkey, count(*) AS n, max(CAST(l_quantity AS INTEGER) * l_linenumber) AS last FROM lineitem GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS id, coalesce(n, 0) AS n_ports, round(coalesce(last / n, 0), 6) AS ratio,
       CASE WHEN last / n >= 50 THEN 'deep' WHEN last / n >= 15 THEN 'moderate' ELSE 'shallow' END AS depth,
       CASE WHEN last / n >= 50 THEN 'green' WHEN last / n >= 15 THEN 'yellow' ELSE 'red' END AS light
FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def depth_scores(spark, sf_dir):
    ports = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("moduleId"), (F.col("l_quantity").cast("int") * F.col("l_linenumber")).alias("line"))
    out = findings.depth_scores(b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id")), ports)
    return out.withColumns({"ratio": F.round("ratio", 6), "light": findings.traffic_light(F.col("depth"))})


@query("g1_components", f"WITH RECURSIVE {b.REFERRALS}, {b.REACH} SELECT component, id FROM members")
def components(spark, sf_dir):
    return findings.strong_components(b.referrals(spark, sf_dir))


@query("g1_components_in_rounds", f"WITH RECURSIVE {b.REFERRALS}, {b.REACH} SELECT component, id FROM members")
def components_in_rounds(spark, sf_dir):
    """The way of graphs too large for one task."""
    return findings.strong_components(b.referrals(spark, sf_dir), small=0)


@query("g2_cycles", f"""
WITH RECURSIVE {b.REFERRALS}, {b.REACH}
SELECT s.component, string_agg(DISTINCT s.id, ',' ORDER BY s.id) AS members,
       (SELECT string_agg(source || '->' || target, ',' ORDER BY source || '->' || target) FROM refers JOIN members x ON source = x.id JOIN members y ON target = y.id WHERE x.component = y.component AND x.component = s.component AND source <> target) AS evidence
FROM members s GROUP BY s.component""")
def cycles(spark, sf_dir):
    pairs = b.referrals(spark, sf_dir)
    return findings.cycle_findings(pairs, findings.strong_components(pairs)).select("component", text("members").alias("members"), text("evidence").alias("evidence"))


@query("g2_cycle_edges", f"WITH RECURSIVE {b.REFERRALS}, {b.REACH} SELECT x.component, source, target FROM refers JOIN members x ON source = x.id JOIN members y ON target = y.id WHERE x.component = y.component AND source <> target")
def cycle_edges(spark, sf_dir):
    pairs = b.referrals(spark, sf_dir)
    return findings.cycle_edges(pairs, findings.strong_components(pairs))


TRIAGE = """
own AS (SELECT source, target FROM refers JOIN people x ON source = x.id JOIN people y ON target = y.id WHERE NOT x.far AND NOT y.far AND source <> target),
triage AS (
  SELECT id, CASE WHEN id IN (SELECT source FROM own UNION SELECT target FROM own) THEN 'normal'
                  WHEN id IN (SELECT source FROM refers JOIN people y ON target = y.id WHERE y.far) THEN 'third_party_only' ELSE 'isolated' END AS triage FROM people WHERE NOT far)"""


@query("g3_orphan_triage", f"WITH {b.REFERRALS}, {TRIAGE} SELECT id, triage FROM triage")
def triage(spark, sf_dir):
    nodes, far = b.people(spark, sf_dir)
    return findings.orphan_triage(nodes.where("not far"), b.referrals(spark, sf_dir), far)


@query("g4_findings", f"""
WITH RECURSIVE {b.REFERRALS.replace("refers AS", "every AS")}, refers AS (SELECT e.* FROM every e JOIN people x ON source = x.id JOIN people y ON target = y.id WHERE NOT x.far AND NOT y.far), {b.REACH},
orphan AS (SELECT id, CASE WHEN id IN (SELECT source FROM every JOIN people y ON target = y.id WHERE y.far) THEN 'third_party_only' ELSE 'isolated' END AS code
           FROM people WHERE NOT far AND id NOT IN (SELECT source FROM refers WHERE source <> target UNION SELECT target FROM refers WHERE source <> target))
SELECT 'cycle' AS code, 'error' AS severity, string_agg(id, ', ' ORDER BY id) AS subject FROM members GROUP BY component
UNION ALL SELECT code, 'warning', id FROM orphan""")
def all_findings(spark, sf_dir):
    nodes, far = b.people(spark, sf_dir)
    return findings.findings(nodes.where("not far"), b.referrals(spark, sf_dir), far).select("code", "severity", "subject")


@query("a17_finding_counts", f"WITH {b.REFERRALS}, {TRIAGE} SELECT triage AS code, count(*) AS n FROM triage GROUP BY triage")
def counts(spark, sf_dir):
    return findings.finding_counts(triage(spark, sf_dir).withColumnRenamed("triage", "code"))


#: Every order proposes the edge of its own number, and every third the opposite one.
CHECKED = """
orders_of AS (SELECT o_orderkey AS o, 'c' || o_custkey AS a, 'c' || o_orderkey % (SELECT count(*) FROM customer) AS b FROM orders),
ask AS (SELECT a AS source, b AS target FROM orders_of UNION SELECT b, a FROM orders_of WHERE o % 3 = 0)"""


def _proposed(spark, sf_dir):
    n = b.table(spark, sf_dir, "customer").count()
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    rows = b.table(spark, sf_dir, "orders").select("o_orderkey", name(F.col("o_custkey")).alias("source"), name(F.col("o_orderkey") % F.lit(max(n, 1))).alias("target"))
    back = rows.where("o_orderkey % 3 = 0").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return rows.select("source", "target").unionByName(back)


@query("g6_check_edges", f"""
WITH {b.REFERRALS}, {CHECKED},
c AS (
  SELECT a.source, a.target, CASE WHEN a.source = a.target OR p.far THEN 'blocked'
         WHEN f.source IS NOT NULL THEN 'real' WHEN r.source IS NOT NULL THEN 'reversed' ELSE 'none' END AS code, f.kinds AS fk, r.kinds AS rk
  FROM ask a JOIN people p ON p.id = a.source LEFT JOIN refers f ON f.source = a.source AND f.target = a.target LEFT JOIN refers r ON r.source = a.target AND r.target = a.source)
SELECT source, target, code = 'real' AS ok, code, CASE code WHEN 'real' THEN 'info' WHEN 'reversed' THEN 'warning' ELSE 'error' END AS severity,
       CASE code WHEN 'real' THEN fk WHEN 'reversed' THEN rk END AS evidence, CASE code WHEN 'real' THEN '' WHEN 'reversed' THEN 'swap,remove' ELSE 'remove' END AS fixes FROM c""")
def check_edges(spark, sf_dir):
    out = graph.check_edges(_proposed(spark, sf_dir), b.referrals(spark, sf_dir), b.people(spark, sf_dir)[1])
    return out.withColumns({"evidence": text("evidence"), "fixes": text("fixes")})


@query("g7_real_only", f"WITH {b.REFERRALS}, {CHECKED} SELECT source, target FROM ask WHERE (source, target) IN (SELECT source, target FROM refers)")
def real_only(spark, sf_dir):
    return graph.real_only(_proposed(spark, sf_dir), b.referrals(spark, sf_dir))


@query("g8_quotient", """
WITH e AS (
  SELECT x.n_regionkey AS a, y.n_regionkey AS b, l_returnflag AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation x ON c_nationkey = x.n_nationkey JOIN nation y ON s_nationkey = y.n_nationkey)
SELECT CAST(a AS VARCHAR) AS source, CAST(b AS VARCHAR) AS target, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n_raw FROM e WHERE a <> b GROUP BY a, b""")
def quotient(spark, sf_dir):
    t = lambda n: b.table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.col("l_returnflag").alias("kind"))
    atoms = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file"), F.col("c_nationkey").alias("group_id")).unionByName(t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file"), F.col("s_nationkey").alias("group_id")))
    containers = t("nation").select(F.col("n_nationkey").alias("file"), F.col("n_regionkey").cast("string").alias("group_id"))
    return graph.quotient(rows, atoms, containers).withColumn("kinds", text("kinds"))


@query("g10_facades", f"""
WITH {b.COMMERCE},
e AS (SELECT source, CASE WHEN line % 2 = 0 THEN target || '/__init__.py' ELSE target END AS target, targetPort, 'from_import' AS kind FROM commerce
      UNION ALL SELECT target || '/__init__.py', 'impl/' || seq % 7, targetPort, 'from_import' FROM commerce WHERE line = 1),
h AS (SELECT source AS s, targetPort AS p, min(target) AS t FROM e WHERE source LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\' GROUP BY source, targetPort)
SELECT source, coalesce(t, target) AS target, targetPort, count(*) AS n FROM e LEFT JOIN h ON target = s AND targetPort = p GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY source, coalesce(t, target), targetPort"))
def facades(spark, sf_dir):
    rows = b.commerce(spark, sf_dir)
    init = F.concat("target", F.lit("/__init__.py"))
    uses = rows.select("source", F.when(F.col("line") % 2 == 0, init).otherwise(F.col("target")).alias("target"), "targetPort", F.lit("from_import").alias("kind"))
    own = rows.where("line = 1").select(init.alias("source"), F.concat(F.lit("impl/"), (F.col("seq") % 7).cast("string")).alias("target"), "targetPort", F.lit("from_import").alias("kind"))
    return graph.through_facades(uses.unionByName(own)).groupBy("source", "target", "targetPort").agg(F.count(F.lit(1)).alias("n"))


@query("a19_collapse_external", f"""
WITH {b.REFERRALS}
SELECT source, CASE WHEN far THEN 'third-party' ELSE target END AS target, coalesce(string_agg(DISTINCT CASE WHEN far THEN target END, ',' ORDER BY CASE WHEN far THEN target END), '') AS members
FROM refers JOIN people ON target = id GROUP BY source, CASE WHEN far THEN 'third-party' ELSE target END""")
def collapse(spark, sf_dir):
    return graph.collapse_external(b.referrals(spark, sf_dir), b.people(spark, sf_dir)[1]).withColumn("members", text("members"))


GROUPED = """
d AS (SELECT 'd' || doc_id AS file, source, lang FROM documents),
o AS (SELECT source, lang, count(*) AS n FROM d GROUP BY source, lang),
best AS (SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM o) WHERE k = 1)"""


@query("j13_best_matches", f"WITH {GROUPED} SELECT source AS truth_group, lang AS candidate_group, n AS overlap FROM best")
def best_matches(spark, sf_dir):
    return grouping.best_matches(*b.groupings(spark, sf_dir))


@query("u4_placed_files", f"WITH {GROUPED} SELECT file, d.source AS truth_group, d.lang AS candidate_group, CASE WHEN d.lang = best.lang THEN 'correct' ELSE 'wrong' END AS verdict FROM d JOIN best USING (source)")
def placed_files(spark, sf_dir):
    return grouping.placed_files(*b.groupings(spark, sf_dir))


@query("a15_accuracy", f"""
WITH {GROUPED}, t AS (SELECT file, source FROM d WHERE substr(file, 2) <> '3'), c AS (SELECT file, lang FROM d WHERE substr(file, 2) <> '5'),
oo AS (SELECT source, lang, count(*) AS n FROM t JOIN c USING (file) GROUP BY source, lang),
bb AS (SELECT source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM oo) WHERE k = 1),
p AS (SELECT t.source AS ts, c.lang AS cl, bb.lang AS bl FROM t FULL JOIN c USING (file) LEFT JOIN bb ON bb.source = t.source)
SELECT count(ts) AS n_truth, count(*) FILTER (cl = bl) AS n_correct, count(*) FILTER (ts IS NOT NULL AND cl IS NULL) AS n_missed, count(*) FILTER (ts IS NULL) AS n_extra,
       round(count(*) FILTER (cl = bl) / count(ts), 9) AS accuracy FROM p""")
def accuracy(spark, sf_dir):
    truth, candidate = b.groupings(spark, sf_dir)
    return grouping.accuracy(grouping.placed_files(truth.where("file <> 'd3'"), candidate.where("file <> 'd5'"))).withColumn("accuracy", F.round("accuracy", 9))


def _manifest(spark, sf_dir):
    _, by_lang = b.groupings(spark, sf_dir)
    toxic = b.table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit("toxic").alias("group_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"))
    far = b.table(spark, sf_dir, "embeddings").select(F.lit("vectors").alias("group_id"), F.concat(F.lit("tests/v"), F.col("vec_id").cast("string")).alias("file"))
    none = b.table(spark, sf_dir, "region").select(F.col("r_name").alias("group_id"), F.lit(None).cast("string").alias("file"))
    return by_lang.where("group_id <> 'es'").unionByName(toxic).unionByName(far).unionByName(none)


MANIFEST = """
d AS (SELECT 'd' || doc_id AS file, lang FROM documents),
m AS (SELECT lang AS g, file FROM d WHERE lang <> 'es' UNION ALL SELECT 'toxic', 'd' || doc_id FROM labels WHERE toxic = 1
      UNION ALL SELECT 'vectors', 'tests/v' || vec_id FROM embeddings),
h AS (SELECT DISTINCT g, file FROM m)"""


@query("x13_violations", f"""
WITH {MANIFEST}
SELECT 'empty_group' AS rule, r_name AS subject FROM region
UNION ALL SELECT 'shared_file', file FROM h GROUP BY file HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'unknown_file', file FROM h WHERE file NOT IN (SELECT file FROM d)
UNION ALL SELECT DISTINCT 'noise_file', file FROM h WHERE file LIKE 'tests/%'
UNION ALL SELECT DISTINCT 'uncovered_file', file FROM d WHERE file NOT IN (SELECT file FROM h)""")
def violations(spark, sf_dir):
    return grouping.violations(_manifest(spark, sf_dir), b.groupings(spark, sf_dir)[0])


@query("a14_coverage", f"WITH {MANIFEST} SELECT d.file, count(g) AS n_groups FROM d LEFT JOIN h USING (file) GROUP BY d.file HAVING count(g) <> 1")
def coverage(spark, sf_dir):
    return grouping.coverage(_manifest(spark, sf_dir), b.groupings(spark, sf_dir)[0])


@query("a18_unassigned", f"WITH {MANIFEST} SELECT file FROM d WHERE file NOT IN (SELECT file FROM h)")
def unassigned(spark, sf_dir):
    return grouping.unassigned(b.groupings(spark, sf_dir)[0], _manifest(spark, sf_dir).where("file is not null"))


@query("a16_group_depth", """
WITH p AS (SELECT l_suppkey, count(*) AS n, max(l_linenumber * CAST(l_quantity AS INTEGER)) AS last FROM lineitem GROUP BY l_suppkey)
SELECT CAST(s_nationkey AS VARCHAR) AS group_id, CAST(sum(n) AS BIGINT) AS n_ports, round(sum(last) / sum(n), 6) AS ratio FROM supplier JOIN p ON s_suppkey = l_suppkey GROUP BY s_nationkey""")
def group_depth(spark, sf_dir):
    ports = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("moduleId"), (F.col("l_linenumber") * F.col("l_quantity").cast("int")).alias("line"))
    groups = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("group_id"), F.col("s_suppkey").cast("string").alias("file"))
    return grouping.group_depth(ports, groups).withColumn("ratio", F.round("ratio", 6))


@query("l9_within_budget", """
WITH e AS (SELECT conv_id || '/' || lpad(CAST(turn AS VARCHAR), 6, '0') AS id, length(text) AS size FROM conversations),
r AS (SELECT id, size, CAST(sum(size) OVER (ORDER BY size, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM e)
SELECT id, size, running, running <= 40000 AS kept FROM r""")
def within_budget(spark, sf_dir):
    rows = b.table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"), F.length("text").cast("long").alias("size"))
    return digest.within_budget(rows, digest.BUDGETS[1])


@query("x10_import_lists", f"WITH {b.COMMERCE} SELECT source AS id, string_agg(DISTINCT target, ',' ORDER BY target) AS imports FROM commerce WHERE kind IN ('import', 'from_import') GROUP BY source")
def import_lists(spark, sf_dir):
    return digest.import_lists(b.commerce(spark, sf_dir)).withColumn("imports", text("imports"))


@query("x8_node_ids", """
SELECT DISTINCT p AS id, array_to_string(list_transform(string_split(regexp_replace(p, '\\.[^./]*$', ''), '/'), lambda x: regexp_replace(ltrim(x, '_'), '[^A-Za-z0-9_]', '_', 'g')), '__') AS node
FROM (SELECT 'parts/_' || p_brand || '/' || p_name || '.v' || p_size AS p FROM part)""")
def node_ids(spark, sf_dir):
    path = F.concat(F.lit("parts/_"), "p_brand", F.lit("/"), "p_name", F.lit(".v"), F.col("p_size").cast("string"))
    return layout.node_ids(b.table(spark, sf_dir, "part").select(path.alias("id")))


@query("x8_collisions", """
WITH i AS (SELECT DISTINCT 'parts/_' || p_brand || '/' || p_name || '.v' || p_size AS p FROM part),
j AS (SELECT p, array_to_string(list_transform(string_split(regexp_replace(p, '\\.[^./]*$', ''), '/'), lambda x: regexp_replace(ltrim(x, '_'), '[^A-Za-z0-9_]', '_', 'g')), '__') AS node FROM i)
SELECT node, count(*) AS n, min(p) AS first FROM j GROUP BY node HAVING count(*) > 1""")
def collisions(spark, sf_dir):
    return layout.collisions(node_ids(spark, sf_dir))


@query("x12_grid", """
WITH r AS (SELECT n_name AS id, n_regionkey AS g, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS k FROM nation)
SELECT id, CAST(g AS VARCHAR) AS group_id, (k % 3) * 200 AS x, (k // 3) * 100 AS y FROM r""")
def grid(spark, sf_dir):
    return layout.grid(b.nations(spark, sf_dir), 3, "group_id")


def scanned(spark, sf_dir, table):
    """A table of the small sources' graph, settled, so that what the scan kept can be let go."""
    found = scan_files(b.sources(spark, sf_dir))
    try:
        return settled(found.tables()[table])
    finally:
        found.release()


@query("scan_modules", f"WITH {b.RENDERED} SELECT m AS id FROM good UNION ALL SELECT 'regions/r' || r_regionkey || '.py' FROM region")
def scan_modules(spark, sf_dir):
    return scanned(spark, sf_dir, "modules").select("id")


@query("scan_ports", f"""
WITH {b.RENDERED}
SELECT m AS moduleId, 'function' AS kind, 'public_' || k AS name, 6 AS line, '(a, b=1, *, c)' AS signature, 'a,b,c' AS params, NULL AS docstring FROM good
UNION ALL SELECT m, 'class', 'Nation_' || k, 12, 'Nation_' || k || '(Region_' || r || ')', '', NULL FROM good
UNION ALL SELECT 'regions/r' || r_regionkey || '.py', 'class', 'Region_' || r_regionkey, 2, 'Region_' || r_regionkey, '', 'A region.' FROM region
UNION ALL SELECT 'regions/r' || r_regionkey || '.py', 'function', 'helper', 5, '(x, y=2)', 'x,y', NULL FROM region""")
def scan_ports(spark, sf_dir):
    return scanned(spark, sf_dir, "ports").drop("seq").withColumn("params", text("params"))


@query("scan_edges", f"""
WITH {b.RENDERED}, e AS (SELECT m, r, 'regions/r' || r || '.py' AS t FROM good)
SELECT m AS source, 'json.decoder' AS target, NULL AS targetPort, 'import' AS kind, '2' AS sites FROM e
UNION ALL SELECT m, 'acme_' || r || '.tools', NULL, 'import', '3' FROM e
UNION ALL SELECT m, t, 'Region_' || r, 'from_import', '4' FROM e
UNION ALL SELECT m, t, 'helper', 'from_import', '4' FROM e
UNION ALL SELECT m, t, 'Region_' || r, 'call', '7' FROM e
UNION ALL SELECT m, t, 'helper', 'call', '7' FROM e
UNION ALL SELECT m, t, 'Region_' || r, 'inheritance', '12' FROM e
UNION ALL SELECT m, 'acme_' || r || '.tools', 'run', 'call', '16' FROM e""")
def scan_edges(spark, sf_dir):
    return scanned(spark, sf_dir, "edges").select("source", "target", "targetPort", "kind", text(F.transform("sites", lambda x: x.cast("string"))).alias("sites"))


@query("scan_externals", f"WITH {b.RENDERED} SELECT DISTINCT 'acme_' || r || '.tools' AS id FROM good UNION SELECT 'json.decoder' FROM good")
def scan_externals(spark, sf_dir):
    return scanned(spark, sf_dir, "externals").select("id")


@query("scan_diagnostics", f"""
WITH {b.RENDERED}
SELECT 'parse_error' AS kind, m AS moduleId, 1 AS line, 'syntax error: invalid syntax' AS message FROM n WHERE k % 7 = 6
UNION ALL SELECT 'unresolved_symbol', m, 15, 'unresolved symbol ''undefined_' || k || '''' FROM good""")
def scan_diagnostics(spark, sf_dir):
    return scanned(spark, sf_dir, "diagnostics").select("kind", "moduleId", "line", "message")


@query("scan_calls", f"""
WITH {b.RENDERED}
SELECT m AS module_id, '_private' AS src, 'public_' || k AS dst, 10 AS line FROM good
UNION ALL SELECT m, '<module>', '_private', 15 FROM good
UNION ALL SELECT 'regions/r' || r_regionkey || '.py', 'helper', 'Region_' || r_regionkey, 6 FROM region""")
def scan_calls(spark, sf_dir):
    return scanned(spark, sf_dir, "calls")


PORT = """'{"kind":"' || kind || '","name":"' || name || '"' """
LADDER = f"""
WITH {b.RENDERED},
p AS (
  SELECT m AS id, 'function' AS kind, 'public_' || k AS name, 6 AS line, '(a, b=1, *, c)' AS signature, '["a","b","c"]' AS params, '' AS doc FROM good
  UNION ALL SELECT m, 'class', 'Nation_' || k, 12, 'Nation_' || k || '(Region_' || r || ')', '[]', '' FROM good
  UNION ALL SELECT 'regions/r' || r_regionkey || '.py', 'class', 'Region_' || r_regionkey, 2, 'Region_' || r_regionkey, '[]', ',"docstring":"A region."' FROM region
  UNION ALL SELECT 'regions/r' || r_regionkey || '.py', 'function', 'helper', 5, '(x, y=2)', '["x","y"]', '' FROM region),
forms AS (
  SELECT id, line, name, {PORT} || ',"line":' || line || ',"signature":"' || signature || '","params":' || params || doc || '}}' AS f0,
         {PORT} || ',"line":' || line || ',"signature":"' || signature || '","params":' || params || '}}' AS f1, {PORT} || ',"line":' || line || ',"signature":"' || signature || '"}}' AS f2, {PORT} || '}}' AS f3 FROM p),
heads AS (
  SELECT m AS id, '{{"id":"' || m || '","imports":["acme_' || r || '.tools","json.decoder","regions/r' || r || '.py"],"ports":[' AS head FROM good
  UNION ALL SELECT 'regions/r' || r_regionkey || '.py', '{{"id":"regions/r' || r_regionkey || '.py","imports":[],"ports":[' FROM region),
bodies AS (
  SELECT id, head || string_agg(f0, ',' ORDER BY line, name) || ']}}' AS b0, head || string_agg(f1, ',' ORDER BY line, name) || ']}}' AS b1,
         head || string_agg(f2, ',' ORDER BY line, name) || ']}}' AS b2, head || string_agg(f3, ',' ORDER BY line, name) || ']}}' AS b3
  FROM forms JOIN heads USING (id) GROUP BY id, head),
fits AS (SELECT CASE WHEN sum(length(b0)) <= BUDGET THEN 0 WHEN sum(length(b1)) <= BUDGET THEN 1 WHEN sum(length(b2)) <= BUDGET THEN 2 ELSE 3 END AS level FROM bodies)
SELECT id, CASE level WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END AS body, level FROM bodies, fits
"""


def _ladder(spark, sf_dir, budget):
    found = scan_files(b.sources(spark, sf_dir))
    try:
        level, out = digest.ladder(found.modules, found.ports, found.edges, budget)
        return settled(out.withColumn("level", F.lit(level)))
    finally:
        found.release()


for _level, _budget in enumerate((12_000, 8_380, 7_800, 5_400)):
    query(f"x9_digest_{_level}", LADDER.replace("BUDGET", str(_budget)))(lambda spark, sf_dir, n=_budget: _ladder(spark, sf_dir, n))
