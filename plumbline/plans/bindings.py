"""The engine's input frames, taken from whole tables: the same operators run on these as on facts of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges: market segment -> supplier, the part's brand as port, return flag as kind, line number as line."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "R", "import").when(F.col("l_returnflag") == "A", "from_import").otherwise("call")
    return rows.select(F.col("c_mktsegment").alias("source"), F.col("s_name").alias("target"), F.col("p_brand").alias("targetPort"), kind.alias("kind"), F.col("l_linenumber").alias("line"), F.lit(0).alias("stage"), F.col("l_orderkey").alias("seq"))


COMMERCE = """
commerce AS (
  SELECT c_mktsegment AS source, s_name AS target, p_brand AS targetPort,
         CASE l_returnflag WHEN 'R' THEN 'import' WHEN 'A' THEN 'from_import' ELSE 'call' END AS kind,
         l_linenumber AS line, l_orderkey AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair edges between customers: of each, his dearest order (the later of equal ones) refers to the customer whose
    place is the order's number, counted around. kinds is the order's status; n_raw the number of his orders."""
    customers = table(spark, sf_dir, "customer").count()
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", "o_orderkey", "o_orderstatus")).alias("o"), F.count(F.lit(1)).alias("n_raw"))
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    return last.select(name(F.col("o_custkey")).alias("source"), name(F.col("o.o_orderkey") % F.lit(max(customers, 1))).alias("target"), F.array("o.o_orderstatus").alias("kinds"), "n_raw")


REFERRALS = """
dear AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n_raw FROM orders),
refers AS (SELECT 'c' || o_custkey AS source, 'c' || o_orderkey % (SELECT count(*) FROM customer) AS target, o_orderstatus AS kinds, n_raw FROM dear WHERE nth = 1),
people AS (SELECT 'c' || c_custkey AS id, c_mktsegment = 'BUILDING' AS far FROM customer)"""

#: Every node that a node reaches.
REACH = """
reach AS (
  SELECT source AS a, target AS b FROM refers
  UNION SELECT r.a, t.target FROM reach r JOIN refers t ON r.b = t.source),
members AS (
  SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a
  WHERE x.a <> x.b GROUP BY x.a)"""


def people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as nodes, and those of one market segment, which count as external where a query says so."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("far"))
    return rows.select("id", "far"), rows.where("far").select("id")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").cast("string").alias("group_id"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: host and path of the url, a trailing slash standing for an __init__.py."""
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.when(path.endswith("/"), F.concat(path, F.lit("__init__.py"))).otherwise(F.concat(path, F.lit(".py"))).alias("module_id"))


PAGES = """
paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages),
files AS (SELECT page_id, CASE WHEN p LIKE '%/' THEN p || '__init__.py' ELSE p || '.py' END AS module_id FROM paths),
named AS (
  SELECT module_id, replace(CASE WHEN module_id LIKE '%\\_\\_init\\_\\_.py' ESCAPE '\\' THEN rtrim(regexp_replace(module_id, '__init__\\.py$', ''), '/')
         ELSE regexp_replace(module_id, '\\.py$', '') END, '/', '.') AS dotted
  FROM files),
idx AS (
  SELECT dotted, arg_min(module_id, (CASE WHEN module_id LIKE '%\\_\\_init\\_\\_.py' ESCAPE '\\' THEN '0' ELSE '1' END) || module_id) AS target
  FROM named WHERE dotted <> '' GROUP BY dotted)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python sources rendered from nation and region: one file for each; every seventh nation's is broken."""
    region = table(spark, sf_dir, "region").select(F.format_string("regions/r%d.py", "r_regionkey").alias("module_id"), F.format_string(
        '"""Region."""\nclass Region_%1$d:\n    """A region. It has nations."""\n\ndef helper(x, y=2):\n    return Region_%1$d()\n', "r_regionkey").alias("content"))
    whole = (
        'import os\nimport json.decoder as jd\nimport acme_%2$d.tools\nfrom regions.r%2$d import Region_%2$d, helper as h\n\n'
        'def public_%1$d(a, b=1, *, c):\n    return Region_%2$d(h(a))\n\ndef _private(x):\n    return public_%1$d(x, 2, c=missing_%1$d)\n\n'
        'class Nation_%1$d(Region_%2$d):\n    pass\n\nvalue = _private(undefined_%1$d())\nacme_%2$d.run(jd)\n'
    )
    text = F.when(F.col("n_nationkey") % 7 == 6, F.lit("def broken(:\n")).otherwise(F.format_string(whole, "n_nationkey", "n_regionkey"))
    nation = table(spark, sf_dir, "nation").select(F.format_string("nations/n%d.py", "n_nationkey").alias("module_id"), text.alias("content"))
    return region.unionByName(nation)


RENDERED = """
n AS (SELECT n_nationkey AS k, n_regionkey AS r, 'nations/n' || n_nationkey || '.py' AS m FROM nation),
good AS (SELECT * FROM n WHERE k % 7 <> 6)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges between the types of a user's consecutive events, in order of time and id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("source"), F.lead("event_type").over(order).alias("target"))
    return rows.select("source", "target", F.lit(None).cast("string").alias("targetPort"), F.lit("call").alias("kind"), F.col("user_id").cast("int").alias("line"), F.lit(0).alias("stage"), F.col("event_id").alias("seq"))


TRANSITIONS = "steps AS (SELECT user_id, event_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events)"


def groupings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files: the grouping by source (the truth) and by lang (a candidate)."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "source", "lang")
    return docs.select(F.col("source").alias("group_id"), "file"), docs.select(F.col("lang").alias("group_id"), "file")
