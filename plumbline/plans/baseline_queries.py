"""Queries of gradual enforcement over two states of the corpus; and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline
from ..sources.store import settled
from . import bindings as b
from . import corpus_queries as c
from .corpus import KINDS, corpus
from .registry import query
from .scan import scan_files


def _found(files):
    found = scan_files(files)
    try:
        return settled(baseline.fingerprints(found.diagnostics.select("kind", "moduleId", "line", "message")))
    finally:
        found.release()


def _later(spark, sf_dir):
    """The corpus some time later: every file has a line more on top, the customers' modules of one region are gone, and of
    another those that export names call one more that is nowhere."""
    n = b.table(spark, sf_dir, "nation").select(F.format_string("n%d", "n_nationkey").alias("__n"), F.col("n_regionkey").alias("__r"))
    every = corpus(spark, sf_dir)
    parts, k = F.split("module_id", "/"), F.regexp_extract("module_id", r"/c([0-9]+)[.]py$", 1)
    rows = every.join(n, parts[1] == F.col("__n"), "left").withColumn("__k", k)
    kept = rows.where("__k = '' or __r is null or __r <> 0")
    more = F.when((F.col("__k") != "") & (F.col("__k").cast("int") % KINDS == 3) & (F.col("__r") == 1), F.concat(F.lit("extra_"), "__k", F.lit("()\n"))).otherwise("")
    return kept.select("module_id", F.concat(F.encode(F.lit("\n"), "UTF-8"), "content", F.encode(more, "UTF-8")).alias("content"))


def _compared(spark, sf_dir):
    return baseline.compared(_found(_later(spark, sf_dir)), _found(corpus(spark, sf_dir)))


COMPARED = f"""
{c.NOTES},
r AS (SELECT m, v, k, n_regionkey AS r FROM c JOIN nation ON n = n_nationkey),
f AS (SELECT q.kind, q.m, q.line, q.message, coalesce(r.r, -1) AS r FROM q LEFT JOIN r USING (m)),
s AS (SELECT *, row_number() OVER (PARTITION BY kind, m, regexp_replace(message, '\\bline \\d+', 'line', 'g') ORDER BY line) AS nth FROM f),
t AS (
  SELECT kind, m AS moduleId, CASE WHEN r = 0 THEN line ELSE line + 1 END AS line, CASE WHEN r = 0 THEN message ELSE replace(message, '(line 1)', '(line 2)') END AS message, nth, CASE WHEN r = 0 THEN 'fixed' ELSE 'known' END AS status FROM s
  UNION ALL SELECT 'unresolved_symbol', m, 7, 'unresolved symbol ''extra_' || k || '''', 1, 'new' FROM r WHERE v = 3 AND r = 1)"""


@query("baseline_status", f"{COMPARED} SELECT sha256(kind || chr(10) || moduleId || chr(10) || regexp_replace(message, '\\bline \\d+', 'line', 'g') || chr(10) || nth) AS fingerprint, status, kind, moduleId, CAST(line AS INTEGER) AS line, message FROM t")
def baseline_status(spark, sf_dir):
    """Lines that move change nothing; findings of files that went are fixed; only a call that was put in is new."""
    return _compared(spark, sf_dir)


@query("baseline_verdict", f"""{COMPARED}
SELECT kind, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'known') AS n_known, count(*) FILTER (status = 'fixed') AS n_fixed,
       kind IN ('unresolved_symbol', 'parse_error') AND count(*) FILTER (status = 'new') > 0 AS fails FROM t GROUP BY kind""")
def baseline_verdict(spark, sf_dir):
    strict = b.table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "unresolved_symbol").otherwise("parse_error").alias("kind"))
    return baseline.verdict(_compared(spark, sf_dir), strict)
