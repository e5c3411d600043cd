"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_new

#: Production weights of op1: shares of the mixture; `rest` is shared by every source not named, the null source too.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.02}
REST = 0.58


def poisson_cdf(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ..., to where a double can't come nearer to 1."""
    if rate <= 0:
        return []
    out, total, k = [], 0.0, 0
    while total < 1 - 2**-53 and k <= rate + 40 * math.sqrt(rate) + 60:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
        k += 1
    return out


def mixing_rates(docs: DataFrame, weights: dict[str, float], rest: float, epochs: float = 1.0) -> dict[str | None, float]:
    """Mean repetitions by named source; key None holds for all others together.

    A rate is epochs * (all characters) * (the source's share) / (the source's characters). Shares are made to add up
    to 1 over the sources that have text. At most len(weights) + 1 rows come to the driver, whatever the corpus has.
    """
    if any(w < 0 for w in [*weights.values(), rest]):
        raise ValueError("weights can't be negative")
    group = F.when(F.col("source").isin(list(weights)), F.col("source")) if weights else F.lit(None).cast("string")
    sizes = {r[0]: r[1] or 0 for r in docs.groupBy(group.alias("g")).agg(F.sum(F.length("text"))).collect()}
    share = {g: w for g, w in [*weights.items(), (None, rest)] if sizes.get(g, 0) > 0}
    total, shares = sum(sizes.values()), sum(share.values())
    return {g: epochs * total * w / shares / sizes[g] if shares else 0.0 for g, w in share.items()}


def mix_sources(docs: DataFrame, weights: dict[str, float], rest: float = 0.0, *, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """Each document as often as a Poisson variable of its source's rate says, in a global random order.

    The variable is the inverse of the Poisson distribution at u, a uniform number that md5 of seed and doc_id gives:
    the same on every run, on any number of executors, and after a lost one. Copies get `copy` (from 1) and
    `shuffle_key` (32 hex digits); rows lie in ascending shuffle_key, range-partitioned, so that reading the output in
    order is the global shuffle.

    Only sums by source are gathered, so a source with a third of all rows costs partial sums; the copies are dealt out
    by a uniform key. Null text counts no characters; a null doc_id hashes like ''; rows that repeat a doc_id repeat
    its count; sources without any text, or of weight 0, give no rows. Other columns pass; ones named copy or
    shuffle_key give way. An empty table gives an empty one.
    """
    cdfs = {g: poisson_cdf(rate) for g, rate in mixing_rates(docs, weights, rest, epochs).items()}
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    rates = docs.sparkSession.createDataFrame([(g, c) for g, c in cdfs.items()], "g string, cdf array<double>")
    group = F.when(F.col("source").isin(list(weights)), F.col("source")) if weights else F.lit(None).cast("string")
    # at most len(weights) + 1 rows, so the broadcast can't grow
    joined = docs.withColumns({"__g": group, "__u": u}).join(F.broadcast(rates.withColumnRenamed("g", "__h")), F.col("__g").eqNullSafe(F.col("__h")))
    counted = joined.withColumn("__n", F.expr("size(filter(cdf, c -> c <= __u))")).where("__n > 0")
    copies = counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    order = F.md5(F.concat(F.lit(f"{seed}|order|"), key, F.lit("|"), F.col("__copy").cast("string")))
    out = with_new(copies, {"copy": F.col("__copy"), "shuffle_key": order}).drop("__g", "__h", "__u", "__n", "__copy", "cdf")
    return out.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn by WEIGHTS and REST; null texts, sources and ids as mix_sources says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, WEIGHTS, REST).select("shuffle_key", "doc_id", "copy", "source", "text")


_named = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())
OP1_SQL = f"""
WITH weights(source, w) AS (VALUES {_named}),
sized AS (
  SELECT d.doc_id, d.source, d.text, w.source AS g, coalesce(w.w, {REST}) AS w
  FROM documents d LEFT JOIN weights w ON d.source = w.source),
sizes AS (SELECT g, any_value(w) AS w, CAST(sum(length(text)) AS DOUBLE) AS size FROM sized GROUP BY g),
rates AS (
  SELECT g, (SELECT sum(size) FROM sizes) * w / (SELECT sum(w) FROM sizes WHERE size > 0) / size AS rate
  FROM sizes WHERE size > 0),
pmf AS (SELECT g, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p FROM (SELECT g, rate, unnest(range(0, CAST(rate + 40 * sqrt(rate) + 62 AS BIGINT))) AS k FROM rates WHERE rate > 0)),
cdf AS (SELECT g, k, sum(p) OVER (PARTITION BY g ORDER BY k) AS c, p FROM pmf),
drawn AS (
  SELECT doc_id, source, text, g,
         (CAST(('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM sized),
counted AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM cdf c WHERE c.g IS NOT DISTINCT FROM d.g AND c.c <= d.u) AS n
  FROM drawn d)
SELECT md5('42|order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR)) AS shuffle_key,
       doc_id, CAST(copy AS INTEGER) AS copy, source, text
FROM counted, LATERAL (SELECT unnest(range(1, n + 1)) AS copy)
"""
