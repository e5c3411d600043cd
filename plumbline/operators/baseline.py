"""Gradual enforcement: findings of a scan held against those that were known before, so that only new ones count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lasting(message: Column) -> Column:
    """A message without the line numbers in it, which move when lines are put in above."""
    return F.regexp_replace(message, r"\bline \d+", "line")


def fingerprints(found: DataFrame) -> DataFrame:
    """found (kind, moduleId, line, message, ...) with nth and fingerprint: SHA-256 of kind, module, lasting message and nth.

    nth numbers the findings of a module that differ by line alone, from the first line on; so a fingerprint stays the same
    when code moves, and one of several equal findings that goes takes the last number with it.
    """
    same = Window.partitionBy("kind", "moduleId", lasting(F.col("message"))).orderBy("line")
    numbered = found.withColumn("nth", F.row_number().over(same))
    text = F.concat_ws("\n", "kind", "moduleId", lasting(F.col("message")), F.col("nth").cast("string"))
    return numbered.withColumn("fingerprint", F.sha2(text, 256))


def compared(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fingerprint, status, kind, moduleId, line, message): new, known or fixed, by a full join of fingerprints. found is as
    fingerprints gives it, baseline has fingerprint, kind, moduleId, line, message; a fixed finding shows what was known."""
    fields = ["kind", "moduleId", "line", "message"]
    now = found.select(F.col("fingerprint").alias("__f"), F.struct(*fields).alias("__now"))
    then = baseline.select("fingerprint", F.struct(*fields).alias("__then")).dropDuplicates(["fingerprint"])
    both = now.dropDuplicates(["__f"]).join(then, F.col("__f") == F.col("fingerprint"), "full")
    status = F.when(F.col("fingerprint").isNull(), "new").when(F.col("__f").isNull(), "fixed").otherwise("known")
    shown = F.coalesce("__now", "__then")
    return both.select(F.coalesce("__f", "fingerprint").alias("fingerprint"), status.alias("status"), *(shown[c].alias(c) for c in fields))


def merged(baseline: DataFrame, result: DataFrame, number: int) -> DataFrame:
    """The baseline after scan `number`: fingerprint, kind, moduleId, line, message, since (the scan that first had it), and
    fixed (the scan that no longer had it, else null). result is what compared gives of the rows that aren't fixed; one that
    was fixed and is back counts from now on as known since then."""
    old = baseline.select(F.col("fingerprint").alias("__f"), "since", "fixed", F.struct("kind", "moduleId", "line", "message").alias("__old"))
    both = result.select("fingerprint", "status", F.struct("kind", "moduleId", "line", "message").alias("__new")).join(old, F.col("fingerprint") == F.col("__f"), "full")
    row = F.coalesce("__new", "__old")
    fixed = F.when(F.col("status") == "fixed", F.lit(number)).when(F.col("status").isNull(), F.col("fixed"))
    since = F.when(F.col("status") == "new", F.lit(number)).otherwise(F.col("since"))
    return both.select(F.coalesce("fingerprint", "__f").alias("fingerprint"), *(row[c].alias(c) for c in ("kind", "moduleId", "line", "message")), since.alias("since"), fixed.alias("fixed"))


def verdict(result: DataFrame, enforced: DataFrame) -> DataFrame:
    """(kind, n_new, n_known, n_fixed, fails): per kind of finding; fails where a kind of enforced.kind has new ones. What is
    known is let through, so that rules may be enforced in code that breaks them already."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    by = result.groupBy("kind").agg(count("new"), count("known"), count("fixed"))
    strict = enforced.select(F.col("kind").alias("__k")).distinct()
    return by.join(strict, F.col("kind") == F.col("__k"), "left").select("kind", "n_new", "n_known", "n_fixed", (F.col("__k").isNotNull() & (F.col("n_new") > 0)).alias("fails"))
