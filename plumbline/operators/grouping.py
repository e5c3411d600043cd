"""Groupings of files (group_id, file): validation, coverage and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.names import NOISE


def violations(manifest: DataFrame, files: DataFrame, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """(rule, subject) for what is wrong with a manifest (group_id, file; an empty group has a null file; groups may have
    a `declared` column that numbers their declarations) of the existing files (file).

    duplicate_group, empty_group, shared_file (in several groups), unknown_file, noise_file, uncovered_file.
    """
    has = manifest.where("file is not null").select("group_id", "file").distinct()
    real = files.select(F.col("file").alias("__f")).where("__f is not null").distinct()
    row = lambda df, rule, subject: df.select(F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    parts = [
        row(manifest.groupBy("group_id").agg(F.count("file").alias("n")).where("n = 0"), "empty_group", "group_id"),
        row(has.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared_file", "file"),
        row(has.select("file").distinct().join(real, F.col("file") == F.col("__f"), "left_anti"), "unknown_file", "file"),
        row(has.select("file").distinct().where(paths.is_noise(F.col("file"), noise)), "noise_file", "file"),
        row(real.where(~paths.is_noise(F.col("__f"), noise)).join(has.select("file").distinct(), F.col("__f") == F.col("file"), "left_anti"), "uncovered_file", "__f"),
    ]
    if "declared" in manifest.columns:
        parts.append(row(manifest.groupBy("group_id").agg(F.countDistinct("declared").alias("n")).where("n > 1"), "duplicate_group", "group_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def coverage(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(file, n_groups) for every file that is not in exactly one group."""
    counts = manifest.where("file is not null").select("group_id", "file").distinct().groupBy(F.col("file").alias("__f")).agg(F.count(F.lit(1)).alias("n"))
    return files.select("file").distinct().join(counts, F.col("file") == F.col("__f"), "left").select("file", F.coalesce("n", F.lit(0)).alias("n_groups")).where("n_groups <> 1")


def best_matches(truth: DataFrame, candidate: DataFrame) -> DataFrame:
    """(truth_group, candidate_group, overlap): of each group of the truth the candidate group that shares most files with
    it, of several the first by name. A group that shares none has null and 0. Overlaps are counted by pairs of groups,
    so a large group is partial counts."""
    a = truth.select(F.col("group_id").alias("truth_group"), "file").distinct()
    b = candidate.select(F.col("group_id").alias("candidate_group"), F.col("file").alias("__f")).distinct()
    counts = a.join(b, F.col("file") == F.col("__f")).groupBy("truth_group", "candidate_group").agg(F.count(F.lit(1)).alias("overlap"))
    best = counts.groupBy(F.col("truth_group").alias("__t")).agg(F.min(F.struct((-F.col("overlap")).alias("n"), F.col("candidate_group").alias("g"))).alias("m"))
    groups = truth.select(F.col("group_id").alias("truth_group")).distinct()
    return groups.join(best, F.col("truth_group") == F.col("__t"), "left").select("truth_group", F.col("m.g").alias("candidate_group"), F.coalesce(-F.col("m.n"), F.lit(0)).alias("overlap"))


def placed_files(truth: DataFrame, candidate: DataFrame) -> DataFrame:
    """(file, truth_group, candidate_group, verdict) for each file of either: correct (in the group that matches best),
    wrong, missed (not in the candidate), extra (not in the truth)."""
    matches = best_matches(truth, candidate).select(F.col("truth_group").alias("__t"), F.col("candidate_group").alias("best"))
    a = truth.select("file", F.col("group_id").alias("truth_group")).distinct()
    b = candidate.select("file", F.col("group_id").alias("candidate_group")).distinct()
    rows = a.join(b, "file", "full").join(matches, F.col("truth_group") == F.col("__t"), "left")
    verdict = F.when(F.col("truth_group").isNull(), "extra").when(F.col("candidate_group").isNull(), "missed").when(F.col("candidate_group") == F.col("best"), "correct").otherwise("wrong")
    return rows.select("file", "truth_group", "candidate_group", verdict.alias("verdict"))


def accuracy(placed: DataFrame) -> DataFrame:
    """One row: n_truth, n_correct, n_missed, n_extra, accuracy (null for an empty truth)."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    sums = placed.agg(F.count("truth_group").alias("n_truth"), n("correct").alias("n_correct"), n("missed").alias("n_missed"), n("extra").alias("n_extra"))
    return sums.withColumn("accuracy", F.when(F.col("n_truth") > 0, F.col("n_correct") / F.col("n_truth")))


def group_depth(ports: DataFrame, grouping: DataFrame) -> DataFrame:
    """(group_id, n_ports, ratio): depth of a group's ports taken together, its ratio being the sum of its files' last
    port lines by their ports."""
    files = ports.groupBy("moduleId").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last"))
    rows = grouping.select("group_id", "file").distinct().join(files, F.col("file") == F.col("moduleId"))
    return rows.groupBy("group_id").agg(F.sum("n").alias("n_ports"), (F.sum("last") / F.sum("n")).alias("ratio"))


def unassigned(files: DataFrame, grouping: DataFrame) -> DataFrame:
    """The files in no group."""
    return files.select("file").distinct().join(grouping.select(F.col("file").alias("__f")).distinct(), F.col("file") == F.col("__f"), "left_anti")


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with `place`, from 0, in its group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
