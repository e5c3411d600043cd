"""Settled tables: what an iteration or several readers share, kept where every executor can read it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fresh: list = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that setting is empty and all runs in this process (tests, a laptop)
    a folder of this machine is taken; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", "")
        if not at:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(at)
    return re.sub("^file:/+", "file:///", context.getCheckpointDir())


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    at = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    if not _fresh:
        atexit.register(_remove)
    _fresh.append((spark, at))
    return at


def _remove() -> None:
    for spark, at in _fresh:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone when the interpreter ends
            return


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, it is worked out once and survives lost executors."""
    at = fresh_folder(df.sparkSession, "settled")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dealt(files: DataFrame) -> DataFrame:
    """files (module_id, ...) dealt out by module, in as many parts as the session shuffles into: one small Parquet file may
    hold a million sources, which a single task would parse one after the other."""
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.repartition(parts, "module_id")
