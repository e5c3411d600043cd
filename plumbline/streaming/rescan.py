"""Rescans while files arrive. A file is parsed once, when it comes, and only modules that a batch concerns are resolved."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.scan import Graph
from .incremental import Incremental


def _arrivals(spark: SparkSession, root: str) -> DataFrame:
    at = root.rstrip("/") if "://" in root else f"file://{root.rstrip('/')}"
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(at)
    path = F.regexp_replace("path", r"^file:/+", "file:///")
    return stream.select(F.substring(path, len(at) + 2, 1 << 20).alias("module_id"), "content", "modificationTime")


def _started(files: DataFrame, taken, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = files.writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watch(spark: SparkSession, root: str, store: str, checkpoint: str, then: Callable[[DataFrame], None], *, available_now: bool = True) -> StreamingQuery:
    """Streams new *.py files below root; each batch is appended to the Parquet table `store` (module_id, content, batch),
    whereupon `then` gets the latest content of every file so far. A batch that is tried again overwrites its own part."""

    def taken(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        spark.catalog.refreshByPath(store)  # else a cached scan of the files so far would stand for the new ones too
        every = spark.read.option("basePath", store).parquet(store)
        then(every.groupBy("module_id").agg(F.max_by("content", F.struct("modificationTime", "batch")).alias("content")))

    return _started(_arrivals(spark, root), taken, checkpoint, available_now)


def watch_graph(spark: SparkSession, root: str, store: str, checkpoint: str, then: Callable[[Graph], None], *, available_now: bool = True, **how) -> StreamingQuery:
    """Streams new *.py files below root; `then` gets the graph of all files so far after each batch. The state is kept in the
    folder `store`, by module (incremental.Incremental): sources are read and parsed once, and of a file that came again only
    what it states now counts."""
    state = Incremental(spark, store, **how)

    def taken(batch: DataFrame, number: int) -> None:
        then(state.apply(batch.groupBy("module_id").agg(F.max_by("content", "modificationTime").alias("content")), number))

    return _started(_arrivals(spark, root), taken, checkpoint, available_now)
