"""Shared pieces of the operators: the folder for intermediate tables, safe column names, Arrow batch sizes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as the contracts give it.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that an operator hands to numpy at once; a batch of longer texts is cut by TEXT_BYTES.
TEXT_ROWS, TEXT_BYTES = 1000, 4 << 20
_written: list = []


#: Arrow settings that hold texts in small batches, and the defaults of Spark that they replace.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def lean(spark: SparkSession) -> SparkSession:
    """Texts can be long: Arrow batches of the session that are at Spark's defaults become smaller (2,000 rows, 8 MB), so
    that Python workers hold a few MB at a time. Both are settings of a running session that queries read when they run,
    after the operator has returned, so they can't be put back here; ones that the caller has set stay."""
    for key, (default, small) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return lean(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset and all runs in this
    process (tests, a laptop), a folder of this machine is taken and set; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared one, removed when the driver ends."""
    at = f"{shared_folder(spark)}/plumbline/{tag}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_remove)
    _written.append((spark, at))
    return at


def _remove() -> None:
    for spark, at in _written:
        try:
            remove_folder(spark, at)
        except Exception:  # the JVM may be gone when the interpreter ends
            return


def remove_folder(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, survives lost executors, keeps column pruning."""
    at = new_folder(df.sparkSession, tag)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discarded(df: DataFrame) -> None:
    """Removes a table that `written` gave, when nothing will read it again."""
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_folder(df.sparkSession, at)


def release() -> None:
    """Gives back what Arrow's allocator keeps of batches that are gone: a Python worker else holds the most that it ever
    had, through the stages that follow."""
    pa.default_memory_pool().release_unused()


def batches(frames: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """The same rows in frames of at most TEXT_ROWS rows and about TEXT_BYTES of text, at least a row each."""
    for frame in frames:
        sizes = frame[text].str.len().fillna(0).to_numpy()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > TEXT_BYTES or i - start >= TEXT_ROWS):
                yield frame.iloc[start:i]
                start, held = i, 0
            held += n
        if len(frame) > start:
            yield frame.iloc[start:]
        release()


class Ids(dict):
    """Numbers from 0 for keys, in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


#: Bytes of a long text that are split at a time.
PIECE = 4 << 20


def pieces(text: str, fold: bytes) -> Iterator[list[bytes]]:
    """The words of a text whose bytes `fold` maps, separators to spaces; a piece of a long text at a time, cut between words."""
    data, at = text.encode("utf-8").translate(fold), 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def with_new(df: DataFrame, columns: dict) -> DataFrame:
    """df with these columns; a column of df that has the name of one of them (in any case) gives way."""
    lower = {c.lower() for c in columns}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in lower), *(v.alias(k) for k, v in columns.items()))
