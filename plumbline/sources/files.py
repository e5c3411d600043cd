"""Frames of source files: (module_id string, content binary)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import PRUNED
from .store import fresh_folder

SCHEMA = "module_id string, content binary"


class EmptyScan(ValueError):
    """There is nothing to scan."""


def _store(root: str):
    """(file system, path) of a root, in a task: a path of this machine, or a URI that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def listed(spark: SparkSession, root: str, pruned: frozenset[str], *, per_task: int = 64, missing_ok: bool = False) -> DataFrame:
    """(path, name, folder): the files and folders below root, but for those of a name in pruned, which are never entered.

    Folders are listed by the executors, a level of them at a time: what a level finds is written, and the folders of it are
    the next one's frontier. So the driver holds no names, a pruned tree costs nothing, and there are as many rounds as the
    deepest folder has ancestors. Links to folders of this machine are not followed.
    """
    schema, at, level = "path string, name string, folder boolean", fresh_folder(spark, "listed"), 0

    def inside(store, path: str, absent_ok: bool) -> list[tuple[str, str, bool]]:
        from pyarrow import fs

        if not isinstance(store, fs.LocalFileSystem):
            return [(i.path, i.base_name, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(path, allow_not_found=absent_ok))]
        if absent_ok and not os.path.isdir(path):
            return []
        with os.scandir(path) as found:  # which also has links that lead nowhere
            return [(e.path, e.name, e.is_dir()) for e in found if not (e.is_symlink() and e.is_dir())]

    def children(frames: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        store, _ = _store(root)
        for frame in frames:
            for path in frame["path"]:
                yield pd.DataFrame([r for r in inside(store, path, first or missing_ok) if r[1] not in pruned], columns=["path", "name", "folder"])

    front, n = spark.createDataFrame([(_store(root)[1],)], "path string"), 1
    while n:
        front.repartition(-(-n // per_task)).mapInPandas(lambda frames, first=not level: children(frames, first), schema).write.parquet(f"{at}/{level}")
        front = spark.read.schema(schema).parquet(f"{at}/{level}").where("folder").select("path")
        n, level = front.count(), level + 1
    return spark.read.schema(schema).parquet(*(f"{at}/{k}" for k in range(level)))


def source_files(spark: SparkSession, root: str, exclude_dirs: set[str] | None = None, *, missing_ok: bool = False, per_task: int = 500, suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
    """All *.py files (or those of other suffixes) below root, but for those with a path component in PRUNED or exclude_dirs.

    module_id is the path below root with / separators. Executors list the folders (Spark's own file sources leave out
    names with a leading underscore, so __init__.py too) and read the contents, some per_task files each, through Arrow's
    file systems. A file that vanishes or can't be read ends the scan unless missing_ok. A root without such files, or one
    that isn't there, gives an empty frame.
    """
    pruned = frozenset({*PRUNED, *(exclude_dirs or ())})
    root = root.rstrip("/") if "://" in root else os.path.realpath(root)
    base = _store(root)[1].rstrip("/")
    names = listed(spark, root, pruned, missing_ok=missing_ok).where(~F.col("folder") & F.array_contains(F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.endswith("name", s)), True))
    names = names.select(F.substring("path", len(base) + 2, 1 << 20).alias("module_id"), "path")
    names = names.repartition(max(1, names.count() // per_task))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(root)
        for frame in frames:
            for module, path in zip(frame["module_id"], frame["path"]):
                try:
                    with store.open_input_stream(path, compression=None) as stream:
                        yield pd.DataFrame({"module_id": [module], "content": [stream.read()]})
                except FileNotFoundError:
                    if not missing_ok:
                        raise

    return names.mapInPandas(read, SCHEMA)


def memory_files(spark: SparkSession, files: dict[str, bytes | str]) -> DataFrame:
    """The frame of sources held in a dict."""
    rows = [(m, bytearray(c.encode() if isinstance(c, str) else c)) for m, c in files.items()]
    return spark.createDataFrame(rows, "module_id string, content binary")


def is_refused(files: DataFrame) -> DataFrame:
    """(refused): one row, whether there is nothing to scan."""
    return files.limit(1).agg((F.count(F.lit(1)) == 0).alias("refused"))


def guarded(files: DataFrame) -> DataFrame:
    """files, or EmptyScan if there are none."""
    if is_refused(files).first()["refused"]:
        raise EmptyScan("no modules to scan")
    return files
