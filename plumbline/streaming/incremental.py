"""Scans that are kept up to date: after a batch of files only the modules that it may concern are resolved again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.pyfacts import SCHEMA, py_facts
from ..operators import resolve
from ..plans.scan import Graph, graph_of, port_names, resolved_rows

#: The parts of the state, each a Parquet table by batch: the files that came or went; what they state; of the modules that a
#: batch resolved: their located imports, what they resolve to, and the keys of other modules that the answers hang on.
PARTS = {
    "files": "module_id string, gone boolean", "facts": SCHEMA, "touched": "module_id string",
    "imports": "module_id string, seq int, line int, kind string, module string, level int, name string, alias string, target string, sub string, sub_at string",
    "resolved": "module_id string, kind string, line int, stage int, seq int, edge_target string, edge_port string, external string, unresolved string, asked_at string, asked_name string",
    "hangs": "module_id string, what string, key string",
}


def index_keys(imports: DataFrame) -> DataFrame:
    """(module_id, what, key): the dotted names that a module's imports look up in the index: targets, submodules they may
    mean, and all prefixes of both, since a longer one that comes, or goes, changes the answer."""
    names = imports.select("module_id", F.explode(F.array_compact(F.array("target", "sub"))).alias("n")).distinct()
    return names.select("module_id", F.lit("index").alias("what"), F.explode(F.transform(paths.prefixes(F.col("n")), lambda p: p["prefix"])).alias("key")).distinct()


def port_key(module, name):
    return F.concat(module, F.lit("\n"), name)


def port_keys(resolved: DataFrame) -> DataFrame:
    """(module_id, what, key): the ports that a module's imports and references look up, there or not."""
    return resolved.where("asked_at is not null and asked_name is not null").select("module_id", F.lit("port").alias("what"), port_key(F.col("asked_at"), F.col("asked_name")).alias("key")).distinct()


class Incremental:
    """The state of a scan in the folder `store`, by module and batch. apply() takes a batch of files and gives the graph of
    all files so far, the same as a scan of them all. A batch that is tried again overwrites its own part.

    Resolution is global, so a file may change the answers of others; but only in two ways: the index has, or has no longer,
    a dotted name; or a module has, or has no longer, a port. Each module's state says which names of the index and which
    ports it asked for, so those to resolve again are found by one join on the keys that the batch changed.
    """

    def __init__(self, spark: SparkSession, store: str, **how):
        self.spark, self.store, self.how = spark, store.rstrip("/"), how

    def _write(self, part: str, df: DataFrame, number: int) -> None:
        df.select(*(c.split()[0] for c in PARTS[part].split(", "))).write.mode("overwrite").parquet(f"{self.store}/{part}/batch={number}")

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.store}/{part}").schema(f"{PARTS[part]}, batch int").parquet(f"{self.store}/{part}")

    @staticmethod
    def _last(rows: DataFrame, by: DataFrame) -> DataFrame:
        """The rows of each module's last batch in by (module_id, batch)."""
        last = by.groupBy(F.col("module_id").alias("__m")).agg(F.max("batch").alias("__b"))
        return rows.join(last, (F.col("module_id") == F.col("__m")) & (F.col("batch") == F.col("__b")), "left_semi").drop("batch")

    def _alive(self, files: DataFrame) -> DataFrame:
        """(module_id, batch) of the files that are there, each with the batch that it came with last."""
        return files.groupBy("module_id").agg(F.max(F.struct("batch", "gone")).alias("l")).where("not l.gone").select("module_id", "l.batch")

    def apply(self, files: DataFrame, number: int, removed: DataFrame | None = None) -> Graph:
        """The graph after files (module_id, content) came, or came anew, and removed (module_id) went. Numbers rise."""
        if not number:
            for part, schema in PARTS.items():
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.store}/{part}/batch=-1")
        changed = files.select("module_id", F.lit(False).alias("gone"))
        if removed is not None:
            changed = changed.unionByName(removed.select("module_id", F.lit(True).alias("gone")).join(files.select(F.col("module_id").alias("__m")), F.col("module_id") == F.col("__m"), "left_anti"))
        self._write("files", changed.distinct(), number)
        self._write("facts", py_facts(files), number)
        self.spark.catalog.refreshByPath(self.store)

        every, facts = self._read("files").where(F.col("batch") <= number), self._read("facts").where(F.col("batch") <= number)
        before, now = self._alive(every.where(F.col("batch") < number)), self._alive(every)
        mine = every.where(F.col("batch") == number).select("module_id")
        index = resolve.module_index(now.select("module_id"))
        asked = self._concerned(mine, before, now, index, facts, number)
        self._write("touched", asked, number)
        self.spark.catalog.refreshByPath(self.store)
        touched = self._read("touched").where(F.col("batch") == number).select(F.col("module_id").alias("__t"))

        latest = facts.join(now.toDF("__m", "__b"), (F.col("module_id") == F.col("__m")) & (F.col("batch") == F.col("__b")), "left_semi").drop("batch")
        own = latest.join(touched, F.col("module_id") == F.col("__t"), "left_semi")
        self._write("imports", resolve.located_imports(own, index), number)
        self.spark.catalog.refreshByPath(self.store)
        imports = self._read("imports").where(F.col("batch") == number).drop("batch")
        self._write("resolved", resolved_rows(own, imports, index, port_names(latest), **self.how), number)
        self.spark.catalog.refreshByPath(self.store)
        resolved = self._read("resolved").where(F.col("batch") == number)
        self._write("hangs", index_keys(imports).unionByName(port_keys(resolved)), number)
        self.spark.catalog.refreshByPath(self.store)

        done = self._read("touched").where(F.col("batch") <= number).join(now.select(F.col("module_id").alias("__m")), F.col("module_id") == F.col("__m"), "left_semi")
        return graph_of(latest, self._last(self._read("imports"), done), self._last(self._read("resolved"), done), [])

    def touched(self, number: int) -> DataFrame:
        """(module_id) of the modules that a batch resolved."""
        return self._read("touched").where(F.col("batch") == number).select("module_id")

    def _concerned(self, mine: DataFrame, before: DataFrame, now: DataFrame, index: DataFrame, facts: DataFrame, number: int) -> DataFrame:
        """(module_id): the batch's own modules that are there, and those that ask for what it changed."""
        names = mine.select(paths.dotted(F.col("module_id")).alias("dotted")).distinct()
        old = resolve.module_index(before.select("module_id"))
        to = lambda df, x: df.join(names, "dotted", "left_semi").select("dotted", F.col("target").alias(x))
        moved = to(old, "a").join(to(index, "b"), "dotted", "full").where("not (a <=> b)").select(F.lit("index").alias("what"), F.col("dotted").alias("key"))

        def ports(alive: DataFrame) -> DataFrame:
            of = alive.join(mine.select(F.col("module_id").alias("__m")), F.col("module_id") == F.col("__m"), "left_semi").toDF("__m", "__b")
            rows = facts.join(of, (F.col("module_id") == F.col("__m")) & (F.col("batch") == F.col("__b")), "left_semi")
            return port_names(rows).select(F.lit("port").alias("what"), port_key(F.col("module_id"), F.col("name")).alias("key"))

        was, is_ = ports(before), ports(now)
        keys = moved.unionByName(was.exceptAll(is_)).unionByName(is_.exceptAll(was))
        # the state of each module that is there, by the batch that resolved it last
        known = self._read("touched").where(F.col("batch") < number).join(before.select(F.col("module_id").alias("__m")), F.col("module_id") == F.col("__m"), "left_semi")
        hangs = self._last(self._read("hangs"), known)
        others = hangs.join(keys, ["what", "key"], "left_semi").select("module_id").distinct()
        alive = now.select(F.col("module_id").alias("__n"))
        return mine.unionByName(others).distinct().join(alive, F.col("module_id") == F.col("__n"), "left_semi")
