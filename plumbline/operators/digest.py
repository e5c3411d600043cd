"""Digests of a scan under a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import placed

BUDGETS = (12_000, 40_000)


def import_lists(edges: DataFrame) -> DataFrame:
    """(id, imports): the sorted distinct targets of a module's import edges, externals too."""
    return edges.where("kind in ('import', 'from_import')").groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set("target")).alias("imports"))


def within_budget(entries: DataFrame, budget: int, *, key: str = "id", size: str = "size") -> DataFrame:
    """entries with running (characters up to here, shortest first, ties by key) and kept, whether running is within the
    budget: what is cut is the longest. Sizes are counted first, so that the sum over all shorter ones goes over sizes;
    places among entries of one size are those of the global order, so that a common size is no task's alone."""
    counts = entries.groupBy(size).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(size, "__s")
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # over distinct sizes
    sums = counts.select("__s", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(c) for x, c in ((F.col("__n"), "__less"), (F.col("__n") * F.col("__s"), "__before"))))
    rows = placed(entries, size, key, name="__place").join(sums, F.col(size) == F.col("__s"))
    running = F.col("__before") + (F.col("__place") - F.col("__less")) * F.col(size)
    return rows.withColumn("running", running).withColumn("kept", F.col("running") <= budget).drop("__s", "__less", "__before", "__place")


def ladder(modules: DataFrame, ports: DataFrame, edges: DataFrame, budget: int = BUDGETS[0]) -> tuple[int, DataFrame]:
    """(level, digest): digest is (id, body), body the JSON of {id, imports, ports} at the first level that fits.

    0: whole ports; 1: without docstrings; 2: without parameters too; 3: kind and name only; 4: of these, the longest
    ports are dropped until the rest fits. Ids and imports always stay. Lengths of all levels are summed in one pass.
    """
    full = F.struct("kind", "name", "line", "signature", "params", "docstring")
    forms = [full, F.struct("kind", "name", "line", "signature", "params"), F.struct("kind", "name", "line", "signature"), F.struct("kind", "name")]
    by = ports.groupBy(F.col("moduleId").alias("__m")).agg(*(F.sort_array(F.collect_list(F.struct(F.col("line").alias("l"), F.col("name").alias("n"), f.alias("p")))).alias(f"p{i}") for i, f in enumerate(forms)))
    rows = modules.select("id").join(by, F.col("id") == F.col("__m"), "left").join(import_lists(edges).withColumnRenamed("id", "__i"), F.col("id") == F.col("__i"), "left")
    empty = F.array().cast("array<string>")

    def body(ports):
        return F.to_json(F.struct("id", F.coalesce("imports", empty).alias("imports"), ports.alias("ports")))

    levels = rows.select("id", "imports", *(body(F.coalesce(F.transform(f"p{i}", lambda x: x["p"]), F.array().cast(f"array<{kind}>"))).alias(f"b{i}") for i, kind in enumerate(["struct<kind:string,name:string,line:int,signature:string,params:array<string>,docstring:string>", "struct<kind:string,name:string,line:int,signature:string,params:array<string>>", "struct<kind:string,name:string,line:int,signature:string>", "struct<kind:string,name:string>"])))
    sums = levels.agg(*(F.coalesce(F.sum(F.length(f"b{i}")), F.lit(0)) for i in range(4))).first()
    for i in range(4):
        if sums[i] <= budget:
            return i, levels.select("id", F.col(f"b{i}").alias("body"))
    bare = rows.select("id", "imports").withColumn("bare", body(F.array().cast("array<struct<kind:string,name:string>>")))
    left = budget - (bare.agg(F.coalesce(F.sum(F.length("bare")), F.lit(0))).first()[0])
    short = ports.select("moduleId", "kind", "name", "line").withColumn("size", F.length(F.to_json(F.struct("kind", "name"))) + 1).withColumn("key", F.concat_ws("|", "moduleId", "line", "name", "kind"))
    kept = within_budget(short, left, key="key").where("kept").groupBy(F.col("moduleId").alias("__m")).agg(F.sort_array(F.collect_list(F.struct("line", "name", F.struct("kind", "name").alias("p")))).alias("ps"))
    out = bare.join(kept, F.col("id") == F.col("__m"), "left").select("id", body(F.coalesce(F.transform("ps", lambda x: x["p"]), F.array().cast("array<struct<kind:string,name:string>>"))).alias("body"))
    return 4, out
