"""Reachability over a dependency graph whose cycles are contracted: what a change reaches, and by which edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import fresh_folder, settled
from .findings import SMALL, strong_components
from .graph import inner


def condensed(pairs: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(units, links): units (id, unit), the members of components of two or more nodes, of which the smallest stands for
    all; any other node is its own unit. links (a, b, source, target): the pairs of different units with an edge from a to b,
    and the smallest such edge. Units and links have no cycle."""
    components = strong_components(pairs, small)
    units = components.select("id", F.col("component").alias("unit"))
    edges = inner(pairs).select("source", "target").distinct()
    both = in_units(in_units(edges, units, "source", "a"), units, "target", "b").where("a <> b")
    return units, both.groupBy("a", "b").agg(F.min(F.struct("source", "target")).alias("e")).select("a", "b", "e.source", "e.target")


def in_units(df: DataFrame, units: DataFrame, column: str, to: str) -> DataFrame:
    """df with the unit of a column's node."""
    of = units.select(F.col("id").alias("__i"), F.col("unit").alias("__u"))
    return df.join(of, F.col(column) == F.col("__i"), "left").withColumn(to, F.coalesce("__u", column)).drop("__i", "__u")


def spread(starts: DataFrame, links: DataFrame, *, most: int | None = None) -> DataFrame:
    """(label, unit, hop, origin, source, target): for each label the units that its starts (label, unit, origin) reach
    against the links, by the least number of links; of several ways the smallest origin's, then the smallest edge's. Starts
    have hop 0 and no edge; `most` bounds the hops.

    Where no unit has more links than one, ways are told by pointers, in as many rounds as the logarithm of the longest way
    (_by_pointers). Else a round for each hop: what the last one found meets the links, by their end, and what is known
    already is left out by an anti-join; its finds are written, so that neither plans nor lineage grow. There are as many
    rounds as the longest way has links, and without cycles no way is longer than the condensed graph is deep.
    """
    spark = starts.sparkSession
    if links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return _by_pointers(starts, links, most)
    at, schema = fresh_folder(spark, "reached"), "label string, unit string, hop int, origin string, source string, target string"
    first = starts.groupBy("label", "unit").agg(F.min("origin").alias("origin"))
    found = first.select("label", "unit", F.lit(0).alias("hop"), "origin", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"))
    end = links.select(F.col("b").alias("__b"), "a", F.col("source").alias("s"), F.col("target").alias("t"))
    read, hop = spark.read.schema(schema), 0
    while True:
        found.write.parquet(f"{at}/{hop}")
        last, known = read.parquet(f"{at}/{hop}"), read.parquet(*(f"{at}/{h}" for h in range(hop + 1)))
        if hop == most or last.isEmpty():
            return known
        hop += 1
        near = last.join(end, F.col("unit") == F.col("__b")).groupBy("label", F.col("a").alias("unit")).agg(F.min(F.struct("origin", F.col("s").alias("source"), F.col("t").alias("target"))).alias("e"))
        seen = known.select(F.col("label").alias("__l"), F.col("unit").alias("__u"))
        found = near.join(seen, (F.col("label") == F.col("__l")) & (F.col("unit") == F.col("__u")), "left_anti").select("label", "unit", F.lit(hop).alias("hop"), "e.origin", "e.source", "e.target")


def _by_pointers(starts: DataFrame, links: DataFrame, most: int | None) -> DataFrame:
    """spread where a unit has one link at most, and so one way.

    Before round k all units at less than 2 ** k hops are known; a unit that isn't is 2 ** k hops further than the one
    2 ** k links on. Then pointers are doubled; units known for every label need none any more, nor does one on the way to them.
    """
    spark = starts.sparkSession
    at, schema, k = fresh_folder(spark, "reached"), "label string, unit string, hop int, origin string", 0
    found = starts.groupBy("label", "unit").agg(F.min("origin").alias("origin")).select("label", "unit", F.lit(0).alias("hop"), "origin")
    step, labels = settled(links.select("a", "b")), None
    while True:
        found.write.parquet(f"{at}/{k}")
        last, known = spark.read.schema(schema).parquet(f"{at}/{k}"), spark.read.schema(schema).parquet(*(f"{at}/{i}" for i in range(k + 1)))
        if last.isEmpty() or most is not None and 2**k > most:
            break
        labels = labels or last.select("label").distinct().count()
        if k:
            full = known.groupBy(F.col("unit").alias("__u")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == labels)
            open_ = step.join(full, F.col("a") == F.col("__u"), "left_anti")
            step = settled(open_.join(step.select(F.col("a").alias("__a"), F.col("b").alias("__b")), F.col("b") == F.col("__a")).select("a", F.col("__b").alias("b")))
        far = 2**k
        k += 1
        near = known.join(step, F.col("unit") == F.col("b")).select("label", F.col("a").alias("unit"), (F.col("hop") + far).alias("hop"), "origin")
        seen = known.select(F.col("label").alias("__l"), F.col("unit").alias("__u"))
        found = near.join(seen, (F.col("label") == F.col("__l")) & (F.col("unit") == F.col("__u")), "left_anti")
    own = links.select(F.col("a").alias("__a"), F.col("source").alias("__s"), F.col("target").alias("__t"))
    by = lambda c, name: F.when(F.col("hop") > 0, F.col(c)).alias(name)
    every = known.join(own, F.col("unit") == F.col("__a"), "left").select("label", "unit", "hop", "origin", by("__s", "source"), by("__t", "target"))
    return every if most is None else every.where(F.col("hop") <= most)


def impact(pairs: DataFrame, changed: DataFrame, *, most: int | None = None, small: int = SMALL) -> DataFrame:
    """(id, hops, origin, via_source, via_target): every node that a change of the nodes changed.id may touch: those
    themselves, the members of their cycles, and all that depend on them, however indirectly.

    hops counts the edges between cycles or nodes outside of any, at least; origin is the smallest changed node at that
    distance; via is the edge by which the dependency comes in, null at hops 0. pairs (source, target): source depends on
    target; loops, repeats and nulls are allowed. A changed node without an edge touches itself.
    """
    units, links = map(settled, condensed(pairs, small))
    starts = in_units(changed.where("id is not null").select("id").distinct(), units, "id", "unit").select(F.lit("").alias("label"), "unit", F.col("id").alias("origin"))
    reached = spread(starts, links, most=most)
    members = units.select(F.col("unit").alias("__u"), F.col("id").alias("__m"))
    every = reached.join(members, F.col("unit") == F.col("__u"), "left")
    return every.select(F.coalesce("__m", "unit").alias("id"), F.col("hop").alias("hops"), "origin", F.col("source").alias("via_source"), F.col("target").alias("via_target"))


def impact_sizes(touched: DataFrame) -> DataFrame:
    """(origin, n, furthest): how many nodes are nearest to each changed node, itself included, and how far the last is."""
    return touched.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.max("hops").alias("furthest"))
