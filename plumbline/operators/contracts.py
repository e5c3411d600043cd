"""Architecture contracts: rules on who may depend on whom, layers, and paths that must not exist.

A pattern is a path by components: `shop/n1` stands for itself and all below it, '' for everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import settled
from .findings import SMALL
from .graph import inner
from .reach import condensed, in_units, spread


def ancestors(path: Column) -> Column:
    """array<struct<depth, prefix>> of a path: '' at depth 0, a, a/b, and the whole."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix")))


def matched(ids: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern, depth): the patterns.pattern that are a prefix of an id, by whole components. Each id becomes a row for
    each of its prefixes, which meet the patterns by equality: as a walk down a trie, not a comparison with each pattern."""
    each = ids.select("id").distinct().select("id", F.explode(ancestors(F.col("id"))).alias("p")).select("id", "p.depth", "p.prefix")
    known = patterns.select("pattern").distinct()
    return each.join(known, F.col("prefix") == F.col("pattern")).select("id", "pattern", "depth")


def decided(pairs: DataFrame, rules: DataFrame, *, default: bool = True) -> DataFrame:
    """(source, target, rule, allowed): which of rules (rule, source, target, allowed) decides on each pair edge.

    The most specific rule wins: the one with more components in both patterns together, then in the source's; of equal
    ones a prohibition, then the first rule by name. Without any rule the default holds and rule is null. Loops, repeats
    and edges with a null end are left out.
    """
    edges = inner(pairs).select("source", "target").distinct()
    asked = rules.select("rule", F.col("source").alias("__sp"), F.col("target").alias("__tp"), "allowed")
    of = lambda end, x: matched(edges.select(F.col(end).alias("id")), asked.select(F.col(f"__{x}p").alias("pattern"))).select(F.col("id").alias(f"__{x}"), F.col("pattern").alias(f"__{x}m"), F.col("depth").alias(f"__{x}d"))
    by_source = of("source", "s").join(asked, F.col("__sm") == F.col("__sp"))
    hits = edges.join(by_source, F.col("source") == F.col("__s")).join(of("target", "t"), (F.col("target") == F.col("__t")) & (F.col("__tp") == F.col("__tm")))
    order = F.struct((-(F.col("__sd") + F.col("__td"))).alias("both"), (-F.col("__sd")).alias("own"), F.col("allowed"), F.col("rule"))
    best = hits.groupBy(F.col("source").alias("__a"), F.col("target").alias("__b")).agg(F.min(order).alias("r"))
    found = edges.join(best, (F.col("source") == F.col("__a")) & (F.col("target") == F.col("__b")), "left")
    return found.select("source", "target", F.col("r.rule").alias("rule"), F.coalesce("r.allowed", F.lit(default)).alias("allowed"))


def layer_of(ids: DataFrame, layers: DataFrame) -> DataFrame:
    """(id, layer, rank): the layer of layers (layer, pattern, rank) whose pattern matches an id with most components; of
    equal patterns the first layer by name. An id that none matches has no row."""
    hits = matched(ids, layers).join(layers.select(F.col("pattern").alias("__p"), "layer", "rank"), F.col("pattern") == F.col("__p"))
    best = hits.groupBy("id").agg(F.min(F.struct((-F.col("depth")).alias("d"), "layer", "rank")).alias("l"))
    return best.select("id", "l.layer", "l.rank")


def layer_breaks(pairs: DataFrame, layers: DataFrame, *, closed: bool = False) -> DataFrame:
    """(source, target, source_layer, target_layer, code) of the pair edges that break the order of layers, the first of
    which has the smallest rank: upward, from a layer to one before it; if closed, skips too, past the next layer. Edges
    with an end in no layer are free."""
    edges = inner(pairs).select("source", "target").distinct()
    ids = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    of = layer_of(ids, layers)
    at = lambda x: of.select(F.col("id").alias(f"__{x}"), F.col("layer").alias(f"{x}_layer"), F.col("rank").alias(f"__{x}_rank"))
    both = edges.join(at("source"), F.col("source") == F.col("__source")).join(at("target"), F.col("target") == F.col("__target"))
    down = F.col("__target_rank") - F.col("__source_rank")
    code = F.when(down < 0, "upward").when(F.lit(closed) & (down > 1), "skips")
    return both.withColumn("code", code).where("code is not null").select("source", "target", "source_layer", "target_layer", "code")


def forbidden_paths(pairs: DataFrame, rules: DataFrame, *, small: int = SMALL) -> DataFrame:
    """(rule, id, hops, via_source, via_target): the nodes below the source pattern of rules (rule, source, target) that
    depend on a node below its target pattern, directly or through others.

    hops counts edges between cycles or nodes outside of any, at least; via is the edge by which the node, or its cycle,
    starts on the shortest way (the smallest of several). A node in one cycle with a target has hops 0 and as via its
    smallest edge inside the cycle. A node that matches both patterns breaks a rule only by another node.
    """
    edges = inner(pairs).select("source", "target").distinct()
    ids = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    units, links = map(settled, condensed(pairs, small))
    below = lambda end: matched(ids, rules.select(F.col(end).alias("pattern"))).join(rules.select("rule", F.col(end).alias("__p")).distinct(), F.col("pattern") == F.col("__p")).select("rule", "id")
    # all targets of a unit count, so that a node is told from the other members of its cycle
    goals = in_units(below("target"), units, "id", "unit")
    reached = spread(goals.select(F.col("rule").alias("label"), "unit", F.lit("").alias("origin")), links)
    own = in_units(below("source"), units, "id", "__at")
    hits = own.join(reached.select(F.col("label").alias("__l"), F.col("unit").alias("__u"), "hop", F.col("source").alias("via_source"), F.col("target").alias("via_target")), (F.col("rule") == F.col("__l")) & (F.col("__at") == F.col("__u")))
    further = hits.where("hop > 0").select("rule", "id", F.col("hop").alias("hops"), "via_source", "via_target")
    # inside a cycle: some target there that is not the node itself
    others = goals.join(units.select(F.col("unit").alias("__c")).distinct(), F.col("unit") == F.col("__c"), "left_semi").groupBy("rule", "unit").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    inside = hits.where("hop = 0").select("rule", "id", "__at").join(others.withColumnRenamed("rule", "__r"), (F.col("rule") == F.col("__r")) & (F.col("__at") == F.col("unit"))).where("low <> id or high <> id")
    first = in_units(in_units(edges, units, "source", "a"), units, "target", "b").where("a = b").groupBy(F.col("source").alias("via_source")).agg(F.min("target").alias("via_target"))
    near = inside.join(first, F.col("id") == F.col("via_source")).select("rule", "id", F.lit(0).alias("hops"), "via_source", "via_target")
    return further.unionByName(near)
