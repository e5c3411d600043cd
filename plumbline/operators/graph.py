"""Edges: merging, filtering, aggregation by pair, contraction by grouping, and checks of proposed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.names import NOISE


def merge_edges(raw: DataFrame) -> DataFrame:
    """raw (source, target, targetPort, kind, line, stage, seq) by its first four: sites, the sorted distinct lines, and
    the first (stage, seq). A null port is a key value like any other; a null line is no site."""
    return raw.groupBy("source", "target", "targetPort", "kind").agg(F.sort_array(F.collect_set("line")).alias("sites"), F.min(F.struct("stage", "seq")).alias("first"))


def edge_order() -> list[Column]:
    """Source, target, kind, first site, then first appearance."""
    return [F.col("source"), F.col("target"), F.col("kind"), F.element_at("sites", 1), F.col("first")]


def distinct_externals(names: DataFrame, column: str) -> DataFrame:
    """(id, name, kind) of each distinct external module."""
    return names.where(F.col(column).isNotNull()).select(F.col(column).alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("third_party").alias("kind"))


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among nodes.id."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias("__id")).distinct(), F.col(end) == F.col("__id"), "left_semi")
    return edges


def production(df: DataFrame, column: str = "id", noise: tuple[str, ...] = NOISE) -> DataFrame:
    """Rows whose path is neither in a noise directory nor an __init__.py."""
    return df.where(~paths.is_noise(F.col(column), noise))


def inner(edges: DataFrame) -> DataFrame:
    """Edges between two different known nodes."""
    return edges.where("source is not null and target is not null and source <> target")


def pair_edges(edges: DataFrame) -> DataFrame:
    """By (source, target): kinds, sorted and distinct; n_raw edges. The edges themselves stay in `edges`, by the pair."""
    return edges.groupBy("source", "target").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.count(F.lit(1)).alias("n_raw"))


def pair_evidence(edges: DataFrame) -> DataFrame:
    """pair_edges with raw, the pair's edges in order of kind and port. A pair's edges are as many as its ports and kinds."""
    raw = F.sort_array(F.collect_list(F.struct("kind", "targetPort", "sites")))
    return edges.groupBy("source", "target").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), raw.alias("raw"))


def degrees(nodes: DataFrame, pairs: DataFrame, externals: DataFrame) -> DataFrame:
    """Per node id: fan_in and fan_out (distinct other nodes), n_external (distinct externals). Nodes without are 0."""
    ids = nodes.select("id").distinct()
    mine = inner(pairs).select("source", "target").distinct()
    known = without_dangling(mine, ids)
    into = known.groupBy(F.col("target").alias("__a")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = known.groupBy(F.col("source").alias("__b")).agg(F.count(F.lit(1)).alias("fan_out"))
    far = mine.join(externals.select(F.col("id").alias("__e")).distinct(), F.col("target") == F.col("__e"), "left_semi").groupBy(F.col("source").alias("__c")).agg(F.count(F.lit(1)).alias("n_external"))
    joined = ids.join(into, F.col("id") == F.col("__a"), "left").join(out, F.col("id") == F.col("__b"), "left").join(far, F.col("id") == F.col("__c"), "left")
    return joined.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out", "n_external")))


def mapped(edges: DataFrame, grouping: DataFrame) -> DataFrame:
    """Edges with source and target replaced by their groups (grouping: file, group_id; one group a file); null where a
    file is in none."""
    for end in ("source", "target"):
        of = grouping.select(F.col("file").alias("__f"), F.col("group_id").alias("__g"))
        edges = edges.join(of, F.col(end) == F.col("__f"), "left").withColumn(end, F.col("__g")).drop("__f", "__g")
    return edges


def quotient(edges: DataFrame, *groupings: DataFrame) -> DataFrame:
    """Pair edges between groups: ends are mapped through each grouping in turn (files to atoms, atoms to containers),
    edges inside a group or with an end in none are dropped, kinds merged."""
    for grouping in groupings:
        edges = mapped(edges, grouping)
    return pair_edges(inner(edges))


def rolled_up(edges: DataFrame) -> DataFrame:
    """(depth, source, target, kinds, n_raw): the edges between the packages of each depth, in one pass.

    At a depth a path stands as its first `depth` components (one that is not so deep as itself). An edge counts at every
    depth below the last package that both ends have in common: there they differ. So each edge becomes as many rows as its
    deeper end has components beyond that, which one aggregate by depth and pair takes up; at the greatest depth the rows are
    the pair edges themselves. Loops and edges with a null end are left out.
    """
    a, b = F.split("source", "/"), F.split("target", "/")
    deepest = F.greatest(F.size(a), F.size(b))
    known = inner(edges).select("source", "target", "kind", F.filter(F.sequence(F.lit(1), deepest), lambda k: F.slice(a, F.lit(1), k) != F.slice(b, F.lit(1), k)).alias("depths"))
    each = known.select(F.explode("depths").alias("depth"), "source", "target", "kind")
    cut = lambda c: F.array_join(F.slice(F.split(c, "/"), F.lit(1), F.col("depth")), "/")
    return each.groupBy("depth", cut("source").alias("source"), cut("target").alias("target")).agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.count(F.lit(1)).alias("n_raw"))


def collapse_external(edges: DataFrame, externals: DataFrame, node: str = "third-party") -> DataFrame:
    """(source, target, members): edges to externals as edges to one node that keeps their names, others as they are."""
    marked = edges.select("source", "target").distinct().join(externals.select(F.col("id").alias("__e")).distinct(), F.col("target") == F.col("__e"), "left")
    return marked.groupBy("source", F.when(F.col("__e").isNotNull(), node).otherwise(F.col("target")).alias("target")).agg(F.sort_array(F.collect_set("__e")).alias("members"))


def check_edges(proposed: DataFrame, pairs: DataFrame, externals: DataFrame) -> DataFrame:
    """Per distinct proposed (source, target): ok, code, severity, evidence (kinds), fixes.

    blocked: a node with itself, or an external as source. real: the pair is an edge. reversed: the opposite pair is.
    none: neither. Evidence is the kinds of the edge found.
    """
    ask = proposed.select("source", "target").dropDuplicates()
    forth = pairs.select(F.col("source").alias("__a"), F.col("target").alias("__b"), F.col("kinds").alias("__forth"))
    back = pairs.select(F.col("source").alias("__c"), F.col("target").alias("__d"), F.col("kinds").alias("__back"))
    far = externals.select(F.col("id").alias("__e")).distinct()
    rows = ask.join(forth, (F.col("source") == F.col("__a")) & (F.col("target") == F.col("__b")), "left").join(back, (F.col("source") == F.col("__d")) & (F.col("target") == F.col("__c")), "left").join(far, F.col("source") == F.col("__e"), "left")
    code = F.when((F.col("source") == F.col("target")) | F.col("__e").isNotNull(), "blocked").when(F.col("__a").isNotNull(), "real").when(F.col("__c").isNotNull(), "reversed").otherwise("none")
    fixes = F.when(F.col("code") == "real", F.array().cast("array<string>")).when(F.col("code") == "reversed", F.array(F.lit("swap"), F.lit("remove"))).otherwise(F.array(F.lit("remove")))
    return rows.withColumn("code", code).select(
        "source", "target", (F.col("code") == "real").alias("ok"), "code", F.when(F.col("code") == "real", "info").when(F.col("code") == "reversed", "warning").otherwise("error").alias("severity"),
        F.when(F.col("code") == "real", F.col("__forth")).when(F.col("code") == "reversed", F.col("__back")).alias("evidence"), fixes.alias("fixes"),
    )


def real_only(proposed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The proposed edges that are pair edges; each once."""
    found = pairs.select(F.col("source").alias("__a"), F.col("target").alias("__b"))
    return proposed.dropDuplicates(["source", "target"]).join(found, (F.col("source") == F.col("__a")) & (F.col("target") == F.col("__b")), "left_semi")


def through_facades(edges: DataFrame) -> DataFrame:
    """Edges (source, target, targetPort, kind, ...) with those to a re-exported name of an __init__.py led one hop on, to
    the module that the __init__.py itself imports the name from."""
    facade = edges.where("kind = 'from_import' and targetPort is not null").where(F.col("source").endswith("__init__.py"))
    hop = facade.groupBy(F.col("source").alias("__s"), F.col("targetPort").alias("__p")).agg(F.min("target").alias("__t"))
    joined = edges.join(hop, (F.col("target") == F.col("__s")) & (F.col("targetPort") == F.col("__p")), "left")
    return joined.withColumn("target", F.coalesce("__t", "target")).drop("__s", "__p", "__t")
