"""Depth of interfaces, strongly connected components, orphans, and the findings made of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import settled
from .graph import inner

#: Pairs up to which components are found by one task; beyond, by rounds over distributed tables.
SMALL = 200_000
DEEP, MODERATE = 50, 15


def depth_scores(modules: DataFrame, ports: DataFrame) -> DataFrame:
    """Per module id: n_ports, ratio (last port's line by the number of ports), depth (deep, moderate, shallow). A module
    without ports has ratio 0 and is shallow."""
    sums = ports.groupBy(F.col("moduleId").alias("__m")).agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last"))
    ratio = F.coalesce(F.col("last") / F.col("n"), F.lit(0.0))
    depth = F.when(ratio >= DEEP, "deep").when(ratio >= MODERATE, "moderate").otherwise("shallow")
    return modules.select("id").distinct().join(sums, F.col("id") == F.col("__m"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n_ports"), ratio.alias("ratio"), depth.alias("depth"))


def traffic_light(depth):
    """The colour of a depth."""
    return F.when(depth == "deep", "green").when(depth == "moderate", "yellow").otherwise("red")


def _one_task(frame: pd.DataFrame) -> pd.DataFrame:
    """Components by two passes of depth-first search, without recursion."""
    out: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for a, b in zip(frame["source"], frame["target"]):
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    nodes, order, seen = sorted({*out, *back}), [], set()
    for start in nodes:
        stack = [(start, iter(out.get(start, ())))] if start not in seen else []
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            following = next((n for n in rest if n not in seen), None)
            if following is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(following)
                stack.append((following, iter(out.get(following, ()))))
    rows, taken = [], set()
    for start in reversed(order):
        own, stack = [], [start] if start not in taken else []
        taken.add(start)
        while stack:
            node = stack.pop()
            own.append(node)
            fresh = [n for n in back.get(node, ()) if n not in taken]
            taken.update(fresh)
            stack.extend(dict.fromkeys(fresh))
        if len(own) > 1:
            rows += [(min(own), n) for n in own]
    return pd.DataFrame(rows, columns=["component", "id"])


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has an edge in and whose target has one out: no other lies on a cycle. Again while a tenth goes
    each time; to go on until none is left would take a pass for each hop of the longest path."""
    before = edges.count()
    while before:
        heads, tails = edges.select(F.col("target").alias("__h")).distinct(), edges.select(F.col("source").alias("__t")).distinct()
        edges = settled(edges.join(heads, F.col("source") == F.col("__h"), "left_semi").join(tails, F.col("target") == F.col("__t"), "left_semi"))
        left = edges.count()
        if left > 0.9 * before:
            break
        before = left
    return edges


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, label: struct of m, rank, node): the smallest label that reaches a node along edges (a, b).

    In each round a node takes the smallest label of its neighbours, by partial minima, and then the label of its label's
    node, which reaches it too: so labels jump, and a path takes about the logarithm of its length.
    """
    while True:
        near = edges.join(labels, F.col("a") == F.col("id")).groupBy("b").agg(F.min("label").alias("near"))
        low = settled(labels.join(near, F.col("id") == F.col("b"), "left").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        of = low.select(F.col("id").alias("n2"), F.col("label").alias("l2"))
        new = low.join(of, F.col("label.node") == F.col("n2")).select("id", F.least("label", "l2").alias("label"), (F.least("label", "l2") < F.col("old")).alias("moved"))
        new = settled(new)
        labels = new.select("id", "label")
        if new.where("moved").isEmpty():
            return labels


def _rings(edges: DataFrame) -> DataFrame:
    """(component, id) of the cycles whose nodes have no other edge out; component is the smallest member.

    Where a node has one edge out, ways are told by pointers, which are doubled each round: only nodes that some pointer
    leads to go on, so a round takes off twice the length that the last one did from all ways into cycles, and what is
    left shrinks as fast. When no node goes, all are on cycles. Their smallest members come about by doubling, too.
    """
    alone = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1").select(F.col("source").alias("a"), F.col("target").alias("b"))
    first = step = settled(alone)
    left = step.count()
    while left:
        met = step.select(F.col("b").alias("__i")).distinct()
        step = settled(step.join(met, F.col("a") == F.col("__i"), "left_semi").join(step.select(F.col("a").alias("__a"), F.col("b").alias("__b")), F.col("b") == F.col("__a")).select("a", F.col("__b").alias("b")))
        before, left = left, step.count()
        if left == before:
            break
    ring = settled(first.join(step.select(F.col("a").alias("__a")), F.col("a") == F.col("__a"), "left_semi").select("a", "b", F.least("a", "b").alias("low"), F.lit(True).alias("moved")))
    # low: the smallest of the nodes from a up to b, which is twice as far each round
    while not ring.where("moved").isEmpty():
        on = ring.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("low").alias("__low"))
        ring = settled(ring.join(on, F.col("b") == F.col("__a")).select("a", F.col("__b").alias("b"), F.least("low", "__low").alias("low"), (F.col("__low") < F.col("low")).alias("moved")))
    return ring.select(F.col("low").alias("component"), F.col("a").alias("id"))


def _in_rounds(edges: DataFrame, small: int) -> DataFrame:
    """Cycles that no edge leaves are found first. If a node has more edges out than one, the graph without them goes on: to
    one task, where it has become small, or to rounds of colours."""
    rings = settled(_rings(edges))
    if edges.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rings
    known = rings.select(F.col("id").alias("__r"))
    rest = _trimmed(settled(edges.join(known, F.col("source") == F.col("__r"), "left_anti").join(known, F.col("target") == F.col("__r"), "left_anti")))
    return rings.unionByName(_in_one_task(rest) if rest.limit(small + 1).count() <= small else _coloured(rest))


def _in_one_task(edges: DataFrame) -> DataFrame:
    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_one_task, "component string, id string")


def _coloured(edges: DataFrame) -> DataFrame:
    """Each round colours a node by the first node that reaches it, in an order by hash that each round has anew; those of
    a colour that reach its first node are a component. What is left goes on to the next round, without the edges between
    colours. By the random order colours cut paths as quicksort cuts a list: a chain of n nodes takes about log n rounds."""
    done, turn = None, 0
    while not edges.isEmpty():
        nodes = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
        label = lambda m, turn=turn: F.struct(m.alias("m"), F.xxhash64(F.lit(turn), "id").alias("rank"), F.col("id").alias("node")).alias("label")
        colour = _spread(settled(nodes.select("id", label(F.lit(0)))), edges.select(F.col("source").alias("a"), F.col("target").alias("b"))).select("id", F.col("label.node").alias("root"))
        of = lambda x, c=colour: c.select(F.col("id").alias(x), F.col("root").alias(f"c_{x}"))
        same = settled(edges.join(of("s"), F.col("source") == F.col("s")).join(of("t"), F.col("target") == F.col("t")).where("c_s = c_t").select("source", "target"))
        # backwards from each colour's first node, which has m = 0
        marked = colour.select("id", label(F.when(F.col("id") == F.col("root"), 0).otherwise(1)))
        reach = _spread(settled(marked), same.select(F.col("target").alias("a"), F.col("source").alias("b")))
        found = settled(colour.join(reach.where("label.m = 0").select(F.col("id").alias("r")), F.col("id") == F.col("r"), "left_semi"))
        done = found if done is None else done.unionByName(found)
        gone = found.select(F.col("id").alias("g"))
        edges = _trimmed(same.join(gone, F.col("source") == F.col("g"), "left_anti").join(gone, F.col("target") == F.col("g"), "left_anti"))
        turn += 1
    if done is None:
        return edges.select(F.col("source").alias("component"), F.col("source").alias("id"))
    firsts = done.groupBy(F.col("root").alias("__r")).agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return done.join(firsts, F.col("root") == F.col("__r")).select("component", "id")


def strong_components(pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """(component, id) for the nodes of strongly connected components of two or more; component is the smallest member.

    pairs (source, target) may have loops, repeats and nulls. Their number decides the way: up to `small` distinct pairs
    go to one task; more are worked on in rounds of joins, whose tables are checkpointed.
    """
    edges = inner(pairs).select("source", "target").distinct()
    if edges.limit(small + 1).count() <= small:
        return _in_one_task(edges)
    return _in_rounds(settled(edges), small)


def cycle_edges(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """(component, source, target): the pair edges inside components, a row each, for components of any size."""
    of = lambda x: components.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    among = inner(pairs).select("source", "target").distinct().join(of("s"), F.col("source") == F.col("s")).join(of("t"), F.col("target") == F.col("t"))
    return among.where("c_s = c_t").select(F.col("c_s").alias("component"), "source", "target")


def cycle_findings(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """(component, members, evidence): each component's sorted members, and the pair edges among them, as 'a->b'. A finding
    is read by people and so is one row; components and cycle_edges have the same as rows."""
    evidence = cycle_edges(pairs, components).groupBy(F.col("component").alias("__c")).agg(F.sort_array(F.collect_list(F.concat("source", F.lit("->"), "target"))).alias("evidence"))
    members = components.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return members.join(evidence, F.col("component") == F.col("__c")).select("component", "members", "evidence")


def orphan_triage(modules: DataFrame, pairs: DataFrame, externals: DataFrame) -> DataFrame:
    """(id, triage): normal with an edge to or from another module; else third_party_only with one to an external; else
    isolated."""
    ids = modules.select("id").distinct()
    known = ids.select(F.col("id").alias("__id"))
    other = inner(pairs).select("source", "target").distinct()
    mutual = other.join(known, F.col("source") == F.col("__id"), "left_semi").join(known, F.col("target") == F.col("__id"), "left_semi")
    linked = mutual.select(F.col("source").alias("__n")).unionByName(mutual.select(F.col("target").alias("__n"))).distinct()
    far = other.join(externals.select(F.col("id").alias("__e")).distinct(), F.col("target") == F.col("__e"), "left_semi").select(F.col("source").alias("__f")).distinct()
    rows = ids.join(linked, F.col("id") == F.col("__n"), "left").join(far, F.col("id") == F.col("__f"), "left")
    return rows.select("id", F.when(F.col("__n").isNotNull(), "normal").when(F.col("__f").isNotNull(), "third_party_only").otherwise("isolated").alias("triage"))


def findings(modules: DataFrame, pairs: DataFrame, externals: DataFrame, small: int = SMALL) -> DataFrame:
    """(code, severity, subject, evidence, message): a cycle is an error, each orphan kind a warning. None for no modules."""
    ids = modules.select(F.col("id").alias("__id")).distinct()
    own = inner(pairs).join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")
    cycles = cycle_findings(own, strong_components(own, small)).select(
        F.lit("cycle").alias("code"), F.lit("error").alias("severity"), F.array_join("members", ", ").alias("subject"), "evidence",
        F.concat(F.lit("cycle of "), F.size("members").cast("string"), F.lit(" modules")).alias("message"),
    )
    orphans = orphan_triage(modules, pairs, externals).where("triage <> 'normal'").select(
        F.col("triage").alias("code"), F.lit("warning").alias("severity"), F.col("id").alias("subject"), F.array().cast("array<string>").alias("evidence"),
        F.when(F.col("triage") == "isolated", "no edge to or from another module").otherwise("edges to third-party modules only").alias("message"),
    )
    return cycles.unionByName(orphans)


def finding_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
