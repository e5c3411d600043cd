"""Impact, contracts and packages on random graphs, against plain Python."""

import random

import pytest

from plumbline.operators import contracts, graph, reach


def closure(pairs):
    """Each node's distances to all that it reaches, counted between units; and the units."""
    nodes = sorted({x for p in pairs for x in p if x is not None})
    out = {n: {t for s, t in pairs if s == n and t not in (None, n)} for n in nodes}

    def reached(n):
        seen, todo = set(), [n]
        while todo:
            for t in out[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return seen

    far = {n: reached(n) for n in nodes}
    unit = {n: min([n, *(m for m in far[n] if n in far[m])]) for n in nodes}
    links = {}
    for s in nodes:
        for t in out[s]:
            if unit[s] != unit[t]:
                links[unit[s], unit[t]] = min(links.get((unit[s], unit[t]), (s, t)), (s, t))
    return nodes, out, unit, links


def away(starts, links):
    """{unit: (hops, origin, edge)} against the links."""
    known = {}
    for unit, origin in starts:
        known[unit] = min(known.get(unit, (0, origin, None)), (0, origin, None))
    front, hop = dict(known), 0
    while front:
        hop, near = hop + 1, {}
        for (a, b), e in links.items():
            if b in front and a not in known:
                near[a] = min(near.get(a, (hop, front[b][1], e)), (hop, front[b][1], e))
        known |= near
        front = near
    return known


def random_pairs(seed, n=40, m=60):
    r = random.Random(seed)
    name = lambda: f"{r.choice('ab')}/{r.choice('xyz')}/m{r.randrange(n)}"
    nodes = [name() for _ in range(n)]
    pairs = [(r.choice(nodes), r.choice(nodes)) for _ in range(m)]
    return pairs + pairs[:3] + [(None, nodes[0]), (nodes[1], None), (nodes[2], nodes[2])]


@pytest.mark.parametrize("seed, small", [(1, 10**6), (2, 10**6), (3, 0)])
def test_impact(spark, seed, small):
    pairs = random_pairs(seed)
    nodes, _, unit, links = closure(pairs)
    changed = random.Random(seed).sample(nodes, 4) + ["alone"]
    known = away([(unit.get(c, c), c) for c in changed], links)
    expected = {n: known[unit[n]] for n in nodes if unit[n] in known} | {"alone": (0, "alone", None)}
    df = spark.createDataFrame(pairs, "source string, target string")
    found = reach.impact(df, spark.createDataFrame([(c,) for c in [*changed, None, changed[0]]], "id string"), small=small)
    assert {r["id"]: (r["hops"], r["origin"], (r["via_source"], r["via_target"]) if r["hops"] else None) for r in found.collect()} == expected
    sizes = {r["origin"]: (r["n"], r["furthest"]) for r in reach.impact_sizes(found).collect()}
    assert sum(n for n, _ in sizes.values()) == len(expected)
    near = reach.impact(df, spark.createDataFrame([(c,) for c in changed], "id string"), most=1, small=small)
    assert {r["id"] for r in near.collect()} == {n for n, (hops, *_) in expected.items() if hops <= 1}


def test_impact_of_nothing(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert reach.impact(none, spark.createDataFrame([], "id string")).count() == 0
    assert [tuple(r) for r in reach.impact(none, spark.createDataFrame([("x",)], "id string")).collect()] == [("x", 0, "x", None, None)]


def prefixes(path):
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(len(parts) + 1)]


@pytest.mark.parametrize("seed", [4, 5])
def test_rules(spark, seed):
    pairs, r = random_pairs(seed), random.Random(seed)
    patterns = ["", "a", "b", "a/x", "b/y", "a/z", "a/x/m1", "never"]
    rules = [(f"r{i}", r.choice(patterns), r.choice(patterns), r.random() < 0.5) for i in range(12)]
    found = contracts.decided(spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame(rules, "rule string, source string, target string, allowed boolean"))
    rows = {(x["source"], x["target"]): (x["rule"], x["allowed"]) for x in found.collect()}
    edges = {(s, t) for s, t in pairs if s and t and s != t}
    depth = lambda p: len(p.split("/")) if p else 0
    expected = {}
    for s, t in edges:
        hits = [(-depth(a) - depth(b), -depth(a), ok, name) for name, a, b, ok in rules if a in prefixes(s) and b in prefixes(t)]
        best = min(hits, default=None)
        expected[s, t] = (best[3], best[2]) if best else (None, True)
    assert rows == expected
    none = contracts.decided(spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame([], "rule string, source string, target string, allowed boolean"), default=False)
    assert {(x["rule"], x["allowed"]) for x in none.collect()} == {(None, False)}


def test_layers(spark):
    layers = spark.createDataFrame([("top", "a", 0), ("low", "b", 2), ("mid", "b/y", 1), ("low", "b/y/deep", 2)], "layer string, pattern string, rank int")
    pairs = [("a/1", "b/1"), ("b/1", "a/1"), ("b/y/1", "b/1"), ("b/1", "b/y/1"), ("b/y/deep/1", "b/1"), ("b/yes", "b/y/1"), ("c", "a/1"), ("a/1", "b/y/1")]
    df = spark.createDataFrame(pairs, "source string, target string")
    rows = lambda **how: {(r["source"], r["target"], r["source_layer"], r["target_layer"], r["code"]) for r in contracts.layer_breaks(df, layers, **how).collect()}
    upward = {("b/1", "a/1", "low", "top", "upward"), ("b/1", "b/y/1", "low", "mid", "upward"), ("b/yes", "b/y/1", "low", "mid", "upward")}
    assert rows() == upward and rows(closed=True) == upward | {("a/1", "b/1", "top", "low", "skips")}


@pytest.mark.parametrize("seed", [6, 7])
def test_forbidden_paths(spark, seed):
    pairs = random_pairs(seed, 30, 60)
    nodes, out, unit, links = closure(pairs)
    rules = [("one", "a/x", "b/y"), ("all", "", "a/z"), ("same", "b", "b"), ("none", "a", "never")]
    found = contracts.forbidden_paths(spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame(rules, "rule string, source string, target string"))
    rows = {(r["rule"], r["id"]): (r["hops"], r["via_source"], r["via_target"]) for r in found.collect()}
    linked = {x for s, t in pairs if s and t and s != t for x in (s, t)}
    expected = {}
    for rule, a, b in rules:
        goals = [n for n in linked if b in prefixes(n)]
        known = away([(unit[g], "") for g in goals], links)
        for n in linked:
            if a in prefixes(n) and unit[n] in known:
                hops, _, edge = known[unit[n]]
                if hops:
                    expected[rule, n] = (hops, *edge)
                elif any(g != n and unit[g] == unit[n] for g in goals):
                    expected[rule, n] = (0, n, min(t for t in out[n] if unit[t] == unit[n]))
    assert rows == expected and len(expected) > 3


def test_packages_at_every_depth(spark):
    edges = [("a/x/1", "a/y/2", "call"), ("a/x/1", "a/y/3", "import"), ("a/x/1", "b", "call"), ("a/x/1", "a/x/1", "call"), (None, "b", "call"), ("c/d/e/f", "c/d/e/g", "call")]
    found = graph.rolled_up(spark.createDataFrame(edges, "source string, target string, kind string"))
    assert sorted((r["depth"], r["source"], r["target"], r["kinds"], r["n_raw"]) for r in found.collect()) == sorted([
        (1, "a", "b", ["call"], 1), (2, "a/x", "b", ["call"], 1), (3, "a/x/1", "b", ["call"], 1), (2, "a/x", "a/y", ["call", "import"], 2),
        (3, "a/x/1", "a/y/2", ["call"], 1), (3, "a/x/1", "a/y/3", ["import"], 1), (4, "c/d/e/f", "c/d/e/g", ["call"], 1),
    ])
