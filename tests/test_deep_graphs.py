"""Deep graphs: long ways take few rounds, and give what a walk in plain Python gives."""

import random

import pytest

from plumbline.functions.pyfacts import py_facts
from plumbline.operators import contracts, diagram, findings, reach, resolve, stars
from plumbline.operators.findings import _one_task
from plumbline.sources.store import settled


def jobs(spark, work):
    """What work gives, and how many jobs it took."""
    group = f"deep-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def one_way(n, seed):
    """A chain of n nodes, and half as many that each depend on some node of it; the chain ends in a cycle of five."""
    r = random.Random(seed)
    pairs = [(f"c{i:04}", f"c{i + 1:04}") for i in range(n)] + [(f"s{i}", f"c{r.randrange(n):04}") for i in range(n // 2)]
    return pairs + [(f"c{n:04}", "r0"), *((f"r{i}", f"r{(i + 1) % 5}") for i in range(5))]


@pytest.mark.parametrize("more", [[], [("s0", "r3"), ("s1", "s0"), ("c0005", "c0002")]])
def test_components_in_rounds(spark, more):
    pairs = one_way(300, 1) + [(f"x{i}", f"x{(i + 1) % 64}") for i in range(64)] + more
    df = spark.createDataFrame(pairs, "source string, target string")
    found, n = jobs(spark, lambda: {tuple(r) for r in findings.strong_components(df, small=100 if more else 0).collect()})
    assert found == {tuple(r) for r in _one_task(df.toPandas()).itertuples(index=False)} and len(found) == 69 + (4 if more else 0)
    assert more or n < 120


def test_long_ways(spark):
    pairs = one_way(300, 2)
    df = spark.createDataFrame(pairs, "source string, target string")
    found, n = jobs(spark, lambda: {r["id"]: (r["hops"], r["origin"]) for r in reach.impact(df, spark.createDataFrame([("r2",), ("c0100",)], "id string")).collect()})
    at = lambda i: (100 - i, "c0100") if i <= 100 else (301 - i, "r2")
    expected = {f"c{i:04}": at(i) for i in range(301)} | {f"r{i}": (0, "r2") for i in range(5)}
    expected |= {s: (at(int(t[1:]))[0] + 1, at(int(t[1:]))[1]) for s, t in pairs if s[0] == "s"}
    assert found == expected and n < 120
    rules = spark.createDataFrame([("far", "s1", "r4"), ("near", "c0000", "c0150"), ("none", "r0", "c0001")], "rule string, source string, target string")
    found = {(r["rule"], r["id"], r["hops"], r["via_source"], r["via_target"]) for r in contracts.forbidden_paths(df, rules).collect()}
    assert found == {("far", "s1", expected["s1"][0] + (expected["s1"][1] == "c0100") * 201, "s1", dict(pairs)["s1"]), ("near", "c0000", 150, "c0000", "c0001")}


def test_many_layers(spark):
    pairs = one_way(150, 3)
    df = spark.createDataFrame(pairs, "source string, target string")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "id string")
    one, n = jobs(spark, lambda: sorted(map(tuple, diagram.arranged(nodes, df).collect())))
    assert n < 80
    layer = {f"s{i}": 0 for i in range(75)} | {"c0000": 0}
    above = {t: [s for s, x in pairs if x == t] for _, t in pairs}
    for i in range(1, 151):
        layer[f"c{i:04}"] = 1 + max(layer[s] for s in above[f"c{i:04}"])
    assert {r[0]: r[2] for r in one} == layer | {f"r{i}": layer["c0150"] + 1 for i in range(5)}


@pytest.mark.parametrize("seed", [4, 5])
def test_layers_by_rounds_and_by_one_task(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{a}", f"n{b}") for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(70)) if a < b or a % 7 == 0]
    df = spark.createDataFrame(pairs, "source string, target string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(40)], "id string")
    by = lambda small: sorted(map(tuple, diagram.arranged(nodes, df, small=small).collect()))
    assert by(0) == by(20) == by(10**6)


def test_long_chains_of_star_imports(spark):
    files = [("m000.py", "def name_000():\n    pass\n")] + [(f"m{i:03}.py", f"from m{i - 1:03} import *\ndef name_{i:03}():\n    pass\n") for i in range(1, 40)]
    files += [("a.py", "from b import *\nx = 1\n"), ("b.py", "from a import *\ny = 1\n")]
    df = spark.createDataFrame(files, "module_id string, content string")
    facts, index = settled(py_facts(df)), resolve.module_index(df)
    imports = settled(resolve.located_imports(facts, index))
    found, n = jobs(spark, lambda: {tuple(r) for r in stars.public_names(facts, imports, index).collect()})
    assert found == {(f"m{i:03}.py", f"name_{k:03}") for i in range(40) for k in range(i + 1)} | {(m, x) for m in ("a.py", "b.py") for x in "xy"}
    assert n < 100
