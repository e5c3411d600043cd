"""Graph, finding, grouping, digest and layout operators on small frames, components on random graphs."""

import random

import pytest

from plumbline.operators import digest, findings, graph, grouping, layout

PAIR = "source string, target string"


def pairs(spark, *rows):
    return spark.createDataFrame([tuple(r.split(">")) for r in rows], PAIR)


def slow_components(edges):
    reach = {}
    nodes = {n for e in edges for n in e}
    for n in nodes:
        seen, stack = set(), [n]
        while stack:
            for a, b in edges:
                if a == stack[-1] and b not in seen:
                    seen.add(b)
                    stack.insert(0, b)
            stack.pop()
        reach[n] = seen
    return {(min(m for m in nodes if m == n or m in reach[n] and n in reach[m]), n) for n in nodes if any(m != n and m in reach[n] and n in reach[m] for m in nodes)}


@pytest.mark.parametrize("rows", [["a>b", "b>a"], ["a>b", "b>c", "c>a", "c>d", "d>e", "e>d", "e>f"], ["a>b", "b>c", "a>c"], ["a>a"], []])
def test_components(spark, rows):
    edges = pairs(spark, *rows)
    expected = slow_components([tuple(r.split(">")) for r in rows if r[0] != r[2]])
    assert {tuple(r) for r in findings.strong_components(edges).collect()} == expected
    assert {tuple(r) for r in findings.strong_components(edges, small=0).collect()} == expected


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    for n, m in ((12, 16), (25, 40)):
        edges = [(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)]
        expected = slow_components([e for e in set(edges) if e[0] != e[1]])
        frame = spark.createDataFrame(edges, PAIR)
        assert {tuple(x) for x in findings.strong_components(frame).collect()} == expected
        assert {tuple(x) for x in findings.strong_components(frame, small=1).collect()} == expected


def test_findings(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    edges = pairs(spark, "a>b", "b>a", "c>np", "d>d", "a>np")
    found = {(r.code, r.subject): r for r in findings.findings(ids("a", "b", "c", "d"), edges, ids("np")).collect()}
    assert set(found) == {("cycle", "a, b"), ("third_party_only", "c"), ("isolated", "d")}
    assert found["cycle", "a, b"].evidence == ["a->b", "b->a"] and found["cycle", "a, b"].severity == "error"
    assert findings.findings(ids().limit(0), edges.limit(0), ids().limit(0)).count() == 0


def test_depth(spark):
    ports = spark.createDataFrame([("a", 50), ("b", 15), ("c", 14), ("d", 10), ("d", 100)], "moduleId string, line int")
    out = {r.id: (r.n_ports, r.ratio, r.depth) for r in findings.depth_scores(spark.createDataFrame([(x,) for x in "abcde"], "id string"), ports).collect()}
    assert out == {"a": (1, 50, "deep"), "b": (1, 15, "moderate"), "c": (1, 14, "shallow"), "d": (2, 50, "deep"), "e": (0, 0, "shallow")}


def test_edges(spark):
    raw = spark.createDataFrame([("a", "b", None, "call", 3, 4, 0), ("a", "b", None, "call", 1, 4, 1), ("a", "b", None, "call", 3, 4, 2), ("a", "b", "p", "import", 2, 3, 0)], "source string, target string, targetPort string, kind string, line int, stage int, seq int")
    merged = graph.merge_edges(raw)
    assert {(r.targetPort, tuple(r.sites)) for r in merged.collect()} == {(None, (1, 3)), ("p", (2,))}
    (pair,) = graph.pair_evidence(merged).collect()
    assert pair.kinds == ["call", "import"] and len(pair.raw) == 2
    known = graph.pair_edges(merged)
    proposed = pairs(spark, "a>b", "a>b", "b>a", "a>c", "a>a", "x>a")
    out = {(r.source, r.target): (r.ok, r.code) for r in graph.check_edges(proposed, known, spark.createDataFrame([("x",)], "id string")).collect()}
    assert out == {("a", "b"): (True, "real"), ("b", "a"): (False, "reversed"), ("a", "c"): (False, "none"), ("a", "a"): (False, "blocked"), ("x", "a"): (False, "blocked")}
    assert [tuple(r) for r in graph.real_only(proposed, known).collect()] == [("a", "b")]


def test_quotient_and_facades(spark):
    edges = spark.createDataFrame([("a", "b", "call"), ("a", "c", "call"), ("b", "c", "import"), ("a", "zz", "call")], PAIR + ", kind string")
    groups = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "group_id string, file string")
    assert [(r.source, r.target, r.kinds, r.n_raw) for r in graph.quotient(edges, groups).collect()] == [("g", "h", ["call", "import"], 2)]
    rows = [("u.py", "p/__init__.py", "T", "from_import"), ("p/__init__.py", "p/t.py", "T", "from_import"), ("u.py", "p/__init__.py", None, "import")]
    out = {tuple(r) for r in graph.through_facades(spark.createDataFrame(rows, "source string, target string, targetPort string, kind string")).collect()}
    assert out == {("u.py", "p/t.py", "T", "from_import"), rows[1], rows[2]}
    assert [r.id for r in graph.production(spark.createDataFrame([("a/b.py",), ("tests/x.py",), ("a/fixtures/y.py",), ("a/__init__.py",), ("contests/z.py",)], "id string")).orderBy("id").collect()] == ["a/b.py", "contests/z.py"]


def test_groupings(spark):
    rows = lambda text: spark.createDataFrame([tuple(x.split(":")) for x in text.split()], "group_id string, file string")
    truth, candidate = rows("a:1 a:2 a:3 b:4 b:5 c:6"), rows("x:1 x:2 y:3 y:4 x:5 z:7")
    matches = {r.truth_group: (r.candidate_group, r.overlap) for r in grouping.best_matches(truth, candidate).collect()}
    assert matches == {"a": ("x", 2), "b": ("x", 1), "c": (None, 0)}
    (row,) = grouping.accuracy(grouping.placed_files(truth, candidate)).collect()
    assert tuple(row) == (6, 3, 1, 1, 0.5)
    files = spark.createDataFrame([("1",), ("2",), ("9",), ("tests/t",)], "file string")
    manifest = spark.createDataFrame([("a", "1", 0), ("b", "1", 0), ("b", "tests/t", 1), ("c", None, 0), ("d", "nope", 0)], "group_id string, file string, declared int")
    assert {tuple(r) for r in grouping.violations(manifest, files).collect()} == {
        ("shared_file", "1"), ("noise_file", "tests/t"), ("empty_group", "c"), ("unknown_file", "nope"), ("uncovered_file", "2"), ("uncovered_file", "9"), ("duplicate_group", "b"),
    }
    assert {r.file for r in grouping.unassigned(files, manifest).collect()} == {"2", "9"}


def test_digest_ladder(spark):
    from plumbline.plans.scan import scan_files
    from plumbline.sources.files import memory_files

    found = scan_files(memory_files(spark, {"a.py": 'import b\nimport far\ndef run(alpha, beta):\n    """Does it all. Really."""\ndef a_rather_long_name_of_a_function(): pass\n', "b.py": ""}))
    sizes = []
    for budget in (10_000, 390, 330, 290, 200, 150):
        level, out = digest.ladder(found.modules, found.ports, found.edges, budget)
        bodies = {r.id: r.body for r in out.collect()}
        sizes.append((level, sum(map(len, bodies.values()))))
        assert set(bodies) == {"a.py", "b.py"} and '"imports":["b.py","far"]' in bodies["a.py"]
        assert level == 4 or sizes[-1][1] <= budget
    assert [s[0] for s in sizes] == sorted(s[0] for s in sizes) and sizes[0][0] == 0 and sizes[-1][0] == 4


def test_layout(spark):
    ids = layout.node_ids(spark.createDataFrame([("a/_b/c.py",), ("a/b/c.js",), ("x-y.py",), (None,)], "id string"))
    assert {r.id: r.node for r in ids.collect()} == {"a/_b/c.py": "a__b__c", "a/b/c.js": "a__b__c", "x-y.py": "x_y"}
    assert [tuple(r) for r in layout.collisions(ids).collect()] == [("a__b__c", 2, "a/_b/c.py")]
    assert [(r.x, r.y) for r in layout.grid(ids, 2).orderBy("id").collect()] == [(0, 0), (200, 0), (0, 100)]
