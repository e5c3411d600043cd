"""Whole scans: a package of our own, seen from inside and from above; stars; streams; the command line."""

import json

import pytest

from plumbline.plans.scan import as_dict, scan_codebase, scan_files
from plumbline.sources import sinks
from plumbline.sources.files import EmptyScan, guarded, memory_files, source_files

SHOP = {
    "shop/__init__.py": "from .stock import Item, count\n__all__ = ['Item', 'count', 'LIMIT']\n",
    "shop/stock.py": '"""Stock."""\nimport os\nimport os.path\nimport numpy as np\n\n\nclass Item(dict):\n    """One thing. Sold."""\n\n\ndef count(items, *, total=0) -> "Item":\n    return np.sum(items) + _own()\n\n\ndef _own():\n    return os.getcwd()\n',
    "shop/till/__init__.py": "",
    "shop/till/cash.py": "from ..stock import Item as Thing, missing\nfrom .. import stock\nfrom . import card\nfrom shop import LIMIT\nimport shop.stock\nimport shop.nothing\nfrom shop.nothing import gone\n\n\n@stock.count\ndef pay(x: Thing) -> stock.Item:\n    y = Thing.make()\n    y.z()\n    shop.stock.count(x)\n    return undefined(other.thing)\n\n\nclass Big(Thing):\n    pass\n",
    "shop/till/card.py": "def swipe(): return len('x')\n",
    "broken.py": "def (:\n",
    "venv/lib/skipped.py": "x = 1\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("code")
    for name, text in SHOP.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)
    return at


@pytest.fixture(scope="module")
def graph(spark, root):
    return scan_codebase(spark, str(root))


def edges(g, **want):
    return {(e["target"], e.get("targetPort"), e["kind"], tuple(s["line"] for s in e["sites"])) for e in g["edges"] if all(e[k] == v for k, v in want.items())}


def test_modules_in_order_of_components(graph):
    assert list(graph) == ["modules", "ports", "edges", "externalModules", "diagnostics", "intra"]
    assert [m["id"] for m in graph["modules"]] == ["shop/__init__.py", "shop/stock.py", "shop/till/__init__.py", "shop/till/card.py", "shop/till/cash.py"]
    assert set(graph["intra"]) == {m["id"] for m in graph["modules"]}


def test_edges(graph):
    assert edges(graph, source="shop/__init__.py") == {("shop/stock.py", "Item", "from_import", (1,)), ("shop/stock.py", "count", "from_import", (1,))}
    assert edges(graph, source="shop/stock.py") == {("os.path", None, "import", (3,)), ("numpy", None, "import", (4,)), ("numpy", "sum", "call", (12,))}
    assert edges(graph, source="shop/till/cash.py") == {
        ("shop/stock.py", "Item", "from_import", (1,)), ("shop/stock.py", None, "from_import", (1, 2)), ("shop/till/card.py", None, "from_import", (3,)),
        ("shop/__init__.py", "LIMIT", "from_import", (4,)), ("shop/stock.py", None, "import", (5,)), ("shop/__init__.py", None, "import", (6,)),
        ("shop/stock.py", "count", "decorator", (10,)), ("shop/stock.py", "Item", "annotation", (11,)), ("shop/stock.py", None, "call", (12,)),
        ("shop/stock.py", "count", "call", (14,)), ("shop/stock.py", "Item", "inheritance", (18,)),
    }
    keys = [(e["source"], e["target"], e["kind"], e["sites"][0]["line"]) for e in graph["edges"]]
    assert keys == sorted(keys)


def test_externals_and_diagnostics(graph):
    assert [x["id"] for x in graph["externalModules"]] == ["numpy", "os.path"]
    got = [(d["kind"], d["moduleId"], d["line"], d["message"]) for d in graph["diagnostics"]]
    assert got == [
        ("parse_error", "broken.py", 1, "syntax error: invalid syntax"),
        ("unresolved_symbol", "shop/till/cash.py", 7, "unresolved symbol 'gone'"), ("unresolved_symbol", "shop/till/cash.py", 15, "unresolved symbol 'undefined'"),
    ]


def test_ports_leave_out_missing_docstrings(graph):
    ports = {(p["moduleId"], p["name"]): p for p in graph["ports"]}
    assert ports["shop/stock.py", "Item"]["docstring"] == "One thing." and "docstring" not in ports["shop/stock.py", "count"]
    assert ports["shop/stock.py", "count"]["signature"] == "(items, *, total=0) -> Item" and ports["shop/__init__.py", "LIMIT"]["kind"] == "export"


def test_from_inside_the_own_name_is_foreign(spark, root):
    inside = scan_codebase(spark, str(root / "shop"))
    assert "shop" in [x["id"] for x in inside["externalModules"]] and ("shop", "LIMIT", "from_import", (4,)) in edges(inside, source="till/cash.py")


def test_relative_import_of_nothing_in_the_root(spark):
    g = as_dict(scan_files(memory_files(spark, {"a.py": "from . import missing\nfrom .... import deep\n"})))
    assert [x["id"] for x in g["externalModules"]] == [""] and {e["target"] for e in g["edges"]} == {""}


def test_stdlib_by_root(spark):
    frame = memory_files(spark, {"a.py": "import os.path\nfrom collections.abc import Mapping\n"})
    assert len(as_dict(scan_files(frame))["edges"]) == 2 and as_dict(scan_files(frame, by_root=True))["edges"] == []


def test_stars(spark):
    g = as_dict(scan_files(memory_files(spark, {
        "one.py": "from lib import *\n" + "".join(f"n{i}()\n" for i in range(7)) + "n0()\na.b()\n",
        "two.py": "from lib import *\nfrom . import *\nzap()\n", "all.py": "from lib import *\nlen('')\n", "none.py": "zap()\n",
    })))
    text = "1 unresolved symbol(s) in this module may come from star import of {} (e.g. 'zap'); per-site diagnostics aggregated"
    assert [(d["moduleId"], d["line"], d["message"]) for d in g["diagnostics"]] == [
        ("none.py", 1, "unresolved symbol 'zap'"),
        ("one.py", 1, "8 unresolved symbol(s) in this module may come from star import of 'lib' (e.g. 'a.b', 'n0', 'n1', 'n2', 'n3' (+3 more)); per-site diagnostics aggregated"),
        ("two.py", 1, text.format("'lib'")), ("two.py", 2, text.format("'.'")),
    ]
    assert {(e["source"], e.get("targetPort")) for e in g["edges"] if e["target"] == "lib"} == {(m, "*") for m in ("one.py", "two.py", "all.py")}


def test_symbol_precedence(spark):
    g = as_dict(scan_files(memory_files(spark, {
        "m.py": "import p.q as r\nimport p.s\nfrom k import p as t, u\nimport u.v\np.f()\nt()\nu()\n",
    })))
    assert edges(g, kind="call") == {("p.q", "f", "call", (5,)), ("k", "p", "call", (6,)), ("k", "u", "call", (7,))}


def test_same_result_however_dealt_out(spark, root):
    frame = source_files(spark, str(root))
    results = {json.dumps(as_dict(scan_files(frame.repartition(n))), sort_keys=True) for n in (1, 7)}
    assert len(results) == 1


def test_exclusion_and_empty_scans(spark, root, tmp_path):
    ids = {r[0] for r in source_files(spark, str(root), {"till"}).select("module_id").collect()}
    assert ids == {"broken.py", "shop/__init__.py", "shop/stock.py"}
    stored = {r[0] for r in source_files(spark, f"file://{root}", {"till"}).select("module_id").collect()}
    assert stored == ids
    with pytest.raises(EmptyScan):
        guarded(source_files(spark, str(tmp_path)))
    assert as_dict(scan_files(source_files(spark, str(tmp_path))))["modules"] == []


def test_command_line_and_sinks(spark, root, tmp_path, monkeypatch, capsys):
    from plumbline.__main__ import main

    out = tmp_path / "deep" / "graph.json"
    assert main([str(root / "shop" / "till"), "--output", str(out)]) == 0
    assert [m["id"] for m in json.loads(out.read_text())["modules"]] == ["__init__.py", "card.py", "cash.py"]
    assert main([str(tmp_path / "deep")]) == 1
    found = scan_files(memory_files(spark, {"a.py": "import zlib9\n"}))
    sinks.write_tables(found.tables(), f"file://{tmp_path}/tables")
    assert spark.read.parquet(f"file://{tmp_path}/tables/edges").count() == 1
    sinks.append_log(found.externals, f"file://{tmp_path}/log", "r1", "scan")
    sinks.append_log(found.externals, f"file://{tmp_path}/log", "r1", "score")
    assert {r.role for r in spark.read.json(f"file://{tmp_path}/log").collect()} == {"scan", "score"}
    assert sinks.report("ok", {"externals": found.externals})["externals"][0]["id"] == "zlib9"


def test_stream_of_files(spark, root, tmp_path):
    from plumbline.streaming.rescan import watch

    seen = []
    (tmp_path / "code").mkdir()
    for name in ("a", "b"):
        (tmp_path / "code" / f"{name}.py").write_text("import json\nimport far\n")
        watch(spark, str(tmp_path / "code"), f"file://{tmp_path}/store", f"file://{tmp_path}/check", lambda df: seen.append(sorted(m.id for m in scan_files(df).modules.collect()))).awaitTermination(120)
    assert seen == [["a.py"], ["a.py", "b.py"]]


def test_stream_keeps_facts(spark, tmp_path):
    from plumbline.streaming.rescan import watch_graph

    seen = []
    (tmp_path / "code").mkdir()
    for name, text in (("a", "import far\n"), ("b", "from a import run\nrun()\n"), ("a2", "def run():\n    pass\n")):
        (tmp_path / "code" / f"{name}.py").write_text(text)
        watch_graph(spark, str(tmp_path / "code"), f"file://{tmp_path}/store", f"file://{tmp_path}/check", lambda g: seen.append((g.modules.count(), sorted((e.source, e.target) for e in g.edges.collect())))).awaitTermination(120)
    assert seen[0] == (1, [("a.py", "far")]) and seen[1] == (2, [("a.py", "far"), ("b.py", "a.py"), ("b.py", "a.py")]) and seen[2][0] == 3


def test_listing_prunes_whole_trees_and_keeps_odd_names(spark, tmp_path):
    from plumbline.sources.files import listed

    for path in ("a/b/c/deep.py", "a/_private.py", "a/__init__.py", "a b/ü.py", "venv/x/y.py", "a/skip/z.py", "a/notes.txt", "a/b/dir.py/inner.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    (tmp_path / "a" / "round").symlink_to(tmp_path)
    files = {r["module_id"] for r in source_files(spark, str(tmp_path), {"skip"}).collect()}
    assert files == {"a/b/c/deep.py", "a/_private.py", "a/__init__.py", "a b/ü.py", "a/b/dir.py/inner.py"}
    names = {r["name"] for r in listed(spark, str(tmp_path), frozenset({"venv"}), per_task=1).collect()}
    assert {"dir.py", "notes.txt"} <= names and not {"venv", "x", "y.py", "round"} & names


def test_document_by_executors_is_the_document(spark, root, tmp_path):
    from plumbline.plans.scan import sections

    found = scan_files(source_files(spark, str(root)))
    whole = as_dict(found)
    sinks.write_sections(sections(found), f"file://{tmp_path}/graph")
    read = lambda name: [json.loads(line) for f in sorted((tmp_path / "graph" / name).glob("part-*.txt")) for line in f.read_text().splitlines()]
    for name in ("modules", "ports", "edges", "externalModules", "diagnostics"):
        assert read(name) == whole[name]
    assert {r["id"]: {"funcs": r["funcs"], "calls": r["calls"]} for r in read("intra")} == whole["intra"]


def test_files_that_cannot_be_read_end_a_scan(spark, tmp_path):
    (tmp_path / "a.py").symlink_to(tmp_path / "gone")
    with pytest.raises(Exception, match="gone|a.py"):
        source_files(spark, str(tmp_path)).count()
    assert source_files(spark, str(tmp_path), missing_ok=True).count() == 0
