"""Expanded star imports, and scans that are kept up to date batch by batch, against scans of all files."""

import random

from plumbline.plans.scan import scan_files
from plumbline.sources.files import memory_files
from plumbline.streaming.incremental import Incremental


def graph(found):
    edges = {(r["source"], r["target"], r["targetPort"], r["kind"], tuple(r["sites"])) for r in found.edges.collect()}
    return edges, {(r["kind"], r["moduleId"], r["line"], r["message"]) for r in found.diagnostics.collect()}, {r["id"] for r in found.externals.collect()}, {r["id"] for r in found.modules.collect()}, {tuple(r) for r in found.calls.collect()}


def expanded(spark, files):
    return graph(scan_files(memory_files(spark, files), expand_stars=True))


def calls(edges):
    return {(s, t, p, sites) for s, t, p, kind, sites in edges if kind == "call"}


def test_names_pass_through_packages_and_circles(spark):
    edges, notes, _, _, _ = expanded(spark, {
        "pkg/__init__.py": "from .a import *\n",
        "pkg/a.py": "from pkg.b import *\ndef first():\n    pass\n",
        "pkg/b.py": "from pkg.a import *\nimport json as codec\nif codec:\n    def second():\n        pass\n_hidden = 1\n",
        "use.py": "from pkg import *\nfirst()\nsecond()\ncodec.dumps(1)\n_hidden()\nnowhere()\n",
    })
    assert calls(edges) == {("use.py", "pkg/__init__.py", None, (2,)), ("use.py", "pkg/__init__.py", None, (3,)), ("use.py", "pkg/__init__.py", None, (4,))} or calls(edges) == {("use.py", "pkg/__init__.py", None, (2, 3, 4))}
    assert [m for k, _, _, m in notes if k == "star_import_unresolved"] == ["2 unresolved symbol(s) in this module may come from star import of 'pkg' (e.g. '_hidden', 'nowhere'); per-site diagnostics aggregated"]


def test_all_is_respected(spark):
    edges, notes, _, _, _ = expanded(spark, {
        "lib.py": "__all__ = ['shown', '_inner']\ndef shown():\n    pass\ndef kept():\n    pass\ndef _inner():\n    pass\n",
        "made.py": "__all__ = build()\ndef any():\n    pass\n",
        "use.py": "from lib import *\nfrom made import *\nshown()\nkept()\n_inner()\nany_()\n",
        "again.py": "from use import *\nshown()\n_inner()\n",
    })
    assert calls(edges) == {("use.py", "lib.py", "shown", (3,)), ("use.py", "lib.py", "_inner", (5,)), ("again.py", "use.py", None, (2,))}
    assert {m.split(" (e.g.")[1].split(")")[0] for k, _, _, m in notes if k == "star_import_unresolved"} == {" '_inner'", " 'any_', 'kept'"}


def test_own_names_hide_and_later_imports_win(spark):
    edges, _, _, _, _ = expanded(spark, {
        "one.py": "def f():\n    pass\ndef g():\n    pass\ndef h():\n    pass\ndef p():\n    pass\n",
        "two.py": "def f():\n    pass\n",
        "use.py": "from one import *\nfrom two import *\nfrom other import h\ndef g():\n    pass\ndef run(p):\n    return p()\nf()\ng()\nh()\n",
        "back.py": "from other import h\nfrom one import *\nh()\n",
    })
    assert calls(edges) == {("use.py", "two.py", "f", (8,)), ("use.py", "other", "h", (10,)), ("back.py", "one.py", "h", (3,))}


def test_without_expansion_nothing_changes(spark):
    files = {"lib.py": "def f():\n    pass\n", "use.py": "from lib import *\nf()\n"}
    edges, notes, *_ = graph(scan_files(memory_files(spark, files)))
    assert not calls(edges) and any(k == "star_import_unresolved" for k, *_ in notes)


def content(r, k):
    lines = [r.choice([f"from pkg.m{r.randrange(8)} import f{r.randrange(4)}", f"import pkg.m{r.randrange(8)} as x", f"from . import m{r.randrange(10)}", f"from .m{r.randrange(8)} import *", "import pkg.sub.deep"]) for _ in range(3)]
    lines += [f"def f{i}():\n    return x.f{r.randrange(4)}(m{r.randrange(8)}.f1())" for i in r.sample(range(4), 2)]
    return "\n".join(lines) + f"\nf{r.randrange(4)}()\n"


def test_every_batch_equals_a_scan_of_all_files(spark, tmp_path):
    r, files, state = random.Random(11), {}, Incremental(spark, f"file://{tmp_path}/state")
    names = [f"pkg/m{k}.py" for k in range(10)] + ["pkg/__init__.py", "pkg/m3/__init__.py", "pkg/sub/deep.py", "other/x.py"]
    for number in range(4):
        came = {n: content(r, number) if r.random() < 0.9 else "def broken(:\n" for n in r.sample(names, 7 if not number else 3)}
        went = [n for n in r.sample(sorted(files), 1) if n not in came] if number else []
        files = {n: t for n, t in files.items() if n not in went} | came
        found = state.apply(memory_files(spark, came), number, spark.createDataFrame([(n,) for n in went], "module_id string") if went else None)
        assert graph(found) == graph(scan_files(memory_files(spark, files))), number
        assert {x[0] for x in state.touched(number).collect()} >= set(came)


def test_only_those_concerned_are_resolved_again(spark, tmp_path):
    state = Incremental(spark, f"file://{tmp_path}/state")
    files = {"base.py": "def f():\n    pass\ndef g():\n    pass\n", "by_f.py": "from base import f\nf()\n", "by_g.py": "import base\nbase.g()\n", "apart.py": "import os\n", "later.py": "import pkg.new\n"}
    state.apply(memory_files(spark, files), 0)
    touched = lambda n: {x[0] for x in state.touched(n).collect()}
    state.apply(memory_files(spark, {"base.py": "def f():\n    pass\n\ndef g(a):\n    return a\n"}), 1)
    assert touched(1) == {"base.py"}  # the same ports
    state.apply(memory_files(spark, {"base.py": "def f():\n    pass\n"}), 2)
    assert touched(2) == {"base.py", "by_g.py"}
    for _ in range(2):  # a batch that is tried again
        found = state.apply(memory_files(spark, {"pkg/__init__.py": ""}), 3)
        assert touched(3) == {"pkg/__init__.py", "later.py"}
    assert ("later.py", "pkg/__init__.py", None, "import", (1,)) in graph(found)[0]
    found = state.apply(memory_files(spark, {}), 4, spark.createDataFrame([("base.py",)], "module_id string"))
    assert touched(4) == {"by_f.py", "by_g.py"} and "base" in graph(found)[2]
