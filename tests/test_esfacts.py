"""Facts of single ECMAScript modules against expectations written by hand; a folder of two languages."""

import pytest

from plumbline.functions.esfacts import dotted, facts
from plumbline.functions.frontends import FRONT_ENDS
from plumbline.plans.scan import scan_codebase


def of(source, fact, *keys):
    return [tuple(r.get(k) for k in keys) if len(keys) > 1 else r.get(keys[0]) for r in facts("web/pages/a.ts", source) if r["fact"] == fact]


IMPORTS = {
    "import a from './x'": [("from_import", "es:web.pages.x", "default", "a")],
    "import {\n  a,\n  b as c, type D,\n} from '../y/z.js'": [("from_import", "es:web.y.z", "a", None), ("from_import", "es:web.y.z", "b", "c"), ("from_import", "es:web.y.z", "D", None)],
    "import type { T } from '..'": [("from_import", "es:web", "T", None)],
    "import * as ns from \"@s/p/q\"": [("import", None, "npm:@s/p/q", "ns")],
    "import d, * as ns from './index'": [("from_import", "es:web.pages", "default", "d"), ("import", None, "es:web.pages", "ns")],
    "import './side'": [("import", None, "es:web.pages.side", None)],
    "export * from './all'": [("import", None, "es:web.pages.all", None)],
    "export { a as b } from './a'": [("from_import", "es:web.pages.a", "a", "b")],
    "const fs = require('node:fs'), y = 1": [("import", None, "npm:node:fs", "fs")],
    "const { a, b: c } = require('./x')": [("from_import", "es:web.pages.x", "a", None), ("from_import", "es:web.pages.x", "b", "c")],
    "// import a from 'b'\n/* import a\nfrom 'b' */ x = `import a from 'b'`; y = \"import 'c'\"; z = /import 'd'/": [],
}


@pytest.mark.parametrize("source", IMPORTS)
def test_imports(source):
    assert of(source, "import", "kind", "module", "name", "alias") == IMPORTS[source]


def test_ports():
    source = (
        "export default class extends Base {}\nexport async function* run<T>(a: {b: c}, [d, e] = [], ...f): T {}\nexport const x = 1, y = 2;\nexport enum E {}\n"
        "export interface I { m(a): void }\nexport type T = string\nexport { p, q as r };\nexport { s } from './s'\nfunction hidden() {}\nexport default 3\n"
    )
    got = of(source, "port", "kind", "name", "line", "signature", "params")
    assert got == [
        ("class", "default", 1, "default(Base)", []), ("function", "run", 2, "(a, f)", ["a", "f"]), ("export", "x", 3, "", []), ("export", "E", 4, "", []),
        ("export", "I", 5, "", []), ("export", "T", 6, "", []), ("export", "p", 7, "", []), ("export", "r", 7, "", []), ("export", "default", 10, "", []), ("export", "s", 8, "", []),
    ]


def test_references_and_names():
    source = "class A extends lib.Base {\n  constructor(x) { super(x); this.go(x) }\n  get(y): void { f(y) }\n}\nnew A(g(1));\nif (h()) { a.b.c(d?.e()) }\nconst k = (m, n) => m(n);\nlet p = q => q();\nfunction r(s) { let t = 1; return t }\ntry {} catch (u) { u() }\n"
    got = of(source, "reference", "kind", "name", "base", "line")
    assert got == [
        ("inheritance", "Base", "lib", 1), ("call", "go", "this", 2), ("call", "f", None, 3), ("call", "A", None, 5), ("call", "g", None, 5), ("call", "h", None, 6),
        ("call", "c", "a", 6), ("call", "e", "d", 6), ("call", "m", None, 7), ("call", "q", None, 8), ("call", "u", None, 10),
    ]
    assert of(source, "def", "name") == ["A", "k", "p", "r"]
    assert {"x", "y", "m", "n", "q", "s", "t", "u"} <= set(of(source, "local", "name")) and "A" not in of(source, "local", "name")


def test_only_what_is_asked_for():
    source = "import { a } from './x'\nexport class B {}\nJSON.parse(new Map(a(console.log)))\nfunction f(p) {}\n"
    assert of(source, "local", "name") == ["JSON", "Map", "p"]  # of the names that every host knows those asked for
    every = list(facts("web/pages/a.ts", source))
    for kinds in ({"port"}, {"local"}, {"reference", "def"}, {"parse_error"}):
        assert list(facts("web/pages/a.ts", source, frozenset(kinds))) == [r for r in every if r["fact"] in kinds]


def test_odd_texts():
    assert of("", "module", "fact") == ["module"] and of(b"\xff\xfe", "parse_error", "line") == [0]
    assert of("import('x'); import(`y${z}`)", "dynamic_import", "message") == ["dynamic import of 'x'", "dynamic import of non-literal target"]
    for text in ("}}}((", "export", "import {", "'", "`", "/*", "export default", "function (", "a(" * 3000, "export class", "import x from './" + "../" * 50 + "y'"):
        list(facts("a.js", text))
    assert dotted("index.ts") == "es:" and dotted("a/index.tsx") == "es:a" and dotted("a/b.c.mjs") == "es:a.b.c"


def test_folder_of_two_languages(spark, tmp_path):
    for path, text in {"app/main.py": "import app.util\n", "app/util.py": "", "app/main.ts": "import { u } from './util'\nu()\n", "app/util.ts": "export function u() {}\n", "node_modules/x.js": "y", "note.txt": "z"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    graph = scan_codebase(spark, str(tmp_path), front_ends=FRONT_ENDS)
    assert [m["id"] for m in graph["modules"]] == ["app/main.py", "app/main.ts", "app/util.py", "app/util.ts"]
    assert {(e["source"], e["target"], e["kind"], e.get("targetPort")) for e in graph["edges"]} == {("app/main.py", "app/util.py", "import", None), ("app/main.ts", "app/util.ts", "from_import", "u"), ("app/main.ts", "app/util.ts", "call", "u")}
    assert not graph["diagnostics"] and [m["id"] for m in scan_codebase(spark, str(tmp_path))["modules"]] == ["app/main.py", "app/util.py"]
