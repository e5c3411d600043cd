
from plumbline.llm import licenses


def test_licence_that_many_files_carry(spark):
    assert all(len(set(licenses.tokens(t)) - licenses.PLAIN) >= 3 for _, t in licenses.TEMPLATES)
    for name, notice in licenses.TEMPLATES:
        for part in (2, 1):
            rows = [(f"d{i}/{i}.txt", f"alpha beta {i} gamma delta " + (notice if i % part == 0 else "") + f" epsilon {i} zeta") for i in range(60)]
            n, df = 60, {t: sum(t in licenses.tokens(x) for _, x in rows) for t in licenses.VOCABULARY}
            scanner = licenses.Scanner(n, df)
            for i, (_, text) in enumerate(rows):
                found = scanner.scan(text)
                assert (found[0] == name and found[1] >= 0.6) if i % part == 0 else found[0] is None, (name, part, found)
    out = licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string"))
    assert {r.own_license for r in out.collect()} == {licenses.TEMPLATES[-1][0]}


def test_crowded_directories_inherit_alike(spark, monkeypatch):
    notice = "Released under the MIT License."
    rows = [("a/LICENSE", notice), ("b/c/LICENSE", "Licensed under CC BY 4.0."), *((f"a/x/{i}.txt", "plain words") for i in range(60)), *((f"b/c/{i}/f.txt", "plain words") for i in range(20)), ("z/f.txt", "plain words"), (None, "plain words"), (None, notice), ("a/own.txt", "Licensed under CC BY 4.0.")]
    files = spark.createDataFrame(rows, "path string, text string")
    found = lambda: sorted(map(repr, licenses.scan_licenses(files).collect()))
    before = found()
    assert sum("inherited" in r for r in before) == 80
    monkeypatch.setattr(licenses, "SENT", 0)
    monkeypatch.setattr(licenses, "CROWDED", 3)
    assert found() == before
