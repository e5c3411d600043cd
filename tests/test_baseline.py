"""Findings against a baseline, over several scans."""

from plumbline.operators import baseline

FIELDS = "kind string, moduleId string, line int, message string"


def scan(spark, *rows):
    return baseline.fingerprints(spark.createDataFrame(list(rows), FIELDS))


def states(df):
    return sorted((r["status"], r["moduleId"], r["line"], r["message"]) for r in df.collect())


def test_three_scans(spark):
    lost = ("unresolved_symbol", "a.py", 3, "unresolved symbol 'x'")
    twice = ("duplicate_def", "b.py", 9, "duplicate module-level def 'f'; intra graph keeps the first definition (line 2)")
    none = spark.createDataFrame([], "fingerprint string, " + FIELDS + ", since int, fixed int")
    first = scan(spark, lost, (*lost[:2], 8, lost[3]), twice)
    result = baseline.compared(first, none)
    assert {s for s, *_ in states(result)} == {"new"} and result.count() == 3
    known = baseline.merged(none, result, 1)
    # lines move; one of two equal findings goes, one comes
    second = scan(spark, (*lost[:2], 30, lost[3]), ("duplicate_def", "b.py", 19, twice[3].replace("line 2", "line 12")), ("parse_error", "c.py", 1, "syntax error: invalid syntax"))
    result = baseline.compared(second, known.where("fixed is null"))
    assert states(result) == [("fixed", "a.py", 8, lost[3]), ("known", "a.py", 30, lost[3]), ("known", "b.py", 19, twice[3].replace("line 2", "line 12")), ("new", "c.py", 1, "syntax error: invalid syntax")]
    known = baseline.merged(known, result, 2)
    rows = {(r["moduleId"], r["line"]): (r["since"], r["fixed"]) for r in known.collect()}
    assert rows == {("a.py", 8): (1, 2), ("a.py", 30): (1, None), ("b.py", 19): (1, None), ("c.py", 1): (2, None)}
    # what was fixed is back
    result = baseline.compared(first, known.where("fixed is null"))
    known = baseline.merged(known, result, 3)
    rows = {(r["moduleId"], r["line"]): (r["since"], r["fixed"]) for r in known.collect()}
    assert rows == {("a.py", 3): (1, None), ("a.py", 8): (3, None), ("b.py", 9): (1, None), ("c.py", 1): (2, 3)}


def test_verdict(spark):
    result = spark.createDataFrame([("cycle", "new"), ("cycle", "known"), ("orphan", "new"), ("other", "fixed")], "kind string, status string")
    strict = spark.createDataFrame([("cycle",), ("other",)], "kind string")
    assert {tuple(r) for r in baseline.verdict(result, strict).collect()} == {("cycle", 1, 1, 0, True), ("orphan", 1, 0, 0, False), ("other", 0, 0, 1, False)}
