"""Every query of the engine against its SQL in DuckDB."""

from functools import cache

import duckdb
import pytest

import __spark_entry__
from plumbline.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_scan_each():
    """Many queries scan the same files: here each scan is made once, and its tables are kept for the other queries."""
    from dataclasses import replace

    from plumbline.plans import baseline_queries, corpus_queries, queries, resolution_queries, scan
    from plumbline.sources.store import settled

    made = {}

    def scanned(files, **how):
        key = (files.semanticHash(), tuple(how.items()))
        if key not in made:
            found = scan.scan_files(files, **how)
            made[key] = replace(found, **{k: settled(v) for k, v in found.tables().items()}, kept=[])
            found.release()
        return made[key]

    with pytest.MonkeyPatch.context() as patch:
        for module in (baseline_queries, corpus_queries, queries, resolution_queries):
            patch.setattr(module, "scan_files", scanned)
        for module, name in ((corpus_queries, "_document"), (resolution_queries, "_grown")):
            patch.setattr(module, name, cache(getattr(module, name)))
        yield


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, result.fetchall())


def test_registry(spark):
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
