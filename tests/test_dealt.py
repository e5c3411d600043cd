"""Sources of one partition are parsed by many tasks."""

import pytest

from plumbline.functions.esfacts import es_facts
from plumbline.functions.pyfacts import py_facts
from plumbline.functions.pyscopes import py_scopes


@pytest.mark.parametrize("read, suffix", [(py_facts, "py"), (py_scopes, "py"), (es_facts, "ts")])
def test_one_partition_is_dealt_out(spark, read, suffix):
    files = spark.createDataFrame([(f"m{i}.{suffix}", "import a\n" if suffix == "py" else "import a from 'a';\n") for i in range(100)], "module_id string, content string").coalesce(1)
    assert files.rdd.getNumPartitions() == 1
    parts = read(files).rdd.mapPartitions(lambda rows: [len({r["module_id"] for r in rows})]).collect()
    assert sum(parts) == 100 and sum(n > 0 for n in parts) > 1 and max(parts) < 60


def test_a_section_is_written_by_itself(spark):
    """A query of one section of the document makes no other."""
    from plumbline.plans import corpus_queries

    spark.read.text(at := corpus_queries._document(spark, "/root/testdata/sf0.001", "intra") + "/intra").count()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.removesuffix("/intra"))
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    assert [s.getPath().getName() for s in found] == ["intra"]
