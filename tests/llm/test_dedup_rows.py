
import corpus_pipeline as pipeline
from plumbline.llm import simhash

SF = "/root/testdata/sf0.001"


def test_dedup_keeps_rows_of_null_and_repeated_ids(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["c"]), (1, texts["c"]), (2, texts["d"]), (2, texts["e"]), (2, texts["e"]), (None, texts["b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted([(None, texts["a"]), (None, texts["b"]), (1, texts["c"]), (2, texts["d"]), (2, texts["e"])], key=repr)
    assert sorted(map(tuple, simhash.simhash_dedup(docs).collect()), key=repr) == expected
    assert sorted(map(tuple, pipeline.dedup_stage(spark, docs, SF).collect()), key=repr) == expected
