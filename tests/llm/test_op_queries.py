"""Every query opN_ over small tables of odd rows and over empty ones; against its SQL where it has one."""

import zlib

import duckdb
import pytest

from plumbline.llm.queries import QUERIES, SQL

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, rank int, copy string",
    "pages": "page_id long, url string, html string, bundle string",
    "embeddings": "vec_id long, embedding array<float>, label int, score long",
}
PROSE = "the river and the stone of that house in a wood by the old road with all who came to see it " * 4
ROWS = {
    "documents": [
        *((i, f"{PROSE} number {i} of them", ["en", "de", None][i % 3], ["src0", "src1", "src9", None][i % 4], None, 1, "x") for i in range(1, 40)),
        (None, PROSE, "en", "src0", 5, 1, "x"), (None, None, None, None, None, None, None), (40, None, "en", "src0", 0, 1, "x"), (41, "", "fr", "src2", 0, 1, "x"), (42, " \n\t", None, None, 3, 1, "x"),
        (7, f"{PROSE} number 7 of them", "de", "src9", None, 1, "x"), (7, "other text of one id ½ ② İ.", "de", "src9", None, 1, "x"), (-14, "Released under the MIT License.", "en", "src0", 31, 1, "x"), *((i, f"{PROSE.replace(' ', sep)} ΣΑΣ σας İi ÉCOLE école {i}", "en", "src1", 1, 1, "x") for i, sep in enumerate(("\u00a0", "\u3000", "\x85", "\x1c", "\u2028"), 60)), (43, "word\n" * 3000 + "| é 日本 𝒳 \x1c *** a.b@c.org", "es", "src3", 9, 1, "x"),
    ],
    "pages": [(1, "http://a", "<p>x</p>", "b"), (2, None, "<p>x</p>", "b"), (2, None, "<p>x</p>", "b"), (3, "http://c", None, "b"), (4, "", "", "b"), (None, "http://e", "é", "b"), (9, "http://f", "é", "b"), (9, "http://f", "é", "b"), (10, None, None, None)],
    "embeddings": [*((i, [float((i * k) % 7) - 3 + k * i / 100 for k in range(1, 9)], 0, 1) for i in range(120)), (None, [1.0] * 8, 0, 1), (500, None, 0, 1), (600, [1.0, None] + [0.0] * 6, 0, 1), (700, [float("nan")] * 8, 0, 1), (800, [3e5, -3e5, 299999.25, 1.0, 2.0, 3.0, 4.0, 5.0], 0, 1), (801, [3e5, -3e5, 299999.5, 1.0, 2.0, 3.0, 4.0, 5.5], 0, 1), (900, [1.0, 2.0], 0, 1), (1000, [], 0, 1)],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(ROWS[name], schema).repartition(3).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)


def table(name):
    return "pages" if name.startswith("op7") else "embeddings" if name.startswith(("op9", "op12")) else "documents"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, folders, name):
    df = QUERIES[name](spark, folders[0])
    rows = df.collect()
    assert len(df.columns) == len(set(map(str.lower, df.columns)))
    if name not in ("op1_mixing", "op2_token_counts", "op4_packing", "op9_topk", "op12_whitening", "op13_divergence"):
        assert len(rows) == len(ROWS[table(name)])  # a row each
    if name in SQL:
        con = duckdb.connect()
        for t in SCHEMAS:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folders[0]}/{t}.parquet/*.parquet'")
        result = con.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        order, own = sorted(range(len(columns)), key=lambda i: columns[i]), sorted(range(len(columns)), key=lambda i: df.columns[i])
        assert sorted((tuple(r[i] for i in own) for r in rows), key=repr) == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders[1]).count() == 0


def test_many_langs_go_by_a_join(spark, folders, monkeypatch):
    from plumbline.llm import quality

    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    few = sorted(map(tuple, quality.quality_rules(docs).collect()), key=repr)
    monkeypatch.setattr(quality, "MAX_LANGS", 1)
    assert sorted(map(tuple, quality.quality_rules(docs).collect()), key=repr) == few


def test_words_are_lowered_in_all_scripts_as_sql_does(spark):
    """Every code point, and capitals in words: those beyond A-Z meet their small letters, in the code as in SQL."""
    from plumbline.llm import quality

    texts = ["ÉCOLE ÜBER ΣΑΣ СЛОВО İI", *(" ".join(map(chr, range(i, i + 4096))) for i in range(1, 0x20000, 4096) if not 0xC000 <= i < 0xE000)]
    sql = "SELECT regexp_extract_all(lower(?), '[^\\x20\\x09-\\x0D]+')"
    assert all([w.decode() for w in quality.lower_words(t)] == duckdb.execute(sql, [t]).fetchone()[0] for t in texts)
    small = "école über сорок слово дом " * 30
    docs = spark.createDataFrame([*((i, small, "fr") for i in range(9)), (9, small.upper(), "fr")], "doc_id long, text string, lang string")
    assert {r["word_distance"] for r in quality.quality_rules(docs).collect()} == {0.0}


def test_languages_of_few_texts_repeated_often_are_learnt(spark):
    """Two texts of a language, thousands of times each, are two texts: neither is left out, neither crowds out the other."""
    from pyspark.sql import functions as F

    from plumbline.llm import language_id

    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    few = spark.range(9000).select(F.element_at(F.array(*map(F.lit, ids)), (F.col("id") % 2 + 1).cast("int")).alias("doc_id")).withColumns({"text": F.concat(F.lit("few words "), F.col("doc_id")), "lang": F.lit("xx")})
    many = spark.range(100, 3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("plenty "), F.col("id")).alias("text"), F.lit("yy").alias("lang"))
    texts, langs = language_id.training_sample(few.select("doc_id", "text", "lang").unionByName(many), 50, 5, 100_000)
    assert sorted(t for t, k in zip(texts, langs) if k == "xx") == sorted(f"few words {i}" for i in ids)
    assert langs.count("yy") == 50
