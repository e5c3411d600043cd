
import random

import numpy as np

import corpus_pipeline as pipeline
from plumbline.llm import near, simhash

SF = "/root/testdata/sf0.001"


def slow_groups(rows, least):
    sets = [set(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= least * all_:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r.doc_id)
    return groups.values()


def test_dedup_stage_finds_every_pair_of_similarity_08(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = [f"w{i}" for i in range(400)]
    # a large group of copies that differ in a few words each, some of them just below or above the limit
    own = []
    for k in range(60):
        mine = list(words)
        for i in range(k % 12):
            mine[(37 * k + 31 * i) % 400] = f"x{k}_{i}"
        own.append((800000 + k, " ".join(mine), "en", "src0", 1))
    docs = docs.unionByName(spark.createDataFrame(own, docs.schema))
    expected = sorted(min(g) for g in slow_groups(docs.collect(), 0.8))
    assert sorted(r.doc_id for r in pipeline.dedup_stage(spark, docs, SF).collect()) == expected
    assert not {145, 177} & set(expected)


def test_planted_pairs_of_every_similarity(spark):
    """Pairs of texts that differ in some words, groups that share a long passage, and a star of many near copies."""
    r = random.Random(21)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = []
    for k in range(150):
        one = words(r.randint(60, 200))
        two = list(one)
        for _ in range(k % 10):
            two[r.randrange(len(two))] = r.choice(vocabulary)
        texts += [one, two]
    passage = words(70)
    texts += [words(r.randint(5, 40)) + passage + words(r.randint(0, 20)) for _ in range(120)]
    center = words(150)
    for _ in range(80):
        mine = list(center)
        for _ in range(r.randint(1, 6)):
            mine[r.randrange(150)] = r.choice(vocabulary)
        texts.append(mine)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = docs.collect()
    assert sorted(x.doc_id for x in near.near_dedup(docs).collect()) == sorted(min(g) for g in slow_groups(rows, 0.8))


def test_rare_pairs_leave_out_none(spark):
    r = np.random.default_rng(5)
    common = r.integers(-(2**62), 2**62, 60)
    sets = [np.unique(np.concatenate([common[: r.integers(20, 60)], r.integers(-(2**62), 2**62, r.integers(0, 15))])) for _ in range(150)]
    frame = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "node long, own array<long>")
    roots = spark.createDataFrame([(i, i % 40) for i in range(150)], "node long, root long")
    found = {tuple(sorted(x)) for x in near.rare_pairs(frame, roots, 0.8).distinct().collect()}
    real = {(i, j) for j in range(150) for i in range(j) if i % 40 != j % 40 and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert real and real <= found


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, node long, root long, band long")
    assert near.near_dedup(docs).count() == 0
    rows = [(1, None, 5, 5, 5), (2, "", 6, 6, 6), (3, " ", 7, 7, 7), (4, "a b", 8, 8, 8), (4, "a b", 9, 9, 9)]
    out = near.near_dedup(spark.createDataFrame(rows, docs.schema))
    assert out.columns == docs.columns and sorted(x.doc_id for x in out.collect()) == [1, 4]


def test_texts_of_one_form_do_not_meet_each_with_each(spark):
    """5,000 texts of one form, of similarity 0.75 to each other: the places that meet stay in proportion to the texts; and
    of those above the limit none is left out."""
    from pyspark.sql import functions as F

    form, own = np.arange(600), 1_000_000
    rows = []
    for k in range(5000):  # c common and u own shingles: c / (c + 2 u) = 0.75; one text in fifty shares most of the last one's
        mine = own + 100 * k + np.arange(100) if k % 50 else own + 100 * (k - 1) + 100 + np.arange(100)
        rows.append((k, [int(x) for x in np.concatenate([form, mine])]))
    rows += [(5000 + k, [int(x) for x in np.concatenate([form, own + 100 * (51 * k + 1) + np.arange(88), 9_000_000 + 100 * k + np.arange(12)])]) for k in range(40)]
    sets = spark.createDataFrame(rows, "node long, own array<long>").repartition(8)
    nodes = sets.select("node", F.col("node").alias("root"))
    few, larger, smaller = near.early_places(sets, nodes, 0.8)
    count = lambda df, *by: {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).count().collect()}
    met = sum(n * (n - 1) for n in count(few, "s").values())
    left, right = (count(df, "s", "large", "small") for df in (larger, smaller))
    met += sum(n * right.get(k, 0) for k, n in left.items())
    assert met <= 40 * len(rows)
    found = {tuple(sorted(r)) for r in near.rare_pairs(sets, nodes, 0.8).collect()}
    assert {(51 * k + 1, 5000 + k) for k in range(40)} <= found


def test_rare_pairs_leave_out_none_when_shingles_are_common(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(near, "COMMON", 2)
    draw = np.random.default_rng(3)
    rows, base = [], [draw.choice(5000, 300, replace=False) for _ in range(6)]
    for k in range(240):
        keep = base[k % 6][draw.random(300) < draw.choice([1.0, 0.95, 0.85])]
        rows.append((k, sorted({*map(int, keep), *map(int, draw.choice(5000, int(draw.integers(0, 40))))})))
    sets = spark.createDataFrame(rows, "node long, own array<long>")
    exact = {(i, j) for i, x in rows for j, y in rows if i < j and len({*x} & {*y}) >= 0.8 * len({*x} | {*y})}
    found = {tuple(sorted(r)) for r in near.rare_pairs(sets, sets.select("node", F.col("node").alias("root")), 0.8).collect()}
    assert len(exact) > 100 and exact <= found


def test_a_loose_group_without_its_center_does_not_meet_each_with_each(spark, monkeypatch):
    """Pipeline, near-dedup: 900 texts that differ from one in up to three words, that one not among them, so that most pairs
    are just below the limit (and 35 texts are near none): 591,838 rows to verify by rare shingles when only leaders were asked."""
    draw, words, rows, made = np.random.default_rng(8), [f"w{i}" for i in range(150)], [], []
    for k in range(900):
        mine = list(words)
        for at in draw.choice(150, draw.choice(4, p=(0, 0.03, 0.47, 0.5)), replace=False):
            mine[at] = f"x{k}_{at}"
        rows.append((k, " ".join(mine)))
    whole = near.rare_pairs

    def counted(sets, nodes, least):
        found = near.written(whole(sets, nodes, least), "counted")
        made.append(found.count())
        return found

    monkeypatch.setattr(near, "rare_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = sorted(min(g) for g in slow_groups(docs.collect(), 0.8))
    assert sorted(x.doc_id for x in near.near_dedup(docs).collect()) == expected and len(expected) == 36
    assert made[0] < 200_000


def test_long_runs_of_fingerprints_are_parted(monkeypatch):
    draw = np.random.default_rng(4)
    fps = np.unique(draw.integers(0, 1 << 14, 3000).astype(np.uint64) << np.uint64(20))
    owns = lambda x: np.bitwise_count(x) <= 3
    whole = simhash.near_links(fps[:900], owns, 3)
    monkeypatch.setattr(simhash, "PAIRWISE", 20)
    parted = simhash.near_links(fps[:900], owns, 3)
    assert {tuple(x) for x in zip(*map(list, whole))} == {tuple(x) for x in zip(*map(list, parted))}


def test_leaders_of_many_pairs_are_dealt_out(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = sorted(r.doc_id for r in near.near_dedup(docs).select("doc_id").collect())
    monkeypatch.setattr(near, "HOT", 2)
    monkeypatch.setattr(near, "SENT", 1)
    assert sorted(r.doc_id for r in near.near_dedup(docs).select("doc_id").collect()) == before
