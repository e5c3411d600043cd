"""The pipeline, stage by stage, against brute force on the smallest tables and some documents of our own."""

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from plumbline.llm import language_id, mixing, packing, pii, simhash
from plumbline.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def slow_groups(rows):
    """Groups of documents linked by a Jaccard similarity of 0.8 or more of their sets of five-word shingles."""
    sets = [set(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r.doc_id)
    return groups.values()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.orderBy(F.desc("n_chars")).limit(1).collect()[0]
    own = [(900001, None, "en", "src1", None), (900002, "1234 --- !!", "en", "src1", 11), (900003, long.text + " end", None, "src2", None), (900004, "Write to a.b@c.org now, the quick and the slow one of that house.", "en", None, 60)]
    docs = docs.unionByName(spark.createDataFrame(own, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = docs.collect()
    done = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(done)}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{len(done)}")
        assert len(done) == 4 or docs.columns == before.columns, name
        done.append(docs.collect())
    told, kept, clean, mixed, packed = done
    # language ID: the network's own verdict, text by text
    net = language_id.fit_language_id(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    names, scores = language_id.predict(net, net.tables(), [r.text for r in first])
    assert {r.doc_id for r in told} == {r.doc_id for r, n, s in zip(first, names, scores) if n != "und" and s >= pipeline.LEAST_SCORE}
    assert not {900001, 900002} & {r.doc_id for r in told} and all(r.lang for r in told) and len(told) > 0.95 * len(first)
    # near-duplicates: the smallest id of each group
    assert sorted(r.doc_id for r in kept) == sorted(min(g) for g in slow_groups(told))
    assert 900003 not in {r.doc_id for r in kept}
    # PII
    model, texts = pii.pii_model(), {r.doc_id: r.text for r in kept}
    assert {r.doc_id: r.text for r in clean} == {i: pii.redacted(t, [s for part in pii.all_spans(t, model) for s in part]) for i, t in texts.items()}
    assert all(r.n_chars == len(r.text) for r in clean) and any("[EMAIL]" in r.text for r in clean)
    # mixing
    sizes, n = Counter(), Counter(r.doc_id for r in mixed)
    for r in clean:
        sizes[r.source if r.source in mixing.WEIGHTS else None] += len(r.text)
    share = {g: w for g, w in [*mixing.WEIGHTS.items(), (None, mixing.REST)] if sizes[g]}
    for r in clean:
        g = r.source if r.source in mixing.WEIGHTS else None
        rate = sum(sizes.values()) * share[g] / sum(share.values()) / sizes[g]
        u = (int(hashlib.md5(f"42|{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert n[r.doc_id] == sum(c <= u for c in mixing.poisson_cdf(rate))
    # packing
    codec = packing.WordIds(packing.tokenizer_path("word_bpe_49k.json"))
    tokens = Counter()
    for r in mixed:
        tokens[r.doc_id] += len(codec.of(r.text)) // 4 + 1
    got, fill = Counter(), Counter()
    for r in packed:
        got[r.doc_id] += len(r.ids)
        fill[r.sequence_id] += r.length
        assert r.length == len(r.ids)
    assert got == tokens and max(fill.values()) <= 2048 and len(fill) <= math.ceil(sum(tokens.values()) / 2048) + 1
    assert np.isin(0, [x for r in packed for x in r.ids])


def test_registered():
    import __spark_entry__

    assert len(pipeline.STAGES) == 5 and "pipeline" in __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
