"""Operators 11 to 13 against brute force: scores of a language model, whitening, divergence of sources."""

import math
import zlib
from collections import Counter
from fractions import Fraction
from itertools import product

import numpy as np
import pytest

from plumbline.llm import divergence, pitman_yor, whitening

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


def one_table_model(texts, contexts):
    """P(word | word before) with every dish of a restaurant at one table, worked out dish by dish."""
    train = [t for i, t in texts if not held(i)]
    count = Counter(w for t in train for w in tokens(t))
    total = sum(count.values())
    frequent = {w for w, n in count.items() if n * contexts >= total and w != b" "}
    ctx = lambda w: w if w is None or w in frequent else "none"  # noqa: E731  None: the start
    pair = Counter((ctx(a), w) for t in train for a, w in zip([None, *tokens(t)], tokens(t)))
    seated = {k: n for k, n in pair.items() if k[0] != "none"}
    guests = Counter()
    for (u, w), n in pair.items():
        guests[w] += n if u == "none" else 1
    d = lambda ns: min(0.95, max(0.05, ns.count(1) / max(1.0, ns.count(1) + 2.0 * ns.count(2))))
    d1, d0 = d(list(seated.values())), d(list(guests.values()))
    tables, customers = Counter(), Counter()
    for (u, _), n in seated.items():
        tables[u] += 1
        customers[u] += n

    def p(before, w):
        c = guests[w]
        root = (c - d0 * (c > 0) + (1 + d0 * len(guests)) / (len(count) + 1)) / (1 + sum(guests.values()))
        u = ctx(before)
        n = seated.get((u, w), 0)
        return root if u == "none" else (n - d1 * (n > 0) + (1 + d1 * tables[u]) * root) / (1 + customers[u])

    return count, total, p


def test_scores_by_brute_force(docs, texts):
    rows = {r["doc_id"]: r for r in pitman_yor.scores(docs, contexts=50, burn=0, samples=0).collect()}
    count, total, p = one_table_model(texts, 50)
    assert len(rows) == len(texts)
    for i, text in texts:
        own = tokens(text)
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(own), sum(count[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in own), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([None, *own], own)), rel=1e-9)
    words = [*count, b"never seen"]  # all but one of the unseen words share what is left
    for before in (None, b"the", b"never seen", max(count, key=count.get)):
        assert sum(p(before, w) for w in words) == pytest.approx(1)


def test_sampled_model_is_better_than_the_base_and_the_same_each_time(docs):
    first, again = ({r["doc_id"]: r for r in pitman_yor.scores(d).collect()} for d in (docs, docs.repartition(3)))
    out = [r for r in first.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(first[i]["score"] == pytest.approx(again[i]["score"], rel=1e-9) for i in first)


def test_small_blocks_and_parts_give_the_same(docs, monkeypatch):
    how = {"contexts": 50, "burn": 0, "samples": 0}
    whole = {r["doc_id"]: r["score"] for r in pitman_yor.scores(docs, **how).collect()}
    monkeypatch.setattr(pitman_yor, "PART", 700)
    monkeypatch.setattr(pitman_yor, "BLOCK", 500)
    assert all(s == pytest.approx(whole[i], rel=1e-9) for i, s in ((r["doc_id"], r["score"]) for r in pitman_yor.scores(docs, **how).collect()))


@pytest.mark.parametrize("sent", [65_000, 20])
def test_every_word_is_a_context(docs, texts, monkeypatch, sent):
    """Against a model without a bound on contexts, whether their totals are sent or asked for part by part."""
    monkeypatch.setattr(pitman_yor, "SENT", sent)
    monkeypatch.setattr(pitman_yor, "PART", 2000)
    rows = {r["doc_id"]: r["score"] for r in pitman_yor.scores(docs, burn=0, samples=0).collect()}
    count, total, p = one_table_model(texts, 10**9)
    rare = [w for w, n in count.items() if n * 1024 < total and w != b" "]
    assert len(rare) > 1000 and len(rows) == len(texts)
    for i, text in texts:
        own = tokens(text)
        assert rows[i] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([None, *own], own)), rel=1e-9)
    for before in (rare[0], rare[-1]):
        assert sum(p(before, w) for w in [*count, b"never seen"]) == pytest.approx(1)


def test_totals_of_contexts_follow_the_sweeps(docs, texts, monkeypatch):
    """After sweeps each part is told the tables that all parts have of a context, be it sent by number or asked for."""
    monkeypatch.setattr(pitman_yor, "SENT", 20)
    monkeypatch.setattr(pitman_yor, "PART", 2000)
    seen, told = [], pitman_yor.tables_of_rare
    monkeypatch.setattr(pitman_yor, "tables_of_rare", lambda state, homes: seen.append((state, homes)) or told(state, homes))
    opened, model = pitman_yor.opened, []
    monkeypatch.setattr(pitman_yor, "opened", lambda *a: model.append(opened(*a)) or model[-1])
    out = sum(r["score"] for r in pitman_yor.scores(docs, burn=1, samples=1).collect() if r["held_out"])
    state, homes = seen[-1]
    read = lambda row, c: pitman_yor._read(row[c], pitman_yor.STATE[c]).astype(np.int64)
    rare = {r["part"]: pitman_yor._read_sorted(r["base_rare"], np.int64) for r in model[0].collect()}
    tables, often, moved = Counter(), 0, 0
    for row in state.collect():
        ctx, t, own = read(row, "ctx"), read(row, "t"), rare[row["part"]]
        seats, hot = len(read(row, "often_alone")), len(read(row, "hot_at"))
        often += read(row, "often_alone") + np.bincount(ctx[ctx < seats], t[ctx < seats], seats).astype(np.int64)
        for u, n in [*zip(own, read(row, "rare_alone")), *zip(own[ctx[ctx >= seats] - seats], t[ctx >= seats])]:
            tables[u] += n
        moved += (t[ctx >= seats] > 1).sum()
    assert seats == 21 and moved > 0 and len(tables) > 1000
    assert np.array_equal(pitman_yor.totals(state, np.zeros(seats), 1, hot).tables, often)
    count = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n = dict(zip(pitman_yor._hashes(list(count)), count.values()))
    got, customers = {}, {(r["part"], r["home"]): pitman_yor._read(r["n"], np.int64) for r in homes.collect()}
    for r in sorted(told(state, homes).collect(), key=lambda r: r["home"]):
        got.setdefault(r["part"], []).extend(zip(pitman_yor._read(r["tables"], np.int64), customers[r["part"], r["home"]]))
    assert {p: [(tables[u], n.get(u, 0)) for u in own] for p, own in rare.items() if len(own)} == got
    for name, n in (("SENT", 65_000), ("PART", 4_000_000)):  # the second: no word is dealt out in pieces
        monkeypatch.setattr(pitman_yor, name, n)
        assert sum(r["score"] for r in pitman_yor.scores(docs, burn=1, samples=1).collect() if r["held_out"]) == pytest.approx(out, rel=0.01)


def test_words_in_pieces_where_their_own_part_has_none(spark, monkeypatch):
    """One word after itself, all of its tokens in two contexts: its seats in the parent are kept in its own part."""
    monkeypatch.setattr(pitman_yor, "PART", 40)
    ids = [i for i in range(30) if not held(i)][:9] + [i for i in range(30) if held(i)][:1]
    rows = [(i, "a " * 40 + "b" * (i % 2)) for i in ids] + [(None, "c a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count, _, p = one_table_model(rows, 10**9)
    assert count[b"a"] > 300
    got = {r["doc_id"]: r["score"] for r in pitman_yor.scores(docs, burn=0, samples=0).collect()}
    for i, text in rows:
        own = tokens(text)
        assert got[i] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([None, *own], own)), rel=1e-9)
    swept = {r["doc_id"]: r["score"] for r in pitman_yor.scores(docs).collect()}
    assert all(math.isfinite(s) and s < 0 for s in swept.values()) and swept.keys() == got.keys()


@pytest.mark.parametrize("n, base, discount", [(2, 0.5, 0.3), (4, 1.5, 0.5), (6, 0.2, 0.8)])
def test_sweeps_draw_seatings_by_their_probability(n, base, discount):
    """Many chains of one dish: the number of tables is distributed as the exact weights of all seatings say."""
    slope = discount * 0.4
    weight = Counter()
    for seats in product(range(n), repeat=n):
        if all(s <= max(seats[:i], default=-1) + 1 for i, s in enumerate(seats)):
            sizes = Counter(seats).values()
            k = len(sizes)
            weight[k] += math.prod(base + slope * (j - 1) for j in range(1, k + 1)) * math.prod(math.prod(j - discount for j in range(1, s)) for s in sizes)
    exact = np.array([weight[k] for k in range(1, n + 1)]) / sum(weight.values())
    chains, draw = 40_000, np.random.default_rng(5)
    c, t, sizes = np.full(chains, n), np.ones(chains, np.int64), np.full(chains, n)
    for _ in range(12):
        at = t.copy()  # the sweep is told of all tables before it, this dish's too
        # base counts the tables of all other dishes; slope is per table of this one
        t, sizes = pitman_yor.reseated(c, t, sizes, base + slope * at, np.full(chains, slope), discount, 8, draw)
        assert np.array_equal(np.add.reduceat(sizes, np.cumsum(t) - t), c)
    assert np.abs(np.bincount(t, minlength=n + 1)[1:] / chains - exact).max() < 0.015


def test_whitening_by_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: [math.floor(1024 * float(c)) + 100_000 for c in r["embedding"]] for r in df.collect()}
    rows = whitening.op12_whitening(spark, SF).collect()
    n, x = len(vectors), np.array(list(vectors.values()), object)
    sums = x.sum(axis=0)
    exact = n * (x.T @ x) - np.outer(sums, sums)
    v = np.array([[float(Fraction(int(e), n * n)) for e in row] for row in exact])
    for r in rows:
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(vectors[r["vec_id"]], sums)) == int(r["deviation_digits"])
        assert r["identity_error"] < 1e-9
    w = {k: np.array([r["whitened"] for r in sorted(rows, key=lambda r: r["vec_id"]) if r["component"] == k]) for k in range(1, 9)}
    off = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(vectors[i], sums)] for i in sorted(vectors)])
    values = np.linalg.eigvalsh(v)[::-1]
    for k, own in w.items():
        direction = off.T @ own / n / math.sqrt(values[k - 1])  # the component itself, as cov(x, z) = sqrt(e) * v
        assert np.abs(v @ direction - values[k - 1] * direction).max() < 1e-9 * values[0]
        assert np.abs(off @ direction / math.sqrt(values[k - 1]) - own).max() < 1e-9
        assert next(r["explained"] for r in rows if r["component"] == k) == pytest.approx(values[k - 1] / np.trace(v), rel=1e-9)


def test_whitening_of_odd_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    huge = [(i, [1e30 * (i % 5), 1.0 * i, -3e12 * (i % 3)], "x") for i in range(40)]
    rows = whitening.whiten(make(huge)).collect()
    assert len(rows) == 120 and len({r["component"] for r in rows}) == 3
    x = [[math.floor(Fraction(c) * 1024) for c in v] for _, v, _ in huge]
    sums = [sum(c) for c in zip(*x)]
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: str(sum((40 * a - s) ** 2 for a, s in zip(v, sums))) for i, v in enumerate(x)}
    same = whitening.whiten(make([(i % 2, [1.0, 2.0], "x") for i in range(6)])).collect()
    assert len(same) == 12 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] == 0 and r["deviation"] == "0" for r in same)
    mixed = whitening.whiten(make([(1, [1.0, 2.0], ""), (2, [1.0], ""), (3, [], ""), (None, [4.0, 0.5], ""), (5, None, ""), (6, [float("inf"), 1.0], ""), (7, [None, 1.0], "")])).collect()
    assert {r["vec_id"] for r in mixed} == {1, None} and all(r["n"] == 2 for r in mixed)
    assert [r["whitened"] is None for r in sorted(mixed, key=lambda r: r["component"])] == [False, False, True, True]


def test_whitening_sums_beyond_a_long(spark):
    assert [sum(int(v[i]) << 32 * limb for at, limb, v in whitening.limbs(np.array([x], object)) for i in range(len(at))) for x in (0, -1, 2**31, -(2**32), 2**64 + 5, -(3**90))] == [0, -1, 2**31, -(2**32), 2**64 + 5, -(3**90)]
    z = np.array([[2**40, 1], [-(2**41), 3]], np.int64)
    assert whitening.cross(z).tolist() == [[2**80 + 2**82, 2**40 - 3 * 2**41], [2**40 - 3 * 2**41, 10]]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_divergence_does_not_depend_on_how_tasks_work(docs, monkeypatch):
    whole = rows_of(divergence.source_divergence(docs))
    assert rows_of(divergence.source_divergence(docs, sent=2)) == whole  # totals joined, not sent
    for name, value in {"TOKENS": 500, "HELD": 300, "PAIRS": 50}.items():
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr("plumbline.llm.common.PIECE", 200)
    assert rows_of(divergence.source_divergence(docs.repartition(7))) == whole


def test_divergence_of_counts_beyond_a_long():
    big = np.array([10**11, 5], np.int64)
    assert divergence._p(big, np.array([3 * 10**11, 3 * 10**11])).tolist() == [1 + 10**9 * (10**11 + 1) // (3 * 10**11), 1]
