"""The ten operators on small fixtures against brute force: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import language_id, licenses, mixing, packing, pii, quality, simhash, token_counts, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(3)
WORDS = "der die und the of and to in a is que de la los licht haus tree river stone".split()


def words(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = words(9000)
TEXTS = [
    None, "", " \n\t ", "one", "One TWO", "one two three four", words(60), words(61), words(300), LONG, LONG, LONG + " end",
    "dup line here\n" * 40, "a.b@mail.example.com, +1 (017) 555-7713, 4111 1111 1111 1111, at 10.0.0.255 and 300.1.1.1.", "İstanbul É ñ 日本語 !!! x² 🎉 " * 30,
    "word " * 120, "*** ### $$$ " * 200, "<|endoftext|> tail", words(2000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "src0", "src0", "src1", "other"][i % 5], len(t) if t else None) for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[9], (None, TEXTS[6], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({"rank": F.lit(1), "copy": F.lit("x"), "node": F.lit(2)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in w]
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def slow_fingerprint(text, k=3):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(docs):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    fps = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(fps, 2)
    low = {}
    for (i, _), r in zip(rows, roots):
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    expected = Counter((i, f"{f:016x}", low[r]) for (i, _), f, r in zip(rows, fps, roots))
    assert Counter(map(tuple, simhash.simhash_components(docs).collect())) == expected


def test_simhash_links_of_dense_groups(spark, monkeypatch):
    r = random.Random(1)
    fps = set()
    for _ in range(6):
        center = r.getrandbits(64)
        fps.add(center)
        for _ in range(60):
            center ^= 1 << r.randrange(64)
            if r.random() < 0.6:
                center ^= 1 << r.randrange(64)
            fps.add(center)
            fps.add(center ^ (1 << r.randrange(20)))
    fps = sorted(fps)
    for bits in (1, 2, 3, 5):
        frame = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
        links = [(a % 2**64, b % 2**64) for a, b in simhash.simhash_links(frame, bits).collect()]
        at = {f: i for i, f in enumerate(fps)}
        root = list(range(len(fps)))
        for _ in fps:
            for a, b in links:
                root[at[a]] = root[at[b]] = min(root[at[a]], root[at[b]])
        expected = slow_components(fps, bits)
        assert len(set(zip(root, expected))) == len(set(expected)) == len(set(root))
    long, cuts = np.array(fps, np.uint64), simhash.Cuts(2, 2)
    for pos, piece in ((0, 0), (3, 0), (32, 1), (40, 2)):
        owns = lambda x, p=pos, q=piece: cuts.owns(x, p, q)
        monkeypatch.setattr(simhash, "PAIRWISE", 10_000)
        short = simhash.near_links(long, owns, 2)
        monkeypatch.setattr(simhash, "PAIRWISE", 10)
        assert sorted(zip(*map(list, short))) == sorted(zip(*map(list, simhash.near_links(long, owns, 2))))


def test_each_link_has_one_run():
    r = random.Random(11)
    for bits in (1, 2, 3, 5):
        cuts = simhash.Cuts(bits, (bits + 2) // 2)
        for _ in range(300):
            x = 0
            for k in r.sample(range(64), r.randint(1, bits)):
                x |= 1 << k
            runs = 0
            for s, (places, m) in enumerate(zip(cuts.segments, cuts.masks)):
                for pos in places:
                    if not x & m & ~(1 << pos):  # the pair shares this variant
                        runs += sum(bool(cuts.owns(np.array([x], np.uint64), pos, q)[0]) for q, own in enumerate(cuts.pieces[s]) if not x & own)
            assert runs == 1, (bits, hex(x))


def test_simhash_dedup_and_tables(docs, none):
    kept = simhash.simhash_dedup(docs, shingle=5, max_bits=5, segments=2, tables=4)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.collect()]
    assert 9 in ids and 10 not in ids and 11 not in ids and len(ids) == len(set(ids)) and {3, 8, 18} <= set(ids) and 0 in ids and 1 not in ids
    assert simhash.simhash_components(none).count() == 0 and simhash.simhash_dedup(none).count() == 0


def test_mixing(docs, none):
    weights = {"src0": 0.5, "src1": 0.0, "absent": 0.2}
    out = mixing.mix_sources(docs.drop("copy"), weights, 0.3, epochs=3.0).collect()
    sizes = Counter()
    rows = docs.collect()
    group = lambda s: s if s in weights else None
    for r in rows:
        sizes[group(r.source)] += len(r.text or "")
    total = sum(sizes.values())
    expected = Counter()
    for r in rows:
        g = group(r.source)
        share = {"src0": 0.5 / 0.8, None: 0.3 / 0.8}.get(g, 0)
        rate = 3.0 * total * share / sizes[g] if share else 0
        u = (int(hashlib.md5(f"42|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while rate and c <= u:
            k += 1
            p *= rate / k
            c += p
        expected[r.doc_id] += k
    assert Counter(r.doc_id for r in out) == +expected
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys) and "src1" not in {r.source for r in out}
    assert mixing.mix_sources(none, weights, 0.3).count() == 0
    mean = [sum(c <= (i + 0.5) / 4000 for c in mixing.poisson_cdf(2.7)) for i in range(4000)]
    assert abs(sum(mean) / 4000 - 2.7) < 0.01
    assert mixing.mix_sources(docs, {}, 1.0).columns.count("copy") == 1


def test_token_counts(docs, none):
    path = token_counts.tokenizer_path("byte_bpe_50k.tiktoken")
    encode = token_counts.encoding(path).encode_ordinary
    rows = [(r.source, len(encode(r.text)) if r.text else 0) for r in docs.collect()]
    hist = token_counts.length_histogram(token_counts.encoded_lengths(docs, path, "source"), "source").cache()
    for r in hist.collect():
        own = [n for s, n in rows if s == r.source]
        assert (r.n_docs, r.docs_ge, r.docs_le) == (own.count(r.n_tokens), sum(n >= r.n_tokens for n in own), sum(n <= r.n_tokens for n in own))
        assert (r.tokens_ge, r.truncated_tokens) == (sum(n for n in own if n >= r.n_tokens), sum(min(n, r.n_tokens) for n in own))
        assert (r.docs, r.tokens) == (len(own), sum(own))
    assert hist.count() == len(set(rows))
    for limit in (0, 7, 100, 10**6):
        for r in token_counts.at_limit(hist, "source", limit).collect():
            own = [n for s, n in rows if s == r.source]
            assert (r.docs_over, r.truncated_tokens) == (sum(n > limit for n in own), sum(min(n, limit) for n in own))
    for q in (0.1, 0.5, 1.0):
        for r in token_counts.quantile(hist, "source", q).collect():
            own = sorted(n for s, n in rows if s == r.source)
            assert r.length == own[math.ceil(q * len(own)) - 1]
    assert token_counts.length_histogram(token_counts.encoded_lengths(none, path, "source"), "source").count() == 0


def test_packing(docs, none):
    path = packing.tokenizer_path("word_bpe_49k.json")
    codec = packing.WordIds(path)
    odd = ["Don't I'LL we've a.b,c..", "x²!! Ⅷ. é́ É", "a<|endoftext|>b <|ENDOFTEXT|>", "ΣΑΣ. ß İ", "a b\x1cd\x85e", "'s's 12.5!?, …,", "a_. _a 1. '.'s. ª. it's. you're,", "x" * 3000 + "."]
    for text in [t for t in TEXTS if t] + odd:
        ids = codec.tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.of(text) == np.array(ids, "<u4").tobytes(), text[:40]
    rows = packing.pack_documents(docs, path, with_ids=True).collect()
    by_doc, filled = Counter(), {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 2048 and r.start == 2048 * r.piece
        by_doc[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    expected = Counter()
    for r in docs.collect():
        expected[r.doc_id] += len(codec.of(r.text)) // 4 + 1
    assert by_doc == expected
    for parts in filled.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end = at + n
        assert end <= 2048
    assert len(filled) <= math.ceil(sum(expected.values()) / 2048) + 1
    assert packing.pack_documents(none, path).count() == 0


def test_best_fit_is_near_the_bound():
    r = random.Random(2)
    for size in (10, 100, 2048):
        for _ in range(10):
            counts = Counter(r.randint(1, size) if r.random() < 0.5 else r.randint(1, max(1, size // 4)) for _ in range(r.randint(1, 3000)))
            runs = packing.best_fit_runs(counts, size)
            fill, placed = {}, Counter()
            for x in runs.itertuples():
                assert x.first == placed[x.length]
                placed[x.length] += x.n
                for s in range(x.sequence, x.sequence + x.n):
                    assert fill.get(s, 0) == x.offset
                    fill[s] = x.offset + x.length
            assert placed == counts and max(fill.values()) <= size
            least = max(math.ceil(sum(k * n for k, n in counts.items()) / size), sum(n for k, n in counts.items() if 2 * k > size))
            assert len(fill) <= least * 11 / 9 + 1
    assert len(packing.best_fit_runs({}, 10)) == 0


def test_best_fit_in_shares(spark, monkeypatch):
    r = random.Random(12)
    monkeypatch.setattr(packing, "SHARE", 500)
    for longest in (2048, 300, 2048 * 2):
        counts = Counter(min(2048, r.randint(1, longest)) for _ in range(6000))
        runs = packing.best_fit(spark.createDataFrame(sorted(counts.items()), "length long, n long"), 2048).collect()
        fill, places = {}, {}
        for x in runs:
            places.setdefault(x.length, []).append((x.first, x.n))
            for s in range(x.sequence, x.sequence + x.n):
                fill.setdefault(s, []).append((x.offset, x.length))
        for n, own in places.items():  # every rank once
            assert [a for a, _ in sorted(own)] == [sum(k for _, k in sorted(own)[:i]) for i in range(len(own))] and sum(k for _, k in own) == counts[n]
        assert set(places) == set(counts)
        for parts in fill.values():
            assert [a for a, _ in sorted(parts)] == [sum(k for _, k in sorted(parts)[:i]) for i in range(len(parts))] and sum(k for _, k in parts) <= 2048
        alone = packing.best_fit_runs(counts, 2048)
        assert len(fill) <= len({s for x in alone.itertuples() for s in range(x.sequence, x.sequence + x.n)}) * 1.02 + packing.SHARES
    assert packing.best_fit(spark.createDataFrame([], "length long, n long"), 2048).count() == 0


def test_ids_of_random_strings():
    codec, r = packing.WordIds(packing.tokenizer_path("word_bpe_49k.json")), random.Random(1)
    assert codec.of("KADİ.") == codec.encode("KADİ.")
    alphabet = "abzKİıÉéßñÇ.,;:!?'’-_1٣²½ǅΣσ日\u0307\u0301 \t\n\x85\u00a0ﬁ"
    for _ in range(100_000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 12)))
        assert codec.of(text) == codec.encode(text), repr(text)


def test_quality_counts(docs, none):
    for text in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(w) > 3000:
            continue
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {k for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for k in range(i, i + 3)}
        lines = (text or "").split("\n")
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
        assert quality.base_counts(text) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))
    out = {r.doc_id: r for r in quality.quality_rules(docs).collect() if r.doc_id is not None}
    assert not out[0].kept and out[0].base_failed and not out[12].kept and quality.quality_rules(docs).count() == docs.count()
    assert quality.quality_rules(none).count() == 0


def test_quality_divergence(spark):
    r = random.Random(8)
    common, rare = "the of and to in a is it for on".split(), [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    prose = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else r.choice(rare) for _ in range(n))
    rows = [(i, prose(200), "en") for i in range(60)] + [(100, " | ".join(r.sample(rare, 100)), "en"), (101, " ".join(f"{x}*#$%" for x in r.sample(rare, 100)), "en"), (102, prose(55), None)]
    out = {x.doc_id: x.kept for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i] for i in range(60)) and not out[100] and not out[101] and out[102]
    p, q = np.array([1.0, 2, 0, 5]), np.array([2.0, 1, 4, 0])
    p1, q1 = p / p.sum(), q / q.sum()
    m = (p1 + q1) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert quality.js_distance(p, q) == pytest.approx(math.sqrt((kl(p1) + kl(q1)) / 2))


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big = "<p>" + words(60000) + "</p>"
    rows = [(5, "http://a/1", "<b>x</b>"), (2, None, "<b>x</b>"), (2, None, "<b>x</b>"), (2, "http://a/2", "<b>x</b>"), (9, "http://a b\n/", None), (4, "u", ""), (7, "v", big), (7, "v", big), (7, "v", big), (8, "v", big), (8, "v", big), (None, "w", "<b>x</b>"), (None, "w", "only"), (11, "z", "é\r\n\r\n日本")]
    rows += [(100 + i, f"http://h/{i}", words(30)) for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("bundle", F.lit(1))
    folder = f"file://{tmp_path}/w"
    index = warc.write_warc(pages, folder)
    got = warc.read_warc(spark, folder, index, payloads=True).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected, seen = Counter(), set()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h or "")
        if to == i and (h or "") not in seen:  # one row is the response, others of its page_id revisit it
            seen.add(h or "")
            to = None
        expected[(i, len(raw), warc.digest(raw), "response" if to is None else "revisit", to)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    for r in index.where("page_id in (5, 7, 11)").collect():
        data = (tmp_path / "w" / r.bundle).read_bytes()
        assert warc.read_record(data, r.frame, r.start)["page_id"] == r.page_id
        import io

        import zstandard

        assert len(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()) > 0
    short = warc.write_warc(pages, f"{folder}2", least=100)
    assert {r.page_id for r in warc.read_warc(spark, f"{folder}2", short).where("record_type = 'revisit'").collect()} == {7, 8}
    monkeypatch.setattr(warc, "BROADCAST", 1)  # the way of many repeated payloads
    again = warc.read_warc(spark, f"{folder}4", warc.write_warc(pages, f"{folder}4"), payloads=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in again) == expected
    empty = warc.write_warc(pages.limit(0), f"{folder}3")
    assert warc.read_warc(spark, f"{folder}3", empty).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            out += [(kind, *m.span())] * ok
    return out


def test_pii_base_and_added_spans(docs, none):
    r = random.Random(4)
    odd = ["a@b.c@d.e x..@-.-", "1.2.3.4.5.6.7.8 300.1.1.1.2", "@@a@b", "+1(((5", "1" * 400, "4111 1111 1111 1111-", "0" * 50 + "1.0.0.1"]
    odd += ["".join(r.choice("ab1.2@+-( )5 ") for _ in range(60)) for _ in range(400)]
    for text in [t for t in TEXTS if t] + odd:
        assert pii.base_spans(text) == slow_spans(text), text[:60]
    model = pii.pii_model()
    text = "call me (459) 555-9246 or mail anna (at) example dot org, order no 4952935900253052 of 2024-11-05, v 1.22.333"
    assert [(s[0], text[s[1] : s[2]]) for s in sorted(model.extra(text, []), key=lambda s: s[1])] == [("phone", "(459) 555-9246"), ("email", "anna (at) example dot org")]
    rows = pii.find_pii(docs).collect()
    for row, text in zip(rows, [x.text for x in docs.collect()]):
        base = slow_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and row.n_email == sum(k == "email" for k, *_ in base)
        assert set(joined.split(",")) <= set(row.spans.split(",")) or not joined
    clean = pii.redact_pii(docs).collect()
    assert [x for x in clean if x.doc_id == 13][0].text == "[EMAIL], [PHONE], [CARD], at [IP] and 300.1.1.1."
    assert len(clean) == docs.count() and pii.find_pii(none).count() == 0 and pii.redact_pii(none).count() == 0
    assert pii.redacted("ab 1.2.3.4567", [("ip", 3, 10), ("card", 5, 13)]) == "ab [IP]"


def test_pii_trees_on_fresh_examples():
    texts, spans, labels = pii.labelled_examples(2000, 77)
    model = pii.pii_model()
    p = model.trees.probability(np.array([pii.features(t, s) for t, s in zip(texts, spans)]))
    told = np.array([q >= model.thresholds[s[0]] for q, s in zip(p, spans)])
    assert (told == np.array(labels)).mean() > 0.98
    assert all(s in pii.candidates(t) for t, s, y in zip(texts, spans, labels) if y)


def test_top_k_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.2, (700, 16)).astype(np.float32)
    x[100:300] = x[0]
    x[300:320] = np.round(x[300:320])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000, None), (1001, [1.0, None] + [0.0] * 14), (1002, [float("nan")] * 16), (1003, [float("inf")] * 16), (1100, [1.0, 2.0]), (1200, []), (1300, [0.5, 0.5]), (None, [0.1] * 16)]
    rows += [rows[200], rows[5]]
    monkeypatch.setattr(topk, "LEAF", 16)
    monkeypatch.setattr(topk, "TREE", 150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 100 = 0")).collect()))
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    expected = []
    for i, q in {i: q for i, q in good if i % 100 == 0}.items():
        best = sorted(((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q)))[:10]
        expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(expected)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_tree_passes_over_entries():
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 400, (20, 32))
    x = np.floor(np.concatenate([c + rng.normal(0, 20, (200, 32)) for c in centers]))
    tree = topk.build_tree(np.arange(len(x)), x)
    best = []
    seen = topk.search(tree, np.array([7]), x[[7]], 10, [best])
    assert seen < len(x) / 2 and sorted((-s, -i) for s, i in best) == sorted((-float(x[7] @ v), i) for i, v in enumerate(x) if i != 7)[:10]


def test_language_id(spark, none):
    r = random.Random(9)
    kinds = {"en": "the of and th ing ou".split(), "de": "der die und sch ei ung".split(), "es": "de la que ción ñ los".split()}
    text = lambda k, n: " ".join("".join(r.choice(kinds[k]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, r.randint(10, 200)), k) for i, k in enumerate(list(kinds) * 150)]
    rows += [(9000, None, "en"), (9001, "123 !!", "en"), (9002, "", None), (9003, text("de", 20000), None), (None, text("en", 50), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    net = language_id.fit_language_id(df, epochs=4)
    out = language_id.identify(df, net, lang="lang_pred").withColumn("held", language_id.held_out()).collect()
    told = {x.doc_id: x for x in out}
    assert net.langs == ["de", "en", "es"] and len(out) == len(rows)
    held = [x for x in out if x.held]
    assert all(x.held == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out if x.doc_id is not None)
    assert sum(x.lang_pred == x.lang for x in held if x.lang) / sum(bool(x.lang) for x in held) > 0.97
    assert [(told[i].lang_pred, told[i].score) for i in (9000, 9001, 9002)] == [("und", 0.0)] * 3 and told[9003].lang_pred == "de"
    x = np.frombuffer(text("en", 80).encode()[:256].ljust(256, b"\0"), np.uint8)
    emb = net.vectors[x]
    slow = np.array([max(sum(emb[i + k] @ net.kernels[k][:, f] for k in range(4)) for i in range(253)) for f in (0, 20, 40)]) + net.bias[[0, 20, 40]]
    first, last = net.tables()
    pairs = (x[:-1].astype(int) << 8) | x[1:]
    assert np.allclose((first[pairs[:253]] + last[pairs[2:255]]).max(axis=0)[[0, 20, 40]], slow, atol=1e-4)
    nothing = language_id.fit_language_id(none)
    assert [r.lang_pred for r in language_id.identify(df.limit(3), nothing, lang="lang_pred").collect()] == ["und"] * 3
    assert language_id.identify(none, net, lang="lang_pred").count() == 0


def test_letters_are_of_category_l(spark):
    net = language_id.train(["the quick and the slow", "der die und das"], ["en", "de"], epochs=1)
    rows = [(1, "½ ² ①"), (2, "ª"), (3, "日"), (4, "१२"), (5, "x²"), (6, None), (7, "")]
    told = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    assert all(told[i] == ("und", 0.0) for i in (1, 4, 6, 7)) and all(told[i][0] in ("en", "de") for i in (2, 3, 5))


def test_training_rows_are_bounded_and_whole(spark):
    rows = [(i, f"{'abc' * (i % 50 + 1)} {i}", ["en", "en", "de"][i % 3]) for i in range(900)] + [(5000 + i, "zz", f"rare{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = language_id.training_sample(docs, 60, 2, 2000)
    whole = {t for _, t, _ in rows}
    assert set(langs) == {"en", "de"} and set(texts) <= whole and all(sum(len(t) for t, k in zip(texts, langs) if k == x) <= 2000 and langs.count(x) <= 60 for x in ("en", "de"))
    held = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert not held & set(texts)
    assert len(language_id.training_sample(docs, 60, 2, 1)[0]) == 2  # a document each, however long


def test_windows_cover_every_position():
    for n in (0, 1, 3, 4, 253, 256, 257, 509, 510, 2000):
        w = language_id.text_windows("a" * n)
        starts = sum(int((row[: language_id.STEP + 3] == 97).sum()) for row in w)
        assert len(w) == max(1, math.ceil(max(0, n - 3) / 253)) and starts >= n


def test_licenses(spark):
    rows = [
        ("a/LICENSE", licenses.TEMPLATES[4][1]), ("a/b/c/x.py", "plain words"), ("a/b/COPYING", licenses.TEMPLATES[5][1]), ("a/b/y.py", "x = 1\n# Licensed under the Apache License, Version 2.0.\ny"),
        ("z/q.py", "none"), ("top.py", None), (None, "text"), ("a/b2/d.txt", ""), ("w/notice-like.txt", "Licensed under CC BY-NC 4.0."), ("w/e/deep/er/f.txt", words(500)), ("w/e/g.txt", words(3000) + "\nReleased under the MIT License.\n" + words(3000)),
        ("a/b/c/x.py", "plain words"), ("k/LICENSE", "nothing of the kind"), ("k/m.py", "m"),
    ]
    rows += [(f"many/{i}.txt", words(80)) for i in range(200)]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string").withColumn("dir", F.lit("x")).withColumn("at", F.lit(1)))
    got = {r.path: (r.license, r.origin, r.from_dir) for r in out.collect()}
    assert out.count() == len(rows)
    assert got["a/LICENSE"] == ("MIT", "own", None) and got["a/b/c/x.py"] == ("GPL-3.0", "inherited", "a/b") and got["a/b/y.py"] == ("Apache-2.0", "own", None)
    assert got["z/q.py"] == got["top.py"] == got[None] == got["k/m.py"] == got["many/3.txt"] == (None, None, None)
    assert got["a/b2/d.txt"] == ("MIT", "inherited", "a") and got["w/e/deep/er/f.txt"] == ("CC-BY-NC-4.0", "inherited", "w") and got["w/e/g.txt"] == ("MIT", "own", None)
    assert licenses.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0
