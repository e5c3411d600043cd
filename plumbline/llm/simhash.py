"""SimHash near-duplicates through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table, written
from .components import components, local_roots

#: Fingerprints of a run that are compared each with each; longer runs look up flips of at most two bits.
PAIRWISE = 1024
#: Variants of three fingerprints or more up to which their table (some 100 bytes each) is broadcast; else it is shuffled.
BROADCAST = 300_000


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text: A-Z lower-cased, words between ASCII white space, `shingle` words joined by a
    space, repeats included; fewer words make one shingle, none (or a null text) make none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in cuts), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of these hashes; 0 if there is none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 16384):
        ones += np.unpackbits(h[i : i + 16384].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes again for k = 0; for each other k other bits of them, as good as independent."""
    if k:
        h = (h ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(29))
    return h


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: 0 for one without words."""
    return majority(shingle_hashes(text, shingle, seed))


def text_key():
    """What tells texts of one doc_id, or of none, apart."""
    return F.xxhash64("text", F.length("text"))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, tables: int = 1) -> DataFrame:
    """(doc_id, key, f0, f1, ...): the text's key and one fingerprint, as a signed long, for each table."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            hashes = [shingle_hashes(t, shingle, seed) for t in frame["text"]]
            own = {f"f{k}": np.array([majority(mixed(h, k)) for h in hashes], np.uint64).view(np.int64) for k in range(tables)}
            yield pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], **own})

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text").mapInPandas(hashed, "doc_id long, key long" + "".join(f", f{k} long" for k in range(tables)))


class Cuts:
    """The 64 bits in segments, and for each segment the other bits in pieces.

    A pair of fingerprints may meet in many runs; `owns` picks the one that links it: the first segment that differs by
    at most one bit, there the wildcard at that bit (at the segment's first one if none differs), and the first piece
    without a difference.
    """

    def __init__(self, max_bits: int, segments: int):
        self.max_bits = max_bits
        ends = [64 * i // segments for i in range(segments + 1)]
        self.segments = [range(i, j) for i, j in zip(ends, ends[1:])]
        self.masks = [sum(1 << k for k in bits) for bits in self.segments]
        rest = [[k for k in range(64) if k not in bits] for bits in self.segments]
        n = max_bits + 1
        self.pieces = [[sum(1 << k for k in r[len(r) * q // n : len(r) * (q + 1) // n]) for q in range(n)] for r in rest]

    def segment(self, pos: int) -> int:
        return next(s for s, bits in enumerate(self.segments) if pos in bits)

    def owns(self, x: np.ndarray, pos: int, piece: int) -> np.ndarray:
        """Whether the run of this wildcard and piece links pairs that differ by the bits x."""
        s = self.segment(pos)
        ok = np.bitwise_count(x) <= self.max_bits
        if pos != self.segments[s][0]:
            ok &= (x & np.uint64(1 << pos)) != 0
        for m in self.masks[:s]:
            ok &= np.bitwise_count(x & np.uint64(m)) > 1
        for m in self.pieces[s][:piece]:
            ok &= (x & np.uint64(m)) != 0
        return ok


def near_links(fps: np.ndarray, owns, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What the links between these fingerprints connect, as a star for each component: a row for each of its other
    fingerprints with its smallest one. owns tells for differences which of them link.

    Up to PAIRWISE fingerprints are compared with each other; of more, every owned flip of at most two bits is looked up.
    For more bits than two they are parted: the bits in which they vary are cut into max_bits + 1 blocks, in one of which a
    linked pair is equal; those that are equal in a block are looked at in turn, parted again while they are many.
    """
    fps = np.unique(fps)
    if len(fps) < 2:
        return fps[:0], fps[:0]
    a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def add(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal a, b
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
        if len(a) > 1_000_000:
            a, b = local_roots(a, b)

    def compared(some: np.ndarray) -> None:
        vary = int(np.bitwise_or.reduce(some ^ some[0]))
        bits = [1 << k for k in range(64) if vary >> k & 1]
        if len(some) <= PAIRWISE or len(bits) <= max_bits:
            for i in range(0, len(some), 256):
                block, others = some[i : i + 256], some[i:]
                j, k = np.nonzero(np.triu(owns(block[:, None] ^ others[None, :]), 1))
                add(np.minimum(block[j], others[k]), np.maximum(block[j], others[k]))
            return
        for q in range(max_bits + 1):
            part = some & np.uint64(sum(bits[q :: max_bits + 1]))
            order = np.argsort(part, kind="stable")
            for group in np.split(some[order], np.flatnonzero(np.diff(part[order])) + 1):
                if len(group) > 1:
                    compared(group)

    if len(fps) <= PAIRWISE or max_bits > 2:
        compared(fps)
    else:
        bits = [1 << k for k in range(64)]
        flips = np.array(sorted({x | y for x in bits for y in (bits if max_bits == 2 else [x])}), np.uint64)
        for m in flips[owns(flips)]:
            other = fps ^ m
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = (fps[at] == other) & (fps < other)
            add(fps[hit], other[hit])
    if not len(a):
        return a, b
    nodes, roots = local_roots(a, b)
    return nodes[nodes != roots], roots[nodes != roots]


def simhash_links(fps: DataFrame, max_bits: int = 2, segments: int | None = None) -> DataFrame:
    """(a, b) between distinct fingerprints, connecting exactly what links of at most max_bits differing bits connect.

    The 64 bits are cut into ceil((max_bits + 1) / 2) segments, so that in any linked pair one segment differs by at
    most one bit (two each would make more than max_bits). A segment of w bits gives w variants, each with one bit as
    wildcard: 64 rows a fingerprint. Two segments that differ by at most one bit share a variant, so an equality join
    on it finds every link; each is verified. A variant of two fingerprints gives its pair from a partial aggregate
    alone. Those of more are joined again under one of max_bits + 1 pieces of their other bits (one piece must be
    equal) and met in sorted runs. A run is of distinct fingerprints that agree in all but few bits; it gives a star
    for each component, not all its pairs, and only of pairs that no other run has. A hot variant is thus dealt out by
    pieces. Fewer segments than that may be asked for: then pairs that differ by 2 * segments bits or more are linked
    only if one segment differs by at most one bit.
    """
    cuts = Cuts(max_bits, segments or (max_bits + 2) // 2)
    whole = F.col("fp")
    mask = lambda x: F.lit(x - (1 << 64) * (x >> 63))  # noqa: E731  these bits, as a signed long
    variants = [F.struct(F.lit(p).alias("pos"), whole.bitwiseAND(mask(m & ~(1 << p))).alias("bits")) for bits, m in zip(cuts.segments, cuts.masks) for p in bits]
    # few bytes make many rows here: dealt out anew, so that the variants are made on all cores
    spread = fps.select("fp").distinct().repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.select("fp", F.explode(F.array(*variants)).alias("v")).select("fp", "v.pos", "v.bits")
    counted = written(rows.groupBy("pos", "bits").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "variants")
    x = F.col("a").bitwiseXOR(F.col("b"))
    owned = F.lit(False)
    for s, bits in enumerate(cuts.segments):
        here = F.col("pos").between(bits[0], bits[-1]) & ((F.col("pos") == bits[0]) | (x.bitwiseAND(mask(cuts.masks[s])) != 0))
        for m in cuts.masks[:s]:
            here &= F.bit_count(x.bitwiseAND(mask(m))) > 1
        owned |= here
    pairs = counted.where((F.col("n") == 2) & (F.bit_count(x) <= max_bits) & owned).select("a", "b")
    full = counted.where("n > 2").select("pos", "bits")
    if full.count() <= BROADCAST:
        full = F.broadcast(full)
    pieces = F.lit(None)
    for bits, own in zip(cuts.segments, cuts.pieces):
        parts = F.array(*(F.struct(F.lit(q).alias("piece"), whole.bitwiseAND(mask(m)).alias("part")) for q, m in enumerate(own)))
        pieces = F.when(F.col("pos").between(bits[0], bits[-1]), parts).otherwise(pieces)
    runs = rows.join(full, ["pos", "bits"]).select("fp", "pos", "bits", F.explode(pieces).alias("p")).select("fp", "pos", "bits", "p.piece", "p.part")

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, run = None, []
        for frame in frames:
            keys = frame[["pos", "bits", "piece", "part"]].to_numpy(np.int64)
            fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
            for x, y in zip(starts, [*starts[1:], len(keys)]):
                if key is not None and tuple(keys[x]) == key:
                    run.append(fps[x:y])
                    continue
                yield from links(key, run)
                key, run = tuple(keys[x]), [fps[x:y]]
        yield from links(key, run)

    def links(key: tuple | None, run: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        if sum(map(len, run)) > 1:
            a, b = near_links(np.concatenate(run), lambda x: cuts.owns(x, int(key[0]), int(key[2])), max_bits)
            if len(a):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    by = ["pos", "bits", "piece", "part"]
    return pairs.unionByName(runs.repartition(*by).sortWithinPartitions(*by).mapInPandas(met, "a long, b long"))


def rooted_rows(docs: DataFrame, *, shingle: int = 3, max_bits: int = 2, seed: int = 42, tables: int = 1, segments: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, f0, ..., node) for every row of docs, and (node, low, root) for every node: its smallest doc_id
    and its component."""
    names = [f"f{k}" for k in range(tables)]
    node = F.col("f0") if tables == 1 else F.xxhash64(*names)
    own = written(fingerprints(docs, shingle, seed, tables).withColumn("node", node), "fingerprints")
    nodes = written(own.groupBy("node", *names).agg(F.min("doc_id").alias("low")), "distinct")
    if tables == 1:
        links = simhash_links(nodes.select(F.col("f0").alias("fp")), max_bits, segments)
    else:
        parts = []
        for name in names:  # a fingerprint's smallest node stands for it; its other nodes are linked to that one
            firsts = written(nodes.groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("k")), "firsts")
            found = simhash_links(firsts, max_bits, segments)
            of = lambda x, f=firsts: f.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first"))
            parts.append(found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b")))
            parts.append(nodes.join(firsts.where("k > 1"), F.col(name) == F.col("fp")).select(F.col("node").alias("a"), F.col("first").alias("b")))
        links = parts[0]
        for part in parts[1:]:
            links = links.unionByName(part)
    roots = components(links, "a", "b").withColumnRenamed("node", "of")
    rooted = written(nodes.join(roots, F.col("node") == F.col("of"), "left").select("node", "low", F.coalesce("root", "node").alias("root")), "roots")
    return own, rooted


def simhash_components(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, fingerprint of 16 lowercase hex digits, component_id) for every row of docs.

    Rows whose fingerprints differ by at most max_bits bits are linked; component_id is the smallest doc_id reachable,
    its own included. With more tables, fingerprints of other bits of the same hashes link rows too: a pair that one
    table misses by chance another may find. Rows of equal fingerprints, exact copies among them, count as one in all
    the work on links. A null, empty or blank text has fingerprint 0 and is linked like any other. Rows that repeat a
    doc_id each have a row. A null doc_id has a row and never is the smallest, unless all of its component are null.
    Takes the parameters of rooted_rows. Other columns are not read. An empty table gives an empty one.
    """
    own, rooted = rooted_rows(docs, **how)
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    found = rooted.select("node", "root").join(lows, "root").select(F.col("node").alias("of"), "component_id")
    return own.join(found, F.col("node") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row of docs for each root of rooted (first: whether there is no doc_id, doc_id, key; root): that of the smallest first."""
    found = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__k"))
    keyed = docs.withColumn("__key", text_key())
    kept = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).drop("__key")


def simhash_dedup(docs: DataFrame, **how) -> DataFrame:
    """docs with one row for each component: that of the smallest doc_id; of several rows with it, one.

    Takes the parameters of rooted_rows. Rows of a null doc_id are kept only if their component has no other. Components
    are told apart by doc_id and text, so that those of null or repeated ids have a row each.
    """
    own, rooted = rooted_rows(docs, **how)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    by_node = own.groupBy("node").agg(F.min(first).alias("first"))  # copies are one node: partial sums before the join
    return first_rows(docs, by_node.join(rooted.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of")).select("first", "root"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null and blank texts have fingerprint 0, null ids a row, as simhash_components says."""
    return simhash_components(table(spark, sf_dir, "documents"))


