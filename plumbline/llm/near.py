"""Near-duplicates by the Jaccard similarity of word shingles, verified pair by pair.

SimHash (simhash.py) gives the first candidates, those of few differing bits. It can't give all: at a similarity of 0.8
some ten of 64 bits differ. What it leaves is found by bands of MinHashes and, inside crowded bands, by rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, written
from .components import components
from .simhash import first_rows, majority, shingle_hashes, simhash_links, text_key

#: Bands of WIDTH MinHashes: of pairs of similarity 0.8 all but (1 - 0.8 ** 4) ** 20, 1 in 38,000, share one.
BANDS, WIDTH = 20, 4
#: Differing bits of fingerprints up to which SimHash proposes a pair: two segments find every such pair.
BITS = 3
#: Pairs of one leader from which its set doesn't go to one task with them all: it is broadcast, while the sets of all such
#: leaders have at most SENT shingles (8 bytes each) together; else its pairs are dealt out to SHARES, each with a copy.
HOT, SENT, SHARES = 1000, 8_000_000, 32
#: Texts that have one shingle early from which they meet by size classes; each class is by this factor larger than the last.
COMMON, CLASS = 64, 1.02
#: Rows (some 60 bytes each) up to which the table of wanted texts is broadcast to the texts.
BROADCAST = 300_000
#: Counters of shingles by hash; they only order a text's shingles, so that one that counts for several does no harm.
COUNTERS = 1 << 18
_seeds = np.random.default_rng(7).integers(1, 2**63, (2, BANDS * WIDTH), np.uint64) | np.uint64(1)


def band_hashes(own: np.ndarray) -> list[int]:
    """A signed hash for each band of MinHashes of this set; none of an empty one."""
    if not len(own):
        return []
    low = np.full(BANDS * WIDTH, 2**64 - 1, np.uint64)
    for i in range(0, len(own), 4096):
        x = (own[i : i + 4096, None] ^ _seeds[0]) * _seeds[1]
        low = np.minimum(low, ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes()) for b in low.reshape(BANDS, WIDTH)], np.uint64).view(np.int64).tolist()


def signed(own: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0])


def near_links(nodes: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b) between nodes, connecting what candidate pairs of similarity `least` or more connect.

    Candidates are pairs of SimHash links and pairs that share a band (a run is the nodes of one band's hash). A pair of
    one component needs no verification. So SimHash links are verified first; then each node meets its runs' leaders,
    the most central nodes, by which large groups come together without all their pairs, and members of groups that stay
    in parts meet those that lack the same of a leader's set; `rare_pairs` finds what is left between components.
    """
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("k")), "firsts")
    of = lambda x: firsts.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first"))
    near = simhash_links(firsts.select("fp"), BITS).join(of("a"), "a").join(of("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    same = nodes.select("node", F.col("fp").alias("p")).join(firsts.where("k > 1"), F.col("p") == F.col("fp")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    proposed = written(near.unionByName(same).where("a <> b"), "proposed")
    rows = nodes.select("node", "size", F.posexplode("bands").alias("band", "h"))
    runs = rows.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(rows.join(runs, ["band", "h"]), "members")
    degrees = members.groupBy(F.col("node").alias("of")).agg(F.sum("n").alias("degree"))
    ends = proposed.select(F.col("a").alias("of")).unionByName(proposed.select(F.col("b").alias("of"))).unionByName(members.select(F.col("node").alias("of"))).distinct()
    wanted = written(ends.join(nodes, F.col("node") == F.col("of")).select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__k")), "wanted")
    wanted = wanted.hint("broadcast" if wanted.count() <= BROADCAST else "merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__k")), "left_semi")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            found = [np.unique(shingle_hashes(t, shingle)) for t in frame["text"]]
            yield pd.DataFrame({"node": [signed(x) for x in found], "own": [x.view(np.int64) for x in found]})

    sets = written(texts.select("text").mapInPandas(hashed, "node long, own array<long>").dropDuplicates(["node"]), "sets")
    sized = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9  # noqa: E731  else they can't be that similar

    def met(pairs: DataFrame) -> DataFrame:
        """(b, a, x, y): the pairs with the sets of a and of b."""
        pairs = written(pairs.select("a", "b").distinct(), "pairs")
        hot = written(pairs.groupBy("b").count().where(F.col("count") >= HOT).select("b"), "hot")
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
        of = sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
        leaders = of.join(hot, "b", "left_semi")
        if (leaders.agg(F.sum(F.size("y"))).first()[0] or 0) <= SENT:
            crowded = left.join(F.broadcast(leaders), "b")
        else:
            copies = leaders.select("b", "y", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
            crowded = left.join(hot, "b", "left_semi").withColumn("share", F.pmod(F.xxhash64("a"), F.lit(SHARES)).cast("int")).join(copies, ["b", "share"]).drop("share")
        return crowded.select("b", "a", "x", "y").unionByName(left.join(hot, "b", "left_anti").join(of, "b").select("b", "a", "x", "y"))

    both = F.size(F.array_intersect("x", "y"))
    alike = lambda share: both >= share * (F.size("x") + F.size("y") - both) - 1e-9

    def verified(pairs: DataFrame) -> DataFrame:
        return written(met(pairs).where(alike(least)).select("a", "b"), "near")

    def placed(links: DataFrame) -> DataFrame:
        roots = components(links, "a", "b").withColumnRenamed("node", "of")
        return written(central.join(roots, F.col("node") == F.col("of"), "left").select(*central.columns, F.coalesce("root", "node").alias("root")), "placed")

    def led(at: DataFrame) -> DataFrame:
        """at with its run's leader: the node that shares most bands with most others, ties by a hash."""
        leads = at.groupBy("band", "h").agg(F.max(F.struct("degree", F.xxhash64("node").alias("rank"), "node", "root", "size")).alias("lead"))
        return at.join(leads, ["band", "h"])

    def asked(at: DataFrame) -> DataFrame:
        apart = led(at).where((F.col("root") != F.col("lead.root")) & sized(F.col("size"), F.col("lead.size")))
        return apart.groupBy("node").agg(F.max("lead").alias("lead")).select(F.col("node").alias("a"), F.col("lead.node").alias("b"))

    def lacking(at: DataFrame) -> DataFrame:
        """Pairs for loose groups, whose members are mostly just too far from their leader and from each other. Those of a
        leader with over COMMON, of several components, are told apart by what of its set they lack: who lacks the same is
        nearer. For each shingle lacked they ask the one that is nearest to the leader. A member asks at most as many as it
        lacks; those who have no neighbour in common with the leader (1 - similarity is a distance) ask nobody."""
        to = led(at).groupBy("node", "root").agg(F.max("lead").alias("lead")).select(F.col("node").alias("of"), "root", F.col("lead.node").alias("led"))
        to = written(to, "led")
        loose = to.groupBy("led").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where((F.col("n") > COMMON) & (F.col("least") != F.col("most"))).select("led")
        to = to.join(loose, "led", "left_semi")
        rows = met(to.select(F.col("of").alias("a"), F.col("led").alias("b"))).where(alike(2 * least - 1)).select("a", "b", (F.size("x") - both).alias("more"), F.array_except("y", "x").alias("lack"))
        lack = rows.join(to.select("of", "root"), F.col("a") == F.col("of")).select("a", "b", "root", (F.col("more") + F.size("lack")).alias("far"), F.explode("lack").alias("s"))
        lack = written(lack, "lack")
        nearest = lack.groupBy("b", "s").agg(F.max(F.struct(-F.col("far"), F.xxhash64("a").alias("rank"), F.col("a").alias("node"), "root")).alias("lead"))
        return lack.join(nearest, ["b", "s"]).where("root <> lead.root").select("a", F.col("lead.node").alias("b"))

    central = written(members.drop("n").join(degrees, F.col("node") == F.col("of")).drop("of"), "central")
    links = verified(proposed)
    links = links.unionByName(verified(asked(placed(links))))
    others = written(led(placed(links)).where("root <> lead.root").drop("lead"), "others")  # than a run's largest group
    links = links.unionByName(verified(asked(others)))
    links = links.unionByName(verified(lacking(placed(links))))
    at = placed(links)
    open_runs = at.groupBy("band", "h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band", "h")
    left = at.join(open_runs, ["band", "h"]).select("node", "root").distinct()
    return links.unionByName(verified(rare_pairs(sets, left, least)))


def early_places(sets: DataFrame, nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(few, larger, smaller): the places that rare_pairs joins: few with each other by the shingle s, larger with smaller by
    s and both size classes."""
    spark = sets.sparkSession
    known = written(sets.join(nodes.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select("node", "root", "own"), "left")
    at = F.pmod("s", F.lit(COUNTERS))
    counted = known.select(F.explode("own").alias("s")).groupBy(at.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    table = np.zeros(COUNTERS, np.int64)
    rows = counted.toPandas()  # at most COUNTERS rows
    table[rows["c"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(table)

    def ordered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sent.value
        for frame in frames:
            for node, root, own in zip(frame["node"], frame["root"], frame["own"]):
                own = np.asarray(own, np.int64)
                n = len(own)
                often = counts[own % COUNTERS]
                first = np.lexsort((own, often))[: int(n - least * n + 1e-9) + 1]
                places = np.flatnonzero(often[first] > 1)  # else no other has it
                if len(places):
                    yield pd.DataFrame({"s": own[first[places]], "node": node, "root": root, "n": n, "i": places})

    early = written(known.mapInPandas(ordered, "s long, node long, root long, n long, i long"), "early")
    often = written(early.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > COMMON).select("s"), "often")
    few = early.join(often, "s", "left_anti")
    share = least / (1 + least)
    # class c has the sizes from ceil(CLASS ** c) up to below the next; no text is smaller than `low` of its class
    scale = lambda x: F.floor(F.log(x.cast("double")) / F.log(F.lit(CLASS)) + 1e-9)
    low = lambda c: F.pow(F.lit(CLASS), c.cast("double"))
    n, i = F.col("n"), F.col("i")
    fits = lambda c: n - i >= share * (n + low(c)) - 1e-6
    dealt = early.join(often, "s", "left_semi").withColumn("c", scale(n))
    larger = dealt.select("*", F.explode(F.filter(F.sequence(scale(F.greatest(n * least - 1e-6, F.lit(1.0))), F.col("c")), fits)).alias("to")).select("s", "node", "root", "n", "i", F.col("c").alias("large"), F.col("to").alias("small"))
    smaller = dealt.select("*", F.explode(F.filter(F.sequence(F.col("c"), scale(n / least + 1e-6)), fits)).alias("to")).select("s", "node", "root", "n", "i", F.col("to").alias("large"), F.col("c").alias("small"))
    return few, larger, smaller


def rare_pairs(sets: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of nodes (node, root) of different roots whose sets can be of similarity `least`; none of those that
    are is left out.

    A text's shingles are put in order, rarest first. Two sets of n and m shingles of which at least the share `least` of
    all is common have at least need = least / (1 + least) * (n + m) in common. So the first common one, at places i and
    j, has need - 1 more after it in both: n - i and m - j are at least need. Then i is below the n - least * n first
    places. Only these are joined, on the shingle; what many texts share comes late in their order and so meets nobody.

    A shingle that stands early in over COMMON texts would still make all pairs of them, if only to drop most by their
    places: texts of one form, say, whose common part comes right after what each has alone. There the bounds are part of
    the key. Sizes are in classes; a text at place i can be the larger one only of classes whose texts are so small, and the
    smaller one only of classes whose texts are so small, that need leaves room for i. So two of one size meet at a shingle
    only in the first n * (1 - least) / (1 + least) places of both.
    """
    share, (few, larger, smaller) = least / (1 + least), early_places(sets, nodes, least)

    def pairs(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
        """Of each pair once: the larger text, of equal ones the smaller node, is on the left."""
        other = right.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("node").alias("b"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("i").alias("j"))
        same = F.lit(True)
        for c in by:
            same &= F.col(c) == F.col(f"__{c}")
        need = F.lit(share) * (F.col("n") + F.col("m")) - 1e-9
        one = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("b")))
        met = left.join(other, same & one & (F.col("root") != F.col("r")) & (F.col("n") - F.col("i") >= need) & (F.col("m") - F.col("j") >= need))
        return met.select(F.col("node").alias("a"), "b")

    return pairs(few, few, ["s"]).unionByName(pairs(larger, smaller, ["s", "large", "small"]))


def near_dedup(docs: DataFrame, *, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row for each component of texts of similarity `least` or more: that of the smallest doc_id.

    The similarity is the Jaccard of the sets of shingles (simhash.shingle_hashes); texts without words are alike, null
    ones too. Every link is verified; a pair is missed if it shares no band and its fingerprints differ by more than BITS
    bits. Equal sets are one node in all the work on links. Rows of a null doc_id are kept only if their component has no
    other; rows of one doc_id are told apart by their texts. Other columns pass, whatever their names; an empty table
    gives an empty one.
    """

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            rows = []
            for doc, key, text in zip(frame["doc_id"], frame["key"], frame["text"]):
                every = shingle_hashes(text, shingle)
                own = np.unique(every)
                rows.append((doc, key, signed(own), len(own), int(np.array([majority(every)], np.uint64).view(np.int64)[0]), band_hashes(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "node", "size", "fp", "bands"]).astype({"doc_id": "Int64"})

    own = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text").mapInPandas(told, "doc_id long, key long, node long, size long, fp long, bands array<long>")
    own = written(own, "bands")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    # fingerprints count repeats, sets don't: of several the smallest
    nodes = written(own.groupBy("node").agg(F.min(first).alias("first"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    roots = components(near_links(nodes, docs, shingle, least), "a", "b").withColumnRenamed("node", "of")
    rooted = nodes.select("node", "first").join(roots, F.col("node") == F.col("of"), "left").select("first", F.coalesce("root", "node").alias("root"))
    return first_rows(docs, rooted)
