"""Exact top-k search by inner product with M-trees."""

from __future__ import annotations

import heapq
import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Vectors of one tree, of one leaf page, and entries of one inner page; queries of one block.
TREE, LEAF, FAN, BLOCK = 8192, 128, 16, 256
#: Bytes of queries up to which they are broadcast to the trees; more are shuffled to them.
BROADCAST = 32 << 20


@dataclass
class Tree:
    """An M-tree over integer vectors, its nodes in pages.

    Inner products become distances by one more coordinate, sqrt(top - |x|^2): a query (q, 0) is nearer to x the larger
    its inner product. Pages hold entries in a row: entry i of an inner page has a routing vector, a covering radius,
    its distance from the page's own routing vector, and a child page; of a leaf page a vector, its id and that distance.
    peak is the largest component by size; it tells in which arithmetic scores are exact.
    """

    top: float
    ids: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    pages: list[tuple[bool, int, int]]
    routes: np.ndarray
    route_parent: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    peak: float

    def scores(self, rows: np.ndarray, qs: np.ndarray) -> np.ndarray:
        """The exact inner products of queries with these vectors: in doubles while all sums stay below 2**53, else in
        64-bit integers, else in whole numbers of any size."""
        most = float(np.abs(qs).max(initial=0))
        if self.peak * most * qs.shape[1] < 2.0**53:
            return qs @ self.vectors[rows].T.astype(np.float64)
        if max(self.peak, most, self.peak * most * qs.shape[1]) < 2.0**62:
            return qs.astype(np.int64) @ self.vectors[rows].T.astype(np.int64)
        whole = [list(map(int, x)) for x in self.vectors[rows].tolist()]
        out = np.empty((len(qs), len(whole)), dtype=object)
        for i, q in enumerate(qs.tolist()):
            q = list(map(int, q))
            out[i] = [sum(x * y for x, y in zip(q, v)) for v in whole]
        return out


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each the farthest from those chosen before it; the first is the farthest from the mean. So
    clusters get a routing vector each, and covering radii stay small."""
    chosen = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> Tree:
    """Bulk load: at most FAN routing vectors, far from each other, are chosen for a node from an even choice of its
    vectors; each vector goes to the nearest, and each group is a child. Groups that don't divide (copies) are cut by
    number."""
    x = vectors.astype(np.float64)
    norms = (x * x).sum(axis=1)
    top = float(norms.max(initial=0))
    full = np.concatenate([x, np.sqrt(np.maximum(top - norms, 0))[:, None]], axis=1)
    leaves: list[np.ndarray] = []
    leaf_parent: list[np.ndarray] = []
    pages: list[tuple[bool, int, int] | None] = []
    routes, route_parent, radius, child = [], [], [], []

    def far(rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.sqrt(((full[rows] - center) ** 2).sum(axis=1))

    def grow(rows: np.ndarray, center: np.ndarray) -> int:
        page = len(pages)
        pages.append(None)
        if len(rows) <= LEAF:
            d = far(rows, center)
            start = sum(map(len, leaves))
            leaves.append(rows)
            leaf_parent.append(d)
            pages[page] = (True, start, start + len(rows))
            return page
        some = min(len(rows), 32 * FAN)
        centers = spread(full[[rows[len(rows) * i // some] for i in range(some)]], FAN)
        d2 = (full[rows] ** 2).sum(axis=1)[:, None] - 2 * full[rows] @ centers.T + (centers**2).sum(axis=1)[None, :]
        to = d2.argmin(axis=1)
        if np.bincount(to).max() == len(rows):
            to = np.arange(len(rows)) * FAN // len(rows)
            centers = np.repeat(centers[:1], FAN, axis=0)
        own = [(centers[i], rows[to == i]) for i in range(len(centers)) if (to == i).any()]
        start = len(routes)
        for c, part in own:
            routes.append(c)
            route_parent.append(float(np.sqrt(((c - center) ** 2).sum())))
            radius.append(float(far(part, c).max()))
            child.append(-1)
        pages[page] = (False, start, start + len(own))
        for i, (c, part) in enumerate(own):
            child[start + i] = grow(part, c)
        return page

    zero = np.zeros(full.shape[1])
    grow(np.arange(len(x)), zero)
    order = np.concatenate(leaves)
    shape = (0, full.shape[1])
    peak = float(np.abs(x).max(initial=0))
    small = np.int32 if peak < 2**31 else np.float64
    return Tree(top, ids[order], x[order].astype(small), np.concatenate(leaf_parent), pages, np.array(routes).reshape(len(routes), shape[1]), np.array(route_parent), np.array(radius), np.array(child, int), peak)


def search(tree: Tree, ids: np.ndarray, qs: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> int:
    """Best-first search of a block of queries. best[i] is the heap of (score, -id) of query i, its k best so far, and is
    brought up to date; the number of distances computed is returned.

    Every query has a queue of pages by the least distance they can hold. In each round each takes its next pages, one
    at first and then twice as many as before; queries on the same page are worked on together. An entry whose stored parent distance differs from the query's
    distance to the parent by more than its radius and the k-th best distance is passed over without a computation.
    Bounds are widened by a ten-millionth of the distances' scale, far more than doubles lose; scores are exact.
    """
    size = (qs * qs).sum(axis=1)
    base = size + tree.top
    slack, tiny = 1e-9 * base + 1e-9, 1e-7 * np.sqrt(base) + 1e-9
    bound, least = np.full(len(qs), np.inf), np.full(len(qs), -np.inf)

    def narrow(i: int) -> None:
        if len(best[i]) == k:
            least[i] = np.nextafter(float(best[i][0][0]), -np.inf)  # no more than the k-th score, whatever its size
            bound[i] = np.sqrt(max(0.0, base[i] - 2.0 * float(best[i][0][0])) + slack[i]) + tiny[i]

    def taken(page: int, own: np.ndarray, far: np.ndarray) -> int:
        """These queries, at these distances from the page's routing vector, meet the page's entries."""
        leaf, a, b = tree.pages[page]
        if leaf:
            near = (np.abs(tree.parent[a:b][None, :] - far[:, None]) <= bound[own][:, None]) & (tree.ids[a:b][None, :] != ids[own][:, None])
            rows = np.flatnonzero(near.any(axis=0))
            if len(rows):
                found, names = tree.scores(rows + a, qs[own]), tree.ids[rows + a]
                good = near[:, rows] & (found >= least[own][:, None]).astype(bool)
                for j in np.flatnonzero(good.any(axis=1)).tolist():
                    i, s, n = int(own[j]), found[j, good[j]], names[good[j]]
                    if len(s) > k:
                        first = s >= np.sort(s)[len(s) - k]
                        s, n = s[first], n[first]
                    for x in zip(map(int, s.tolist()), (-n).tolist()):
                        if len(best[i]) < k:
                            heapq.heappush(best[i], x)
                        elif x > best[i][0]:
                            heapq.heapreplace(best[i], x)
                    narrow(i)
            return int(near.sum())
        near = np.abs(tree.route_parent[a:b][None, :] - far[:, None]) - tree.radius[a:b][None, :] <= bound[own][:, None]
        routes = tree.routes[a:b]
        d = np.sqrt(np.maximum(0.0, size[own][:, None] + (routes * routes).sum(axis=1)[None, :] - 2 * qs[own] @ routes[:, :-1].T))
        closest = np.maximum(0.0, d - tree.radius[a:b][None, :] - tiny[own][:, None])
        for j, e in zip(*map(np.ndarray.tolist, np.nonzero(near & (closest <= bound[own][:, None])))):
            heapq.heappush(queues[own[j]], (closest[j, e], int(tree.child[a + e]), d[j, e]))
        return int(near.sum())

    for i in range(len(qs)):
        narrow(i)
    queues: list[list[tuple[float, int, float]]] = [[(0.0, 0, float(np.sqrt(x)))] for x in size]
    alive, seen, turn = list(range(len(qs))), 0, 1
    while alive:
        at: dict[int, list[tuple[int, float]]] = {}
        for i in alive:
            for _ in range(min(turn, len(queues[i]))):
                closest, page, far = heapq.heappop(queues[i])
                if closest > bound[i]:
                    queues[i] = []
                    break
                at.setdefault(page, []).append((i, far))
        for page, own in at.items():
            seen += taken(page, np.array([i for i, _ in own]), np.array([f for _, f in own]))
        alive, turn = [i for i in alive if queues[i]], 2 * turn
    return seen


def _usable(value) -> np.ndarray | None:
    """floor(1024 * x) of a vector as float64, or None if it or a component is null or not finite."""
    if value is None:
        return None
    x = np.array([np.nan if v is None else v for v in value], np.float64) if not isinstance(value, np.ndarray) or value.dtype == object else value.astype(np.float64)
    return np.floor(1024 * x) if np.isfinite(x).all() else None


def packed(rows: DataFrame, most: int, make) -> DataFrame:
    """(part long, blob binary): the usable vectors of each task in lots of at most `most` of one dimension, numbered."""

    def lots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        parts = itertools.count(TaskContext.get().partitionId() << 32)
        for frame in frames:
            for i, value in zip(frame["vec_id"], frame["embedding"]):
                x = _usable(value)
                if x is not None and len(x):
                    ids, xs = held.setdefault(len(x), ([], []))
                    ids.append(int(i))
                    xs.append(x)
                    if len(ids) == most:
                        yield lot(next(parts), *held.pop(len(x)))
        for ids, xs in held.values():
            yield lot(next(parts), ids, xs)

    def lot(part: int, ids: list, xs: list) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "blob": [pickle.dumps(make(np.array(ids, np.int64), np.stack(xs)))]})

    return rows.where("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding").mapInPandas(lots, "part long, blob binary")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of queries the k rows of candidates with the highest inner product of
    floor(1024 * component), ties to the smaller vec_id; all, if there are fewer. Both have vec_id and embedding.

    Each task loads its candidates into M-trees of at most TREE vectors, written as a table. Queries, in blocks of at
    most BLOCK, meet every tree: blocks of BROADCAST bytes together are broadcast, more are dealt out to the trees by a
    shuffle. A task searches its trees one after the other and hands on a query's k best so far. Only k rows for each
    query and task go on to be ranked, and of those k again before the shuffle. Scores are exact (a score beyond a long
    shows as the nearest long). Vectors that are null, empty, or hold a null or non-finite component, and rows of a null
    vec_id, take no part; nor do candidates of another dimension than the query's. Rows of the query's vec_id are its own
    and no candidates; repeated query rows count once, repeated candidates each. Empty tables give an empty result; other
    columns are not read.
    """
    trees = written(packed(candidates, TREE, build_tree), "trees").select(F.col("part").alias("tree_part"), F.col("blob").alias("tree"))
    asked = queries.dropDuplicates(["vec_id", "embedding"])
    blocks = written(packed(asked.repartition(asked.count() // BLOCK + 1), BLOCK, lambda ids, xs: (ids, xs)), "queries").select(F.col("blob").alias("block"))

    def searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        last: tuple = (None, None)
        for frame in frames:
            for part, tree_blob, block_blob in zip(frame["tree_part"], frame["tree"], frame["block"]):
                ids, qs = pickle.loads(block_blob)
                if last[0] != part:
                    last = (part, pickle.loads(tree_blob))
                if qs.shape[1] == last[1].vectors.shape[1]:
                    search(last[1], ids, qs, k, [held.setdefault((int(i), q.tobytes()), []) for i, q in zip(ids, qs)])
            if len(held) > 20_000:
                yield given(held)
                held = {}
        yield given(held)

    def given(held: dict) -> pd.DataFrame:
        rows = [(i, int.from_bytes(hash_of(v), "little", signed=True), -n, max(-(2**63), min(2**63 - 1, s))) for (i, v), best in held.items() for s, n in best]
        return pd.DataFrame(rows, columns=["query_id", "q", "vec_id", "score"])

    # every block meets every tree; a join by dimension, which has one value, would send all to one task
    if (blocks.agg(F.sum(F.length("block"))).first()[0] or 0) <= BROADCAST:
        met = trees.crossJoin(F.broadcast(blocks))
    else:
        n = max(1, trees.count())
        dealt = trees.withColumn("g", F.pmod(F.xxhash64("tree_part"), F.lit(n)))
        met = dealt.join(blocks.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).hint("merge"), "g").select("tree_part", "tree", "block")
    found = met.mapInPandas(searched, "query_id long, q long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hash_of(raw: bytes) -> bytes:
    import xxhash

    return xxhash.xxh64(raw).digest()


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all; unusable vectors take no part, as top_k says."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 100 = 0"), 10)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT query_id, qe, vec_id, CAST(list_sum(list_transform(list_zip(qe, e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON vec_id <> query_id AND len(e) = len(qe)),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
