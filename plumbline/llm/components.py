"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and each one's smallest node of its component in these links alone."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node long, root long) for every node of the links: root is the smallest node reachable.

    Each task first replaces its links by a star for each of its own components, at most 500,000 links at a time; then
    fewer tasks do so again with what is left, so that a large group has not a star from every task.
    Rounds then take the smallest label of a node's neighbours and the label of its label, both partial minima, until
    no label changes: a chain of n links takes about log n rounds. Every round is a table in the shared folder. Links
    with a null end are ignored; repeated links and loops do no harm.
    """

    def stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= 500_000:
                yield star(pd.concat(held))
                held = []
        if held:
            yield star(pd.concat(held))

    def star(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, roots = local_roots(frame["u"].to_numpy(np.int64), frame["v"].to_numpy(np.int64))
        return pd.DataFrame({"u": nodes, "v": roots})

    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    fewer = max(4, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    once = ends.mapInPandas(stars, "u long, v long").distinct()
    thin = written(once.coalesce(fewer).mapInPandas(stars, "u long, v long").distinct(), "links")
    both = thin.where("u <> v").unionByName(thin.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = written(thin.select("u").unionByName(thin.select(F.col("v").alias("u"))).distinct().select(F.col("u").alias("node"), F.col("u").alias("root"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        low = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        low = written(low, "labels")
        of = low.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        labels = written(low.join(of, F.col("root") == F.col("n2")).select("node", F.col("r2").alias("root"), (F.col("r2") != F.col("old")).alias("moved")), "labels")
    return labels.select("node", "root")
