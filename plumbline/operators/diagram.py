"""The diagram of a graph: layers by longest path, an order inside each, and the drawing as rows of SVG."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import fresh_folder, settled
from .findings import SMALL
from .graph import inner
from .order import placed
from .reach import condensed, in_units

#: Sizes of the drawing: a node's box, and what lies between two in a row and between two rows.
WIDTH, HEIGHT, APART, BELOW = 160, 40, 20, 60


def layered(units: DataFrame, links: DataFrame, small: int = SMALL) -> DataFrame:
    """(unit, layer): 0 for the units (unit) that no link (a, b) leads to, else one more than the largest layer from which
    one does, so the longest way from the top. units and links have no cycle.

    Round by round the units to which no link is left get the next layer, and their links go. A round reads the links that
    are left, and writes what it found. Layers get small long before the last; from `small` links on one task ends the work.
    """
    spark = units.sparkSession
    at, schema, layer = fresh_folder(spark, "layers"), "unit string, layer int", 0
    left = settled(links.select("a", "b").distinct())
    found = units.select("unit").distinct().join(left.select(F.col("b").alias("__b")), F.col("unit") == F.col("__b"), "left_anti")
    while True:
        found.select("unit", F.lit(layer).alias("layer")).write.parquet(f"{at}/{layer}")
        last = spark.read.schema(schema).parquet(f"{at}/{layer}")
        if last.isEmpty() or left.limit(small + 1).count() <= small:
            # the links that are left start in this layer or below, and lead to all units below
            deeper = left.withColumn("first", F.lit(layer)).groupBy("first").applyInPandas(_layers_of, schema)
            return settled(spark.read.schema(schema).parquet(*(f"{at}/{k}" for k in range(layer + 1))).unionByName(deeper))
        gone = last.select(F.col("unit").alias("__u"))
        freed = left.join(gone, F.col("a") == F.col("__u"), "left_semi").select(F.col("b").alias("unit")).distinct()
        left = settled(left.join(gone, F.col("a") == F.col("__u"), "left_anti"))
        found = freed.join(left.select(F.col("b").alias("__b")), F.col("unit") == F.col("__b"), "left_anti")
        layer += 1


def _layers_of(frame: pd.DataFrame) -> pd.DataFrame:
    """The layers of all units that a link leads to; the others are in the layer `first`."""
    out, n = {}, {}
    for a, b in zip(frame["a"], frame["b"]):
        out.setdefault(a, []).append(b)
        n[b] = n.get(b, 0) + 1
    row, layer, rows = [a for a in out if a not in n], int(frame["first"].iloc[0]), []
    while row:
        layer, following = layer + 1, []
        for a in row:
            for b in out.get(a, ()):
                n[b] -= 1
                if not n[b]:
                    following.append(b)
        rows += [(b, layer) for b in following]
        row = following
    return pd.DataFrame(rows, columns=["unit", "layer"])


def arranged(nodes: DataFrame, pairs: DataFrame, *, small: int = SMALL) -> DataFrame:
    """(id, unit, layer, place): where each of nodes.id stands. Who depends on others stands above them; members of a cycle
    (unit, its first member) share a layer. In the top layer nodes go by unit and id; in each other one units go by the mean
    place of the nodes right above that depend on them, ties by unit, members by id. Places count from 1. Layers are worked
    on one after the other; from the one on below which nodes and links are `small` in number, by one task."""
    known = nodes.select("id").distinct()
    own = known.select(F.col("id").alias("__k"))
    edges = inner(pairs).select("source", "target").distinct().join(own, F.col("source") == F.col("__k"), "left_semi").join(own, F.col("target") == F.col("__k"), "left_semi")
    units, links = map(settled, condensed(edges, small))
    each = in_units(known, units, "id", "unit")
    layer = layered(each, links, small)
    rows = settled(each.join(layer.select(F.col("unit").alias("__u"), "layer"), F.col("unit") == F.col("__u")).drop("__u"))
    into = in_units(in_units(edges, units, "source", "__a"), units, "target", "to").where("__a <> to").select("source", "to").distinct()
    # only nodes right above count
    of = lambda x, c: layer.select(F.col("unit").alias(f"__{x}"), F.col("layer").alias(c))
    into = in_units(into, units, "source", "__own").join(of("u", "upper"), F.col("__own") == F.col("__u")).join(of("v", "layer"), F.col("to") == F.col("__v")).where("upper + 1 = layer")
    into = settled(into.select("source", "to", "layer"))
    spark = nodes.sparkSession
    at, schema, number = fresh_folder(spark, "arranged"), "id string, unit string, layer int, place long", 0
    found = placed(rows.where("layer = 0"), "unit", "id")
    deepest = rows.agg(F.max("layer")).first()[0]
    by_tasks = _layers_by_tasks(rows.select("layer").unionByName(into.select("layer")), small)
    while True:
        found.select("id", "unit", "layer", F.col("place").cast("long").alias("place")).write.parquet(f"{at}/{number}")
        if deepest is None or number >= deepest:
            return spark.read.schema(schema).parquet(*(f"{at}/{k}" for k in range(number + 1)))
        above = spark.read.schema(schema).parquet(f"{at}/{number}").select(F.col("id").alias("__i"), F.col("place").alias("__p"))
        number += 1
        if number >= by_tasks:
            below = into.where(F.col("layer") >= number).join(above, F.col("source") == F.col("__i"), "left").select(F.col("source").alias("id"), F.col("to").alias("unit"), "layer", F.col("__p").alias("above"), F.lit(True).alias("link"))
            both = below.unionByName(rows.where(F.col("layer") >= number).select("id", "unit", "layer", F.lit(None).cast("long").alias("above"), F.lit(False).alias("link")))
            both.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_places_of, schema).write.parquet(f"{at}/{number}")
            return spark.read.schema(schema).parquet(*(f"{at}/{k}" for k in range(number + 1)))
        mean = into.where(F.col("layer") == number).join(above, F.col("source") == F.col("__i")).groupBy("to").agg(F.avg("__p").alias("mean"))
        found = placed(rows.where(F.col("layer") == number).join(mean, F.col("unit") == F.col("to")).select("id", "unit", "layer", "mean"), "mean", "unit", "id")


#: Layers whose sizes the driver reads; of more, all are worked on by rounds.
MOST_ROUNDS = 5000


def _layers_by_tasks(layers: DataFrame, small: int) -> int:
    """From which layer on no more than `small` rows are left, so that one task may end the work; at least the first."""
    left, sizes = layers.count(), dict(layers.where(F.col("layer") < MOST_ROUNDS).groupBy("layer").count().collect())
    for number in range(MOST_ROUNDS):
        left -= sizes.get(number, 0)
        if left <= small:
            return number + 1 if small else 2**31
    return 2**31


def _places_of(frame: pd.DataFrame) -> pd.DataFrame:
    """The places in the layers of a frame: nodes, and links to their units from the layer above each; the first layer's links
    have the places above, the others' come about here."""
    place: dict[str, int] = {}
    rows: list[tuple] = []
    for layer, own in frame.groupby("layer", sort=True):
        links, here = own[own["link"]], own[~own["link"]]
        sums: dict[str, list[int]] = {}
        for source, unit, above in zip(links["id"], links["unit"], links["above"]):
            s = sums.setdefault(unit, [0, 0])
            s[0] += place[source] if source in place else int(above)
            s[1] += 1
        order = sorted((float(sums[u][0]) / sums[u][1], u, i) for i, u in zip(here["id"], here["unit"]))
        place = {i: n for n, (_, _, i) in enumerate(order, 1)}
        rows += [(i, u, layer, n) for n, (_, u, i) in enumerate(order, 1)]
    return pd.DataFrame(rows, columns=["id", "unit", "layer", "place"])


def _text(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def drawn(where: DataFrame, pairs: DataFrame) -> DataFrame:
    """(part, layer, place, other_layer, other_place, text): the drawing as rows of SVG, to be written in the order of the
    other columns: its head, the edges as lines, the nodes as boxes with their ids, its end. where is what arranged gives."""
    x = lambda place: (place - 1) * (WIDTH + APART) + APART
    y = lambda layer: layer * (HEIGHT + BELOW) + APART
    words = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    size = where.agg(F.coalesce(F.max("place"), F.lit(0)).alias("w"), F.coalesce(F.max("layer") + 1, F.lit(0)).alias("h"))
    none = [F.lit(0).alias(c) for c in ("layer", "place", "other_layer", "other_place")]
    head = size.select(F.lit(0).alias("part"), *none, words('<svg xmlns="http://www.w3.org/2000/svg" width="', F.col("w") * (WIDTH + APART) + APART, '" height="', F.col("h") * (HEIGHT + BELOW) + APART, '">').alias("text"))
    end = size.select(F.lit(3).alias("part"), *none, F.lit("</svg>").alias("text"))
    of = lambda i: where.select(F.col("id").alias(f"__{i}"), F.col("layer").alias(f"l{i}"), F.col("place").alias(f"p{i}"))
    edges = inner(pairs).select("source", "target").distinct().join(of(1), F.col("source") == F.col("__1")).join(of(2), F.col("target") == F.col("__2"))
    line = words('<path class="edge" d="M', x(F.col("p1")) + WIDTH // 2, " ", y(F.col("l1")) + HEIGHT, " L", x(F.col("p2")) + WIDTH // 2, " ", y(F.col("l2")), '"/>')
    lines = edges.select(F.lit(1).alias("part"), F.col("l1").alias("layer"), F.col("p1").alias("place"), F.col("l2").alias("other_layer"), F.col("p2").alias("other_place"), line.alias("text"))
    box = words('<g class="node"><rect x="', x(F.col("place")), '" y="', y(F.col("layer")), f'" width="{WIDTH}" height="{HEIGHT}"/><text x="', x(F.col("place")) + WIDTH // 2, '" y="', y(F.col("layer")) + HEIGHT // 2, '">', _text(F.col("id")), "</text></g>")
    boxes = where.select(F.lit(2).alias("part"), "layer", "place", F.lit(0).alias("other_layer"), F.lit(0).alias("other_place"), box.alias("text"))
    order = ["part", "layer", "place", "other_layer", "other_place"]
    cast = lambda df: df.select(*(F.col(c).cast("long").alias(c) for c in order), "text")
    return cast(head).unionByName(cast(lines)).unionByName(cast(boxes)).unionByName(cast(end))
