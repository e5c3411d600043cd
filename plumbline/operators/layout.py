"""Identifiers and places of nodes in a drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .order import placed

WIDTH, HEIGHT, GAP = 160, 60, 40


def node_ids(nodes: DataFrame, column: str = "id") -> DataFrame:
    """(id, node) for each distinct path."""
    return nodes.select(F.col(column).alias("id")).where("id is not null").distinct().withColumn("node", paths.node_id(F.col("id")))


def collisions(ids: DataFrame) -> DataFrame:
    """(node, n, first): identifiers that several paths share, which is an error."""
    return ids.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")


def grid(ids: DataFrame, columns: int, group: str | None = None) -> DataFrame:
    """ids with x and y on a grid of so many columns, in order of id, each group on a grid of its own."""
    if group:
        numbered = ids.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy("id")) - 1)
    else:
        numbered = placed(ids, "id", name="__k").withColumn("__k", F.col("__k") - 1)
    return numbered.withColumns({"x": F.pmod("__k", F.lit(columns)) * (WIDTH + GAP), "y": F.floor(F.col("__k") / columns) * (HEIGHT + GAP)}).drop("__k")
