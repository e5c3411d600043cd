"""Global order: the place of every row, without gathering the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import settled


def placed(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with `name`, each row's place from 1 in this order, which must not leave ties if places are to be the same again.

    Rows are range-partitioned and sorted where they lie; the counts of the partitions before, one number each, make
    their places global.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settled(rows.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = rows.groupBy(F.col("__p").alias("__q")).agg(F.count(F.lit(1)).alias("n")).select("__q", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return rows.join(F.broadcast(bases), F.col("__p") == F.col("__q")).withColumn(name, F.col("__base") + F.col("__i") + 1).drop("__p", "__q", "__i", "__base")
