"""Which intervals hold a point, by equality joins on dyadic blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def dyadic(start: Column, stop: Column) -> Column:
    """The fewest blocks that make up start to stop, both included and not negative: an array of (level, block), where a block
    of a level is the numbers with the same quotient by 2 ** level. No two of them overlap, and there are at most two of a
    level. An interval with a null end, or whose stop comes before its start, has none."""
    start, end = start.cast("long"), stop.cast("long") + 1
    first = lambda k: _right(start + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    last = lambda k: _right(end, k)
    odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
    levels = F.sequence(F.lit(0), F.log2((end - start).cast("double")).cast("int") + 1)
    block = lambda k, b: F.struct(k.alias("level"), b.alias("block"))
    of_level = lambda k: F.filter(
        F.array(F.when((first(k) < last(k)) & odd(first(k)), block(k, first(k))), F.when((first(k) < last(k)) & odd(last(k)), block(k, last(k) - 1))), lambda x: x.isNotNull()
    )
    return F.when(end > start, F.flatten(F.transform(levels, of_level)))


def holding(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, stop: str) -> DataFrame:
    """Every row of points with every row of spans that has the same `on` and holds it: start <= at <= stop. Other columns must
    have names of their own; points and ends are whole numbers from 0.

    A span becomes its dyadic blocks, a point a row for each level that any span uses (at most the logarithm of the longest
    span: the one number that is read first). They meet by equality of `on`, level and block, once a pair, so that the rows
    made are the result's, and a key with very many spans is dealt out by its blocks. Read spans from a table, since they are
    read twice. They are joined by sorting, as blocks take far more memory than the file that they are read from.
    """
    longest = spans.agg(F.max(F.col(stop).cast("long") - F.col(start).cast("long") + 1)).first()[0] or 1
    top = max(0, int(longest).bit_length() - 1)
    blocks = spans.withColumn("__b", F.explode(dyadic(F.col(start), F.col(stop)))).withColumns({"__level": F.col("__b.level"), "__block": F.col("__b.block")}).drop("__b")
    dealt = points.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("__block", _right(F.col(at).cast("long"), F.col("__level")))
    return dealt.join(blocks.hint("merge"), [*on, "__level", "__block"]).drop("__level", "__block")
