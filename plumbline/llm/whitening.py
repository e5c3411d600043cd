"""Whitening of embeddings from an exact integer scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Bits of a limb: sums of limbs over 2**31 tasks still fit a long.
LIMB = 32


def usable(vector: Column) -> Column:
    """Whether a vector is there and has components, all of them finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c), exact: as int64 where that holds them, else as Python's integers."""
    values = values.astype(np.float64)
    if not len(values) or np.abs(values).max() < 2.0**52:
        return np.floor(SCALE * values).astype(np.int64)
    return np.array([SCALE * int(v) if abs(v) >= 2.0**52 else int(np.floor(SCALE * v)) for v in values], dtype=object)


def largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def cross(z: np.ndarray) -> np.ndarray:
    """The exact integers z.T @ z: by floats while their sums stay below 2**53, by int64 below 2**63, else by Python's."""
    most = largest(z) ** 2 * len(z)
    if most < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most < 1 << 63:
        return (z.T @ z).astype(object)
    big = z.astype(object)
    return big.T @ big


def limbs(values: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(places, limb, long): the integers as sums of long * 2**(LIMB * limb)."""
    places, limb = np.arange(len(values)), 0
    while len(places):
        last = np.array([-(1 << LIMB) < v < 1 << LIMB for v in values])
        yield places, limb, np.array([v if end else v & ((1 << LIMB) - 1) for v, end in zip(values, last)], np.int64)
        places, values, limb = places[~last], values[~last] >> LIMB, limb + 1


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)


def scatter(vectors: DataFrame, d: int) -> np.ndarray:
    """The (d + 1) x (d + 1) matrix of exact integers z.T @ z over all rows, z being a row's d shifted components and a 1: so
    cross-products, sums and the number of rows. Tasks add in arbitrary precision; their sums meet as 32-bit limbs by
    partial aggregates; the driver gets d * d numbers, however many rows there are."""

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), dtype=object)
        for batch in parts:
            if batch.num_rows:
                y = _matrix(batch.column(0), d)
                total += cross(np.hstack([y, np.ones((len(y), 1), y.dtype)]))
        i, j = np.triu_indices(d + 1)
        for at, limb, value in limbs(total[i, j]):
            yield pa.RecordBatch.from_arrays([pa.array(i[at], pa.int32()), pa.array(j[at], pa.int32()), pa.array(np.full(len(at), limb), pa.int32()), pa.array(value, pa.int64())], names=["i", "j", "limb", "value"])

    found = vectors.select("vector").mapInArrow(added, "i int, j int, limb int, value long").groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))
    out = np.zeros((d + 1, d + 1), dtype=object)
    for r in found.collect():
        out[r["i"], r["j"]] += r["value"] << LIMB * r["limb"]
    return np.triu(out) + np.triu(out, 1).T


def components(z: np.ndarray, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sums, vectors, values, explained) of a scatter matrix: n * XtX - S * St is formed in integers and divided by n * n
    once, each entry rounded once. Vectors are columns by falling value; the largest entry of each is positive. A value that
    double precision can't tell from 0 is 0."""
    n, sums = z[-1, -1], z[:-1, -1]
    exact = n * z[:-1, :-1] - np.outer(sums, sums)
    covariance = np.array([[v / (n * n) for v in row] for row in exact], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = sum(exact.diagonal()) / (n * n)
    values = np.where(values > len(covariance) * np.finfo(np.float64).eps * max(values[0], 0), values, 0.0)
    return n, sums, vectors, values, values / trace if trace else np.zeros_like(values)


def whiten(df: DataFrame, most: int = 8, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component 1 to `most` (fewer where vectors are shorter): key, component, n, deviation, whitened,
    explained, identity_error.

    A usable vector is not null, not empty, and has only finite components; all must be of one length, and those of another
    than the most frequent one (ties: the longer) take no part. Fit and result are over all usable rows, repeats and
    null keys included. deviation is the exact sum of (n * x - S)**2 in decimal digits, whatever its size. A component of
    eigenvalue 0 (equal rows, fewer rows than dimensions) has explained 0 and a null whitened value; identity_error is over
    the others, and 0 without any. Other columns are not read; no usable row gives an empty table.
    """
    rows = df.where(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, deviation string, whitened array<double>"
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    spark = df.sparkSession
    if lengths is None:
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    d = lengths["d"]
    rows = rows.where(F.size("vector") == d)
    n, sums, vectors, values, explained = components(scatter(rows, d), most)
    live = values > 0
    turned = vectors / np.sqrt(np.where(live, values, 1.0))

    def projected(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            y = _matrix(batch.column(1), d)
            if n * largest(y) + largest(sums) >= 1 << 62:
                y = y.astype(object)
            off = n * y - (sums if y.dtype == object else sums.astype(np.int64))
            exact = off if d * largest(off) ** 2 < 1 << 63 else off.astype(object)
            out = (off.astype(np.float64) / n) @ turned
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(v) for v in (exact * exact).sum(axis=1)], pa.string()), lists], names=["key", "deviation", "whitened"])

    wide = rows.mapInArrow(projected, schema)
    held = [i for i in range(len(values)) if live[i]]
    # the covariance of the results themselves, by Spark's centred co-moments
    pairs = [(i, j) for i in held for j in held if i <= j]
    error = 0.0
    if pairs:
        found = wide.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs)).first()
        error = max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))
    each = wide.select("key", "deviation", F.posexplode("whitened").alias("p", "w"))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("p") + 1)
    return each.select(
        F.col("key").alias(key), (F.col("p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(pick([bool(x) for x in live]), F.col("w")).alias("whitened"),
        pick([float(x) for x in explained]).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is a long, null where it doesn't fit one; deviation_digits has it in full. For nulls, other lengths, repeats
    and empty tables see whiten."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("deviation", "deviation_digits").withColumn("deviation", F.expr("try_cast(deviation_digits as bigint)"))
