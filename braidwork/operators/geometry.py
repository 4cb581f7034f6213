"""Similarity matrices, spread and principal axes of vector tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions.vectors import cosine, norm


def centred(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(row_id, vector) minus the mean of all rows; the mean is one row of the vector's length."""
    cells = df.select(row_id, F.posexplode(vector).alias("pos", "x"))
    mean = cells.groupBy("pos").agg(F.avg("x").alias("m"))
    whole = mean.agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("l")).select(F.col("l.m").alias("_mean"))
    return df.join(F.broadcast(whole)).select(row_id, F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m).alias(vector))


AT_ONCE = 10_000  # stated rows that travel to all rows together


def block_similarity(df: DataFrame, row_id: str, vector: str, some: DataFrame) -> DataFrame:
    """(a, b, cosine) of a small stated set of rows against all rows; `similarity` takes sets of any size."""
    left = df.join(some.select(row_id), row_id, "left_semi").select(F.col(row_id).alias("a"), F.col(vector).alias("_va"))
    if left.count() > AT_ONCE:
        raise ValueError("the stated set has more than 10,000 rows; use `similarity` instead")
    pairs = df.select(F.col(row_id).alias("b"), F.col(vector).alias("_vb")).join(F.broadcast(left), F.col("a") != F.col("b"))
    return pairs.select("a", "b", cosine(F.col("_va"), F.col("_vb")).alias("cosine"))


def similarity(df: DataFrame, row_id: str, vector: str, some: DataFrame) -> DataFrame:
    """(a, b, cosine) of a stated set of rows against all rows, searched in blocks where it is large."""
    blocks = -(-df.join(some.select(row_id), row_id, "left_semi").count() * 2 // AT_ONCE)  # half full, so that hashing may be uneven
    if blocks <= 2:
        return block_similarity(df, row_id, vector, some)
    parts = [block_similarity(df, row_id, vector, some.where(F.pmod(F.xxhash64(row_id), F.lit(blocks)) == k)) for k in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def diversity(df: DataFrame, row_id: str, vector: str, some: DataFrame) -> DataFrame:
    """V14 of a stated set: its mean cosine, off the diagonal, against all mean-centred rows; `whole_diversity` is that of all rows."""
    return similarity(centred(df, row_id, vector), row_id, vector, some).agg(F.avg("cosine").alias("mean_cosine"), F.count("*").alias("n_pairs"))


def whole_diversity(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """Mean cosine, off the diagonal, of all mean-centred rows, from the sum of their unit vectors.

    An id counts once; rows without a vector, or equal to the mean, have no cosine and form no pairs.
    """
    rows = centred(df.where(F.col(vector).isNotNull()).dropDuplicates([row_id]), row_id, vector)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    units = rows.withColumn("_norm", norm).where("_norm > 0").select(F.posexplode(F.transform(vector, lambda x: x / F.col("_norm"))).alias("pos", "x"))
    sums = units.groupBy("pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    whole = sums.agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    n_pairs = F.col("n") * (F.col("n") - 1)
    return whole.select(F.when(n_pairs > 0, (F.col("s2") - F.col("n")) / n_pairs).alias("mean_cosine"), n_pairs.alias("n_pairs"))


def _sums(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, sum of outer products) of all vectors, added up in Arrow batches; at most width squared numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(0)
            widths = np.asarray(lists.value_lengths().fill_null(0))
            for width in np.unique(widths[widths > 0]).tolist():
                x = lists.take(pa.array(np.flatnonzero(widths == width))).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
                total[width] = total.get(width, 0) + x.T @ x
        for width, gram in total.items():
            i, j = np.indices(gram.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), width)), pa.array(i), pa.array(j), pa.array(gram.ravel())], names=["width", "i", "j", "g"])

    rows = df.where(F.col(vector).isNotNull()).select(vector).mapInArrow(add, "width long, i long, j long, g double").groupBy("width", "i", "j").agg(F.sum("g").alias("g")).toPandas()
    if rows.empty:
        return 0, np.zeros(0), np.zeros((0, 0))
    if rows.width.nunique() > 1:
        raise ValueError("vectors differ in length")
    gram = np.zeros((int(rows.width[0]) + 1,) * 2)
    gram[rows.i, rows.j] = rows.g
    return int(round(gram[0, 0])), gram[0, 1:], gram[1:, 1:]


def principal_axes(df: DataFrame, row_id: str, vector: str, k: int = 2) -> DataFrame:
    """M6: (row_id, axis, position, outlier) on the k widest axes; signs make each axis's largest entry positive.

    outlier is the row's distance from the middle on those axes, over the mean distance. Null vectors
    are left out. One pass adds up sums of products, the driver solves one matrix of the vector's
    width, a second pass projects.
    """
    n, total, gram = _sums(df, vector)
    mean = total / max(1, n)
    spread, axes = np.linalg.eigh(gram - n * np.outer(mean, mean)) if n else (mean, np.zeros((0, 0)))
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1.0, 1.0) if n else axes
    kind = dict(df.dtypes)[row_id]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            at = (x - mean) @ axes
            away = np.sqrt((at * at).sum(axis=1))
            for axis in range(axes.shape[1]):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(batch), axis, np.int32)), pa.array(np.ascontiguousarray(at[:, axis])), pa.array(away)], names=[row_id, "axis", "position", "away"])

    placed = df.where(F.col(vector).isNotNull()).select(row_id, vector).mapInArrow(project, f"{row_id} {kind}, axis int, position double, away double")
    middle = placed.where("axis = 0").agg(F.avg("away").alias("_mean"))
    return placed.join(F.broadcast(middle)).select(row_id, "axis", "position", (F.col("away") / F.col("_mean")).alias("outlier"))  # one row beside each


def distances(df: DataFrame, row_id: str, vector: str, some: DataFrame) -> DataFrame:
    """(a, b, distance): Euclidean distances of a stated set of rows to all rows."""
    pairs = similarity(df, row_id, vector, some)
    lengths = df.select(row_id, norm(F.col(vector)).alias("_l"))
    a, b = (lengths.select(F.col(row_id).alias(x), F.col("_l").alias(f"_{x}")) for x in "ab")
    squared = F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b") - 2 * F.col("_a") * F.col("_b") * F.col("cosine")
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.sqrt(F.greatest(squared, F.lit(0.0))).alias("distance"))


def column_scaled(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(row_id, vector) with every number scaled to [0, 1] by the least and greatest at its position; a constant position gives 0."""
    cells = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = cells.agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("_e"))  # one row of the vector's width
    scaled = F.zip_with(F.col(vector), F.col("_e"), lambda x, e: F.when(e.hi > e.lo, (x.cast("double") - e.lo) / (e.hi - e.lo)).otherwise(F.lit(0.0)))
    return df.join(F.broadcast(ends)).select(row_id, scaled.alias(vector))
