"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_windows(ids: Column, size: int, overlap: int, least: int = 16) -> Column:
    """V1-V3: overlapping windows; those shorter than `least` are dropped, and nothing follows the one that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    step = size - overlap
    n = F.size(ids)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: F.slice(ids, s + 1, size)), lambda w: F.size(w) >= least)


def dot(a: Column, b: Column) -> Column:
    """V9, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero or lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def unit(a: Column) -> Column:
    """V8"""
    size = norm(a) + F.lit(1e-12)
    return F.transform(a, lambda x: x.cast("double") / size)


def is_finite(a: Column, dimension: int | None = None) -> Column:
    """Not null, of the wanted length, every number finite."""
    good = a.isNotNull() & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.size(a) == dimension) if dimension else good, F.lit(False))


def or_zeros(a: Column, dimension: int) -> Column:
    """Zeros for a missing or empty vector."""
    return F.when(F.size(F.coalesce(a, F.array().cast("array<float>"))) > 0, a).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dimension))


def step_input(diff: Column, state: Column, mode: str) -> Column:
    """Diff, repo_state or both."""
    return {"diff": diff, "repo_state": state, "concat": F.concat(diff, state)}[mode]


def pooled(df: DataFrame, group: str, vector: str, how: str = "mean") -> DataFrame:
    """V4, V5: mean, max, max_mean or mean_max of a group's vectors, as (group, pooled).

    Numbers are pooled per (group, position), so partial sums combine map-side and no group is
    gathered; null vectors are left out.
    """
    cells = df.select(group, F.posexplode(vector).alias("pos", "x"))
    cells = cells.groupBy(group, "pos").agg(F.avg("x").alias("mean"), F.max("x").cast("double").alias("max"))
    rows = cells.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "max"))).alias("c"))
    shapes = {"mean": [F.col("c.mean")], "max": [F.col("c.max")], "max_mean": [F.col("c.max"), F.col("c.mean")], "mean_max": [F.col("c.mean"), F.col("c.max")]}
    return rows.select(group, F.concat(*shapes[how]).alias("pooled"))


def scaled_01(x: Column, low: Column, high: Column) -> Column:
    """M1: to [0, 1]; a constant becomes 1."""
    return F.when(high == low, F.lit(1.0)).otherwise((x - low) / (high - low + 1e-8))


# File names that say little about a repository, and places that say much.
PATHS_DOWN = r"(^|/)(__init__\.py|setup\.py|conf\.py|version\.py|constants?\.py|typing.*\.py)$"
PATHS_UP = r"(^|/)(src/|core/|lib/)"


def path_bonus(path: Column) -> Column:
    """M3: first the names that count less, then the places that count more; each once."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.when(low.rlike(PATHS_DOWN), -0.25).otherwise(0.0) + F.when(low.rlike(PATHS_UP), 0.15).otherwise(0.0)


def depth_bonus(path: Column) -> Column:
    """M3: paths near the root count more."""
    depth = F.size(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != ""))
    return F.when(depth == 0, 0.2).when(depth == 1, 0.1).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    """M5"""
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def log_sized(x: Column, low: Column, high: Column) -> Column:
    """M4: 5 to 100 by ln(1 + x) between a group's least and greatest x; 50 where all are equal, 8 where none is above 0."""
    at, lo, hi = (F.log1p(F.greatest(v, F.lit(0)).cast("double")) for v in (x, low, high))
    return F.when(hi <= 0, 8.0).when(hi <= lo, 50.0).otherwise(5.0 + 95.0 * (at - lo) / (hi - lo + 1e-9))


def root_sized(x: Column, low: Column, high: Column) -> Column:
    """M4: 15 to 135 by the root of x between the least and greatest positive x; 40 where these are equal, 6 where x is not above 0."""
    at, lo, hi = (F.sqrt(v.cast("double")) for v in (x, low, high))
    return F.when(F.coalesce(x, F.lit(0)) <= 0, 6.0).when(hi <= lo, 40.0).otherwise(15.0 + 120.0 * (at - lo) / (hi - lo + 1e-9))


def file_scores(distinct: Column, size: Column, path: Column, n_lines: Column, a_distinct: float = 1.0, b_size: float = 0.3, full_lines: int = 20) -> Column:
    """V7: distinctiveness and size (both 0 to 1), what path and depth add, and a penalty for files of few lines."""
    tiny = F.log(F.least(F.greatest(n_lines, F.lit(1)) / F.lit(float(full_lines)), F.lit(1.0)) + 1e-6)
    return F.lit(a_distinct) * distinct + F.lit(b_size) * size + path_bonus(path) + depth_bonus(path) + 0.15 * tiny


def weighted_pool(df: DataFrame, group: str, vector: str, weight: str, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """V6: (group, pooled): alpha times the weighted mean beside beta times the maximum; weights of a group add up to 1."""
    cells = df.select(group, F.col(weight).alias("_w"), F.posexplode(vector).alias("pos", "x"))
    cells = cells.groupBy(group, "pos").agg((F.sum(F.col("x") * F.col("_w")) * alpha).alias("mean"), (F.max("x").cast("double") * beta).alias("max"))
    rows = cells.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "max"))).alias("c"))
    return rows.select(group, F.concat("c.mean", "c.max").alias("pooled"))


def softmax_weights(df: DataFrame, group: str, score: str, tau: float, out: str = "weight") -> DataFrame:
    """M2: per group, against its maximum; two aggregates and a join, no window over a group."""
    top = df.groupBy(group).agg(F.max(score).alias("_top"))
    rows = df.join(top, group).withColumn("_e", F.exp((F.col(score) - F.col("_top")) / max(tau, 1e-6)))
    total = rows.groupBy(group).agg(F.sum("_e").alias("_sum"))
    return rows.join(total, group).withColumn(out, F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")
