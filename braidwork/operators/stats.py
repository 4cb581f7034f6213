"""Distributions, weighted and bucketed means, fits and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = (10, 25, 75, 90, 95, 99)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A1, T3"""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))


def distribution(x: Column, percents: Sequence[int] = PERCENTS) -> list[Column]:
    """A2, A3: n, extremes, mean, median, population deviation and linear percentiles; nulls and NaN do not count."""
    v = F.when(~F.isnan(x.cast("double")), x.cast("double"))
    return [
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"),
        *(F.percentile(v, p / 100.0).alias(f"p{p}") for p in percents),
    ]


def floor_percentile(df: DataFrame, group: str, value: str, percents: Sequence[int]) -> DataFrame:
    """A4: the value at rank min(floor(n p / 100), n - 1), without gathering a group.

    Runs over (group, value) counts: a running total tells where each value's ranks end.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    ends = counts.withColumn("end", F.sum("k").over(Window.partitionBy(group).orderBy(value)))
    ends = ends.join(counts.groupBy(group).agg(F.sum("k").alias("n")), group)
    rank = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return ends.groupBy(group).agg(*(F.min(F.when(F.col("end") > rank(p), F.col(value))).alias(f"p{p}") for p in percents))


def weighted_mean(value: str, weight: str) -> Column:
    """0 where there is no weight."""
    return F.coalesce(F.sum(F.col(weight) * F.col(value)) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0)), F.lit(0.0))


def bucket_label(x: Column, edges: Sequence[tuple[int, str]]) -> Column:
    """The label of the last edge that is not above x; the first label below all edges."""
    label = F.lit(edges[0][1])
    for start, name in edges:
        label = F.when(x >= start, F.lit(name)).otherwise(label)
    return label


def bucket_means(df: DataFrame, x: str, edges: Sequence[tuple[int, str]], values: Sequence[str], weight: str, entity: str) -> DataFrame:
    """Weighted means per bucket, empty buckets left out."""
    return df.groupBy(bucket_label(F.col(x), edges).alias("bucket")).agg(F.sum(weight).alias("n_pairs"), F.count("*").alias("n_rows"), F.count_distinct(entity).alias("n_repos"), *(weighted_mean(v, weight).alias(v) for v in values))


def closed_bins(df: DataFrame, x: str, edges: Sequence[float], values: Sequence[str], weight: str, entity: str) -> DataFrame:
    """Bins [lo, hi), the last one closed; empty bins come out with nulls, rows outside all bins are left out."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    v = F.col(x)
    at = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (v >= a) & ((v <= b) if i == len(edges) - 2 else (v < b))
        at = F.when(at.isNull() & inside, F.lit(i)).otherwise(at)
    sums = df.withColumn("bin", at).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n_rows"), F.sum(weight).alias("n_assertions"), F.count_distinct(entity).alias("n_repos"), *((F.sum(F.col(c) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias(c) for c in values))
    return bins.join(sums, "bin", "left").select("lo", "hi", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_assertions", "n_repos")), *values)


def linear_fit(x: str, y: str) -> list[Column]:
    """Slope and intercept; a constant x gives (0, mean of y)."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(pair, F.col(x).cast("double")), F.when(pair, F.col(y).cast("double"))
    flat = F.coalesce(F.var_pop(px), F.lit(0.0)) == 0
    return [F.when(flat, 0.0).otherwise(F.regr_slope(py, px)).alias("slope"), F.when(flat, F.avg(py)).otherwise(F.regr_intercept(py, px)).alias("intercept")]


def log_fit(x: str, y: str) -> list[Column]:
    """y = a ln x + b over x > 0, with R squared."""
    lx = F.when(F.col(x) > 0, F.log(F.col(x).cast("double")))
    return [F.regr_slope(F.col(y), lx).alias("a"), F.regr_intercept(F.col(y), lx).alias("b"), F.regr_r2(F.col(y), lx).alias("r2")]


def _resampled(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(g, resample, s, w, n) of rows (g, h, s, w, k): k equal clusters each, with sum s and weight w; resample -1 holds the plain totals.

    In a resample a cluster is drawn a Poisson number of times, which k of them together are drawn
    Poisson(k) times; the numbers come from the hash h, so a task adds up its own rows and only
    resamples x (sum, weight) are shuffled, whatever the number of rows in a group.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for frame in frames:
            for g, part in frame.groupby("g", sort=False):
                s, w, n = total.get(g, (np.zeros(resamples), np.zeros(resamples), np.zeros(3)))
                for h, a, b, k in zip(part.h, part.s, part.w, part.k, strict=True):
                    times = np.random.default_rng([seed, int(h) & ((1 << 63) - 1)]).poisson(float(k), resamples)
                    s, w = s + times * a, w + times * b
                total[g] = (s, w, n + np.array([(part.s * part.k).sum(), (part.w * part.k).sum(), part.k.sum()]))
        for g, (s, w, n) in total.items():
            yield pd.DataFrame({"g": g, "resample": np.arange(-1, resamples), "s": np.concatenate(([n[0]], s)), "w": np.concatenate(([n[1]], w)), "n": int(n[2])})

    kind = dict(rows.dtypes)["g"]
    parts = rows.select("g", "h", "s", "w", "k").mapInPandas(partial, f"g {kind}, resample int, s double, w double, n long")
    return parts.groupBy("g", "resample").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.sum("n").alias("n"))


def bootstrap_interval(df: DataFrame, group: str, value: str, resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of the mean, (group, mean, low, high, n, flag); null groups are left out.

    Equal values are counted first, so a metric of few values is a few rows; one of many values is
    added up where its rows are. n = 0 gives zeros and the flag 'empty'; no resamples give the mean.
    """
    v = F.col(value).cast("double")
    good = df.where(F.col(group).isNotNull())
    counts = good.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.col(group).alias("g"), v.alias("s")).agg(F.count("*").alias("k"))
    rows = counts.withColumn("w", F.lit(1.0)).withColumn("h", F.xxhash64("g", "s"))
    mean = F.when(F.col("w") > 0, F.col("s") / F.col("w"))
    drawn = F.when(F.col("resample") >= 0, mean)
    tail = (1 - level) / 2
    plain = F.max(F.when(F.col("resample") == -1, mean))
    found = _resampled(rows, resamples, seed).groupBy("g").agg(plain.alias("mean"), F.coalesce(F.percentile(drawn, tail), plain).alias("low"), F.coalesce(F.percentile(drawn, 1 - tail), plain).alias("high"), F.max(F.when(F.col("resample") == -1, F.col("n"))).alias("n"))
    every = good.select(F.col(group).alias("g")).distinct().join(found, "g", "left")
    return every.select(F.col("g").alias(group), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "low", "high")), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "empty").otherwise("").alias("flag"))


def bootstrap_intervals(df: DataFrame, group: str, values: Sequence[str], resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Intervals of several metrics, (group, metric, mean, low, high, n, flag); the i-th metric draws with seed + i."""
    parts = [bootstrap_interval(df, group, v, resamples, level, seed + i).select(group, F.lit(v).alias("metric"), "mean", "low", "high", "n", "flag") for i, v in enumerate(values)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def merged_intervals(shards: Sequence[DataFrame], group: str, values: Sequence[str], resamples: int = 1000, seed: int = 0) -> DataFrame:
    """Raw samples of several shards put together, and their intervals computed anew."""
    rows = shards[0].select(group, *values)
    for shard in shards[1:]:
        rows = rows.unionByName(shard.select(group, *values))
    return bootstrap_intervals(rows, group, values, resamples, seed=seed)


def cluster_bootstrap(df: DataFrame, method: str, cluster: str, value: str, weight: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """Interval of a weighted mean with whole clusters drawn, (method, mean, low, high, n_clusters)."""
    sums = df.groupBy(F.col(method).alias("g"), F.col(cluster).alias("_c")).agg(F.sum(F.col(weight) * F.col(value)).cast("double").alias("s"), F.sum(weight).cast("double").alias("w"))
    rows = sums.where("g is not null").withColumn("h", F.xxhash64("_c")).withColumn("k", F.lit(1))
    mean = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0)
    return _resampled(rows, resamples, seed).groupBy(F.col("g").alias(method)).agg(
        F.max(F.when(F.col("resample") == -1, mean)).alias("mean"),
        F.percentile(F.when(F.col("resample") >= 0, mean), 0.025).alias("low"),
        F.percentile(F.when(F.col("resample") >= 0, mean), 0.975).alias("high"),
        F.max(F.when(F.col("resample") == -1, F.col("n"))).alias("n_clusters"),
    )


def power_fit(x: str, y: str) -> list[Column]:
    """100 - y = c x^alpha over x > 0 and y < 100, with R squared of the logarithms."""
    fits = (F.col(x) > 0) & (F.col(y) < 100)
    lx, ly = F.when(fits, F.log(F.col(x).cast("double"))), F.when(fits, F.log(100.0 - F.col(y)))
    return [F.exp(F.regr_intercept(ly, lx)).alias("c"), F.regr_slope(ly, lx).alias("alpha"), F.regr_r2(ly, lx).alias("r2")]


def extrapolated(count: str, total: str, seen: str) -> Column:
    """What a counter over `seen` rows of `total` comes to over all of them; 0 if none was seen."""
    return F.when(F.col(seen) > 0, F.round(F.col(count) * F.col(total) / F.col(seen))).otherwise(0).cast("long")


def column_report(df: DataFrame, numbers: Sequence[str], labels: Sequence[str], most: int = 10) -> DataFrame:
    """A5: (column, stat, value): distribution of each number, and the most frequent values of each label with their counts."""
    parts = []
    for name in numbers:
        wide = df.agg(*distribution(F.col(name), (25, 75)))
        parts.append(wide.select(F.lit(name).alias("column"), F.explode(F.map_from_arrays(F.array(*map(F.lit, wide.columns)), F.array(*(F.col(c).cast("double") for c in wide.columns)))).alias("stat", "value")))
    for name in labels:
        top = value_counts(df.where(F.col(name).isNotNull()), name).limit(most)
        parts.append(top.select(F.lit(name).alias("column"), F.col(name).cast("string").alias("stat"), F.col("n").cast("double").alias("value")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def cap_grid(df: DataFrame, commit: Sequence[str], file: str, caps: Sequence[int]) -> DataFrame:
    """A10: how many rows are left under each cap per commit, per file, and per file then per commit (twice the cap).

    How many are left does not depend on which rows a cap keeps, so the first is also that of a random choice.
    """
    spark = df.sparkSession
    grid = F.broadcast(spark.createDataFrame([(k,) for k in caps], "cap int"))  # as many rows as caps were asked for
    per_file = df.groupBy(*commit, file).agg(F.count("*").alias("n"))
    files = per_file.crossJoin(grid).groupBy(*commit, "cap").agg(F.sum("n").alias("n"), F.sum(F.least("n", "cap")).alias("by_file"))
    return files.groupBy("cap").agg(F.sum(F.least("n", "cap")).alias("kept_per_commit"), F.sum("by_file").alias("kept_per_file"), F.sum(F.least(F.col("by_file"), F.col("cap") * 2)).alias("kept_both"))
