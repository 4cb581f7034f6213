"""Deterministic samples, shuffles and splits (T1-T13, F16, F17). MD5 of seed and id stands in for a random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.ordering import positions


def luck(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """T2"""
    return df.orderBy(luck(seed, key), key)


def sample_rows(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """N rows without replacement; a partial top-n per task, then one of n rows."""
    return shuffled(df, key, seed).limit(n)


def sample_per_group(df: DataFrame, group: Sequence[str], key: str, n: int, seed: str) -> DataFrame:
    """T11, T12"""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(luck(seed, key), key))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


# Up to so many rows in a group, so many are taken; none set means all of them.
TIERS, BEYOND = ((100, None), (500, 200), (1000, 200), (5000, 150)), 50


def tiered_cap(size: Column, tiers: Sequence[tuple[int, int | None]] = TIERS, beyond: int = BEYOND) -> Column:
    """How many rows of a group are taken, by its size."""
    cap = F.lit(beyond)
    for upto, most in reversed(tiers):
        cap = F.when(size <= upto, size if most is None else F.lit(most)).otherwise(cap)
    return cap


def budgeted(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """Rows of each group in hashed order until the group's tier is used up."""
    sizes = df.groupBy(group).agg(tiered_cap(F.count("*")).alias("_cap"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(luck(seed, key), key))
    return df.withColumn("_rn", rank).join(sizes, group).where(F.col("_rn") <= F.col("_cap")).drop("_rn", "_cap")


def two_stage_sample(df: DataFrame, group: Sequence[str], key: str, per_group: int, n: int, seed: str) -> DataFrame:
    """The first few of each group by key, and n of these at random."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(key))
    return sample_rows(df.withColumn("_rn", rank).where(F.col("_rn") <= per_group).drop("_rn"), key, n, seed)


def random_split(df: DataFrame, group: str, key: str, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """80/10/10 inside each group in hashed order."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    placed = positions(df.withColumn("_luck", luck(seed, key)), [group], ["_luck", key], "_at").drop("_luck")
    ranked = placed.join(sizes, group).withColumn("_rn", F.col("_at") + 1).drop("_at")
    label = F.when(F.col("_rn") <= F.floor(F.col("_n") * train), "train").when(F.col("_rn") <= F.floor(F.col("_n") * (train + val)), "val").otherwise("test")
    return ranked.withColumn("split", label).drop("_rn", "_n")


def temporal_split(df: DataFrame, group: str, index: str, key: str, seed: str, share: float = 0.8) -> DataFrame:
    """The first max(1, half-even round(share k)) of a group's k indexes train, the rest test; with one index, rows split at random.

    If nothing is left to test, the last index moves over.
    """
    ranked = df.withColumn("_at", F.dense_rank().over(Window.partitionBy(group).orderBy(index)))
    sizes = df.groupBy(group).agg(F.count_distinct(index).alias("_k"), F.count("*").alias("_n"))
    luckily = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(luck(seed, key), key))).join(sizes, group)
    cut = F.greatest(F.lit(1), F.bround(F.col("_k") * share))
    cut = F.when(cut >= F.col("_k"), F.col("_k") - 1).otherwise(cut)
    by_time = F.when(F.col("_at") <= cut, "train").otherwise("test")
    by_luck = F.when(F.col("_rn") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share)), "train").otherwise("test")
    return luckily.withColumn("split", F.when(F.col("_k") >= 2, by_time).otherwise(by_luck)).drop("_at", "_k", "_n", "_rn")


def draws_with_replacement(groups: DataFrame, rows: DataFrame, group: str, key: str, n_groups: int, per_group: int, batch: int, seed: str) -> DataFrame:
    """N groups in hashed order, per_group draws with replacement from each; a last batch that is not full is dropped."""
    chosen = sample_rows(groups.select(group).distinct(), group, n_groups, seed).withColumn("_g", F.row_number().over(Window.orderBy(luck(seed, group), group)) - 1)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    draws = chosen.join(sizes, group).select(group, "_g", "_n", F.explode(F.sequence(F.lit(0), F.lit(per_group - 1))).alias("_d"))
    draws = draws.withColumn("draw", F.col("_g") * per_group + F.col("_d")).withColumn("_at", F.pmod(F.conv(F.substring(luck(seed, group, "_d"), 1, 8), 16, 10).cast("long"), "_n"))
    numbered = rows.select(group, key).withColumn("_at", (F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1).cast("long"))
    full = n_groups * per_group // batch * batch
    return draws.join(numbered, [group, "_at"]).where(F.col("draw") < full).select(group, key, "draw", F.floor(F.col("draw") / batch).alias("batch"))


def round_robin_shard(df: DataFrame, key: str, n: int, i: int) -> DataFrame:
    """every n-th distinct key in sorted order, from the i-th; keys are ranked in range partitions, not in one task."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    from braidwork.session import cut_lineage

    keys = cut_lineage(keys)
    starts = keys.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = keys.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1).join(F.broadcast(starts), "_p")  # a row per partition
    mine = ranked.where((F.col("_from") + F.col("_r")) % n == i).select(key)
    return df.join(mine, key, "left_semi")


def groups_of_size(df: DataFrame, group: str, least: int) -> DataFrame:
    """F16"""
    big = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group)
    return df.join(big, group, "left_semi")
