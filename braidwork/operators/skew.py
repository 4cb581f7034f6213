"""Per-key results when a few keys hold most rows (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_value_states(df: DataFrame, key: str, row_id: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(states, names): one compact state per (key hash, value), how many distinct rows carry the value; and the key behind each hash.

    Redelivered rows share row_id and all values; they are folded by a hash aggregate keyed by the
    row id, which spreads a hot key over all tasks. Its buffers are numbers only, so it runs in
    bounded hash tables that spill and combines map-side, as does the second aggregate: only one row
    per (key, value) and map task is shuffled. Null keys form a group of their own; rows without an
    id are left out. The value is a whole number.
    """
    rows = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("_id"), F.when(F.col(key).isNotNull(), F.xxhash64(key)).alias("_k"), F.col(value).cast("long").alias("_v"))
    once = rows.groupBy("_id").agg(F.max("_k").alias("_k"), F.max("_v").alias("_v"))
    names = df.where(F.col(row_id).isNotNull()).select(F.when(F.col(key).isNotNull(), F.xxhash64(key)).alias("_k"), key).distinct()
    return once.groupBy("_k", "_v").agg(F.count("*").alias("_n")), names


def balanced_key_summary(df: DataFrame, key: str = "repo_id", row_id: str = "commit_sha", value: str = "n_new_assertions") -> DataFrame:
    """Distinct rows, sum and exact median of value per key, without a task owning a hot key.

    Null values count as rows but enter neither sum nor median; a key with only null values
    has a null sum and median. An empty table gives an empty result. The median is taken over
    counts of distinct values, of which a key of small whole numbers has few.
    """
    states, names = distinct_value_states(df, key, row_id, value)
    found = states.groupBy("_k").agg(F.sum("_n").alias("n_commits"), F.sum(F.col("_v") * F.col("_n")).alias("sum_value"), F.expr("percentile(_v, 0.5D, _n)").alias("median_value"))
    return names.withColumnRenamed("_k", "_name").join(found, F.col("_k").eqNullSafe(F.col("_name"))).select(key, "n_commits", "sum_value", "median_value")


def heavy_keys(df: DataFrame, key: str = "repo_id", row_id: str = "commit_sha", share: float = 0.04) -> DataFrame:
    """Keys holding at least `share` of the distinct rows, by the states of `distinct_value_states`; the total is a scalar subquery."""
    states, names = distinct_value_states(df.withColumn("_one", F.lit(0)), key, row_id, "_one")
    heavy = states.agg(F.sum("_n").alias("_total")).select((F.col("_total") * F.lit(share)).alias("_least"))
    found = states.where((F.col("_n") >= heavy.scalar()) & F.col("_k").isNotNull())
    return names.join(found, "_k").select(key)
