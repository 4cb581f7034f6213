"""Positions inside groups without a task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import stored


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    met = F.lit(True)
    for name in names:
        met = met & left[name].eqNullSafe(right[name])
    return met


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """df with each row's position, from 0, in its group by `order`; null groups are a group of their own.

    Rows are cut into ranges of (group, order), so that a hot group is spread over many tasks and is
    ranked range by range; how many rows of a group lie in earlier ranges is added from counts, of
    which there are no more than groups and ranges together. Only rows that tie in every column of
    `order` stay together; let the order end with a unique column.
    """
    ranged = stored(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "positions")
    counts = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)) - 1)
    found = ranked.join(before, (ranked["_part"] == before["_part"]) & _same(ranked, before, group))
    return found.select(*(ranked[c] for c in df.columns), (ranked["_r"] + before["_before"]).cast("long").alias(out))


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], row_id: str, offset: int = 1, out: str = "previous") -> DataFrame:
    """(row_id, out): the row `offset` places before each row of its group; rows without one are left out."""
    placed = positions(df.select(*group, *order, row_id) if row_id not in order else df.select(*group, *order), group, order)
    ahead = placed.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), (F.col("position") + offset).alias("_at"), F.col(row_id).alias(out))
    met = placed["position"] == ahead["_at"]
    for i, c in enumerate(group):
        met = met & placed[c].eqNullSafe(ahead[f"_g{i}"])
    return placed.join(ahead, met).select(placed[row_id], out)


def running_totals(df: DataFrame, order: str, size: str, out: str = "_from") -> DataFrame:
    """df with the sum of `size` over all rows before each, by `order`; rows are added up range by range, ranges by their totals."""
    ranged = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "running-totals")
    totals = ranged.groupBy("_part").agg(F.sum(size).alias("_t"))  # a row per range
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_inside", inside).join(before, "_part").withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_before", "_inside")


def arranged(df: DataFrame, group: Sequence[str], how: str, index: str, name: str, seed: str = "0") -> DataFrame:
    """Df with each row's position in its group: chronological or reverse by index, alphabetical by name, or random by a hash of seed and both."""
    from braidwork.operators.sampling import luck

    key = {"chronological": F.col(index), "reverse": -F.col(index), "alphabetical": F.lit(0), "random": luck(seed, index, name)}[how]
    placed = positions(df.withColumn("_key", key), group, ["_key", name, index])
    return placed.drop("_key")


def sequences(commits: DataFrame, questions: DataFrame, group: str, order: Sequence[str], least: int, most_groups: int | None, seed: str = "0", **conditions: object) -> DataFrame:
    """Commits that meet equality conditions, of groups with at least `least` of them, of the first `most_groups` groups in hashed order, each with its position and the number of its questions.

    Questions themselves are fetched when they are used; `order` starts with the columns that questions share with commits.
    """
    from braidwork.operators.sampling import groups_of_size, luck
    from braidwork.schema import equality_filter

    rows = groups_of_size(commits.where(equality_filter(**conditions)), group, least)
    if most_groups is not None:
        rows = rows.join(rows.select(group).distinct().orderBy(luck(seed, group), group).limit(most_groups), group, "left_semi")
    asked = questions.groupBy(group, order[0]).agg(F.count("*").alias("n_questions"))
    return positions(rows, [group], order).join(asked, [group, order[0]], "left").withColumn("n_questions", F.coalesce("n_questions", F.lit(0)))
