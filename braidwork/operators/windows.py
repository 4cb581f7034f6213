"""Ordered operators per group: splits, anchors, de-duplication, caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.ordering import positions


def split_sizes(n: Column) -> tuple[Column, Column]:
    """Train and validation sizes of the chronological 80/10/10 split of n rows."""
    train = F.greatest(F.lit(1), F.floor(n * F.lit(0.8)))
    val = F.greatest(F.lit(1), F.floor(n * F.lit(0.1)))
    train = F.when(train + val >= n, F.greatest(F.lit(1), train - 1)).otherwise(train)
    return train, val


def chronological_split(df: DataFrame, group: str, order: Sequence[str], out: str = "split") -> DataFrame:
    """Label rows train/val/test by position in their group; groups under 3 rows are all train (W1, W2). Rows without a group are left out."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = positions(df, [group], order, "_at").join(sizes, group).withColumn("_rn", (F.col("_at") + 1).cast("int")).drop("_at")
    train, val = split_sizes(F.col("_n"))
    label = F.when(F.col("_n") < 3, "train").when(F.col("_rn") <= train, "train").when(F.col("_rn") <= train + val, "val").otherwise("test")
    return ranked.withColumn(out, label).withColumn("commit_index", F.col("_rn") - 1).drop("_rn", "_n")


def with_previous(df: DataFrame, group: str, order: Sequence[str], column: str, out: str = "previous") -> DataFrame:
    """The value of the row before in the group; null for the first. A group is sorted in one task; `ordering.neighbours` spreads hot ones."""
    return df.withColumn(out, F.lag(column).over(Window.partitionBy(group).orderBy(*order)))


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One whole row per group, the first in the given order; give ties an id to end on."""
    return head_per_group(df, group, order, 1)


def head_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows per group; the limit is pushed below the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def anchors(df: DataFrame, group: str, index: str, condition: Column, latest: bool = True, value: str = "commit_sha") -> DataFrame:
    """Per group the last (or first) row that meets the condition, by one aggregate.

    Equal indexes are settled by the value, so the result does not depend on row order.
    """
    pick = F.max if latest else F.min
    best = df.where(condition).groupBy(group).agg(pick(F.struct(F.coalesce(index, F.lit(-1)).alias("i"), F.col(value).alias("v"))).alias("a"))
    return best.select(group, F.col("a.v").alias("anchor_value"), F.col("a.i").alias("anchor_index"))


def distance_from_anchor(df: DataFrame, anchor: DataFrame, group: str, index: str) -> DataFrame:
    """Rows beside their group's anchor; without one the anchor is '' at -1."""
    joined = df.join(anchor, group, "left").withColumn("anchor_value", F.coalesce("anchor_value", F.lit(""))).withColumn("anchor_index", F.coalesce("anchor_index", F.lit(-1)))
    return joined.withColumn("n_after_anchor", F.col(index) - F.col("anchor_index"))


def normalised_position(df: DataFrame, group: str, index: str) -> DataFrame:
    """(index - least) / max(greatest - least, 1) and the distance from the first."""
    ends = df.groupBy(group).agg(F.min(index).alias("_lo"), F.max(index).alias("_hi"))
    near = F.col(index) - F.col("_lo")
    return df.join(ends, group).withColumn("position", near / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))).withColumn("n_after_first", near).drop("_lo", "_hi")


def percentile_positions(df: DataFrame, group: str, order: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """The rows at round-half-even(p/100 (n-1)) of each group, each once."""
    ranked = positions(df, [group], order, "_at")
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    wanted = F.array(*(F.bround(F.lit(p / 100.0) * (F.col("_n") - 1)).cast("int") for p in percents))
    return ranked.join(sizes, group).where(F.array_contains(wanted, F.col("_at").cast("int"))).drop("_at", "_n")


def uniform_positions(df: DataFrame, group: str, order: Sequence[str], most: int) -> DataFrame:
    """At most `most` evenly spaced rows per group, first and last among them.

    The positions are 0, the last, and floor(i n / most) in order until there are enough.
    """
    ranked = positions(df, [group], order, "_at")
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * F.greatest(F.lit(1.0), F.col("_n") / F.lit(most))).cast("int"))
    some = F.slice(F.array_distinct(F.concat(F.array(F.lit(0), (F.col("_n") - 1).cast("int")), spread)), 1, most)
    keep = (F.col("_n") <= most) | F.array_contains(some, F.col("_at").cast("int"))
    return ranked.join(sizes, group).where(keep).drop("_at", "_n")


def position_split(df: DataFrame, group: str, order: Sequence[str], k: int) -> DataFrame:
    """The first k rows of a group evaluate, the rest train."""
    placed = positions(df, [group], order, "group_index")
    return placed.withColumn("group_index", F.col("group_index").cast("int")).withColumn("role", F.when(F.col("group_index") < k, "eval").otherwise("train"))


def interleave(df: DataFrame, group: Sequence[str], lane: str, order: Sequence[Column | str], k: int) -> DataFrame:
    """K rows per group, taking one from each lane in turn."""
    turn = F.row_number().over(Window.partitionBy(*group, lane).orderBy(*order))
    return head_per_group(df.withColumn("_turn", turn), group, ["_turn", lane, *order], k).drop("_turn")


def smart_cap(df: DataFrame, commit: Sequence[str], file: str, function: str, row_id: str, per_file: int = 4, per_commit: int = 8, seed: str = "1234") -> DataFrame:
    """At most per_file rows of a file, its functions in turn, and per_commit of a commit, its files in turn.

    MD5 of seed and id stands in for a random order, so that the choice is the same on every run.
    Null files and functions are lanes of their own.
    """
    luck = lambda *c: F.md5(F.concat_ws("|", F.lit(seed), *c))
    rows = df.withColumn("_f", F.coalesce(file, F.lit(""))).withColumn("_g", F.coalesce(function, F.lit("")))
    rows = rows.withColumn("_r", luck(F.col(row_id).cast("string"))).withColumn("_fk", luck("_f")).withColumn("_gk", luck("_f", "_g"))
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*commit, "_f", "_g").orderBy("_r", row_id)))
    rows = rows.withColumn("_in_file", F.row_number().over(Window.partitionBy(*commit, "_f").orderBy("_turn", "_gk", "_g", "_r", row_id))).where(F.col("_in_file") <= per_file)
    rows = rows.withColumn("_in_commit", F.row_number().over(Window.partitionBy(*commit).orderBy("_in_file", "_fk", "_f", "_r", row_id))).where(F.col("_in_commit") <= per_commit)
    return rows.drop("_f", "_g", "_r", "_fk", "_gk", "_turn", "_in_file", "_in_commit")


def capped_train(df: DataFrame, is_train: Column, **cap) -> DataFrame:
    """Training rows capped, all others passed through."""
    return smart_cap(df.where(is_train), **cap).unionByName(df.where(~is_train))


def proportional_slots(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, n, slots): largest-remainder shares of `total`; all rows if there are no more than that.

    Equal remainders are settled by the stratum's name. Strata are few, so the ranking over them is small.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    everything = sizes.agg(F.sum("n").alias("_all"))
    exact = F.lit(total) * F.col("n") / F.col("_all")
    shares = sizes.join(F.broadcast(everything)).withColumn("_floor", F.floor(exact)).withColumn("_part", exact - F.col("_floor"))
    given = shares.agg(F.sum("_floor").alias("_given"))
    ranked = shares.join(F.broadcast(given)).withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("_part"), stratum)))
    slots = F.col("_floor") + F.when(F.col("_rn") <= F.lit(total) - F.col("_given"), 1).otherwise(0)
    return ranked.select(stratum, "n", F.when(F.col("_all") <= total, F.col("n")).otherwise(F.least(slots, F.col("n"))).alias("slots"))


def stratified_sample(df: DataFrame, stratum: str, total: int, order: Sequence[Column | str]) -> DataFrame:
    """Each stratum's first rows in the given order, as many as it has slots."""
    slots = proportional_slots(df, stratum, total).select(stratum, "slots")
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.join(F.broadcast(slots), stratum).where(F.col("_rn") <= F.col("slots")).drop("_rn", "slots")


def first_seen(df: DataFrame, key: Sequence[str], index: str, out: str = "first_index") -> DataFrame:
    """W23"""
    return df.groupBy(*key).agg(F.min(index).alias(out))


def preamble(df: DataFrame, group: str, order: Sequence[str], share: float = 0.1) -> DataFrame:
    """The first max(1, floor(share n)) rows of each group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    ranked = positions(df, [group], order, "_at").join(sizes, group)
    return ranked.where(F.col("_at") < F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))).drop("_at", "_n")


def new_keys(df: DataFrame, group: Sequence[str], order: Sequence[str], keys: str) -> DataFrame:
    """W4 without renames: the keys of a version that the version before did not have."""
    before = F.coalesce(F.lag(keys).over(Window.partitionBy(*group).orderBy(*order)), F.array().cast("array<string>"))
    return df.withColumn("new_keys", F.array_except(keys, before))


def running_total(df: DataFrame, group: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """The total up to and with the present row; ties count together."""
    upto = Window.partitionBy(group).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(upto))
