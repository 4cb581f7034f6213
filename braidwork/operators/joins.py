"""Joins with miss accounting, as-of and range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.vectors import or_zeros


def left_or_zeros(rows: DataFrame, vectors: dict[str, DataFrame], on: Sequence[str], dimension: int) -> DataFrame:
    """Rows beside vectors (column name -> table with the keys and that column); misses become zeros, hit_<name> tells."""
    for name, side in vectors.items():
        rows = rows.join(side.select(*on, name), list(on), "left").withColumn(f"hit_{name}", F.col(name).isNotNull().cast("int")).withColumn(name, or_zeros(F.col(name), dimension))
    return rows


def inner_with_misses(rows: DataFrame, sides: dict[str, DataFrame], on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that every side knows, and one row of counts: all rows and those first missed by each side, in order."""
    known = rows
    for name, side in sides.items():
        known = known.join(side.select(*on).distinct().withColumn(f"_has_{name}", F.lit(True)), list(on), "left")
    counts, before = [F.count("*").alias("n_rows")], F.lit(True)
    for name in sides:
        here = F.col(f"_has_{name}").isNotNull()
        counts.append(F.coalesce(F.sum((before & ~here).cast("long")), F.lit(0)).alias(f"missed_{name}"))
        before = before & here
    found = known.where(before).drop(*(f"_has_{n}" for n in sides))
    return found, known.agg(*counts)


def missing_keys(rows: DataFrame, side: DataFrame, on: Sequence[str]) -> DataFrame:
    """J13, J15, J16"""
    return rows.join(side.select(*on), list(on), "left_anti")


def known_keys(rows: DataFrame, side: DataFrame, on: Sequence[str]) -> DataFrame:
    """J14, S16, J28"""
    return rows.join(side.select(*on), list(on), "left_semi")


def cumulative_at(points: DataFrame, rows: DataFrame, group: str, index: str, mode: str = "cumulative") -> DataFrame:
    """How many rows each point sees: those up to its index, or (mode new) at it.

    Counts per (group, index) are put on one time line with the points and added up by a window;
    no range join pairs each point with each row.
    """
    counts = rows.groupBy(group, index).agg(F.count("*").alias("k"))
    if mode == "new":
        return points.join(counts, [group, index], "left").withColumn("n_seen", F.coalesce("k", F.lit(0))).drop("k")
    line = points.select(group, index).distinct().join(counts, [group, index], "full").withColumn("k", F.coalesce("k", F.lit(0)))
    total = line.withColumn("n_seen", F.sum("k").over(Window.partitionBy(group).orderBy(index))).drop("k")
    return points.join(total, [group, index])


def asof_forward(left: DataFrame, right: DataFrame, group: str, at: str, value: str, out: str = "matched") -> DataFrame:
    """For each left row the first right value at or after it, else the group's last one; null if the group has none.

    Both sides go on one time line, on which the next right value is looked up by a window.
    """
    marks = right.select(group, F.col(at).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    keys = left.select(group, F.col(at).alias("_at")).distinct().withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_side", F.lit(1))
    line = marks.unionByName(keys)
    ahead = Window.partitionBy(group).orderBy(F.desc("_at"), F.asc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nxt = F.last("_v", ignorenulls=True).over(ahead)
    found = line.withColumn("_next", nxt).where("_side = 1").select(group, F.col("_at").alias(at), F.col("_next"))
    last = right.groupBy(group).agg(F.max_by(value, at).alias("_last"))
    return left.join(found, [group, at], "left").join(last, group, "left").withColumn(out, F.coalesce("_next", "_last")).drop("_next", "_last")


def pick_by_priority(rows: DataFrame, key: str, options: Sequence[tuple[DataFrame, Column]], out: str) -> DataFrame:
    """The value of the first table that knows the key; options are (table with key and value column named `out`, lookup expression on rows)."""
    found = []
    for n, (side, lookup) in enumerate(options):
        name = f"_{out}_{n}"
        rows = rows.withColumn("_k", lookup).join(side.select(F.col(key).alias("_k"), F.col(out).alias(name)), "_k", "left").drop("_k")
        found.append(name)
    return rows.withColumn(out, F.coalesce(*found)).drop(*found)


def wins_alone(scores: DataFrame, keys: Sequence[str], method: str, hit: str, winners: Sequence[str], losers: Sequence[str]) -> DataFrame:
    """Keys that all winners got right and that all losers were scored on and got wrong."""
    flags = [F.max(F.when(F.col(method) == m, F.col(hit).cast("int"))).alias(f"m{i}") for i, m in enumerate([*winners, *losers])]
    wide = scores.where(F.col(method).isin(*winners, *losers)).groupBy(*keys).agg(*flags)
    for i in range(len(winners) + len(losers)):
        wide = wide.where(F.col(f"m{i}") == (1 if i < len(winners) else 0))
    return wide.select(*keys)


def in_all(scores: DataFrame, keys: Sequence[str], method: str, n_methods: int) -> DataFrame:
    """Keys that every one of n methods scored."""
    return scores.groupBy(*keys).agg(F.count_distinct(method).alias("n")).where(F.col("n") == n_methods).select(*keys)


def positional(groups: DataFrame, arrays: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Parallel arrays as rows with their position; shorter arrays give nulls."""
    zipped = groups.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("position", "z"))
    return zipped.select(*keys, "position", *(F.col(f"z.{a}").alias(a) for a in arrays))


def by_running_offset(groups: DataFrame, scores: DataFrame, order: str, size: str, score: str, at: str) -> DataFrame:
    """Groups, each of `size` rows, laid end to end by `order` and beside the score at every place; places beyond the scores hold null.

    (order, position in the group, offset, score). Offsets come from positions and sums of sizes by range, not from one task.
    """
    from braidwork.operators.ordering import running_totals

    placed = running_totals(groups, order, size)
    rows = placed.select(order, F.col("_from"), F.explode(F.sequence(F.lit(0), F.col(size) - 1)).alias("position")).withColumn("offset", F.col("_from") + F.col("position")).drop("_from")
    return rows.join(scores.select(F.col(at).cast("long").alias("offset"), score), "offset", "left")


def lists_per_key(rows: DataFrame, lists: DataFrame, on: Sequence[str], value: str, out: str) -> DataFrame:
    """Each row beside the sorted values of its key, an empty list where there is none; a key's values must fit one task."""
    gathered = lists.groupBy(*on).agg(F.sort_array(F.collect_list(value)).alias(out))
    kind = dict(gathered.dtypes)[out]
    return rows.join(gathered, list(on), "left").withColumn(out, F.coalesce(out, F.array().cast(kind)))


def chain_hits(links: DataFrame, node: str, parent: str, targets: DataFrame) -> DataFrame:
    """nodes that reach a target over a chain of links of any length, cycles included.

    Only nodes found in the last round look for the nodes that point at them, so rounds are as many
    as the longest chain has links and their work adds up to one pass over the links.
    """
    from braidwork.session import cut_lineage

    steps = cut_lineage(links.where(F.col(node).isNotNull() & F.col(parent).isNotNull()).select(F.col(node).alias("_n"), F.col(parent).alias("_p")).distinct())
    goal = targets.select(F.col(targets.columns[0]).alias("_p")).where("_p is not null").distinct()
    found = cut_lineage(steps.join(goal, "_p", "left_semi").select("_n").distinct())
    fresh = found
    while not fresh.isEmpty():
        behind = steps.join(fresh.select(F.col("_n").alias("_p")), "_p", "left_semi").select("_n").distinct()
        fresh = cut_lineage(behind.join(found, "_n", "left_anti"))
        found = found.unionByName(fresh)
    return found.select(F.col("_n").alias(node))
