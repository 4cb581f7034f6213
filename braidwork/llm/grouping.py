"""Splits that keep related records together (problem 6).

Repositories joined by forks, renames or mirrors form components, found by random-mate contraction:
each round every vertex tosses a coin, heads hook onto a neighbouring tail, edges are relabelled and
loops dropped, until no edge is left; the rounds are then unwound into labels. All steps are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import cut_lineage

JOINING = ("fork_of", "renamed_to", "mirror_of")
SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def project_of(repo_id: Column) -> Column:
    """owner/name behind any spelling: letter case, blanks, address form, trailing slash or .git."""
    bare = F.lower(F.regexp_replace(repo_id, r"(?U)[\s\p{Cf}]+", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"(/|\.git)+$", "")
    pair = F.regexp_extract(bare, r"([^/:@]+/[^/:@]+)$", 1)
    return F.when(bare == "", None).otherwise(F.when(pair == "", bare).otherwise(pair))


def _coin(vertex: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.col(vertex), F.lit(turn)), F.lit(2))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, label) for every vertex of an undirected edge list; loops, repeats and null ends are ignored.

    Rounds are logarithmic in the number of edges. Each is cut off through the checkpoint folder.
    """
    pair = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    live = cut_lineage(pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        turn = len(rounds)
        hooks = live.where((_coin("u", turn) == 1) & (_coin("v", turn) == 0)).groupBy("u").agg(F.min("v").alias("parent"))
        hooks = cut_lineage(hooks)
        rounds.append(hooks)
        ends = [hooks.select(F.col("u").alias(x), F.col("parent").alias(f"p{x}")) for x in ("u", "v")]
        moved = live.join(ends[0], "u", "left").join(ends[1], "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"))
        live = cut_lineage(moved.where("u <> v").distinct())
    spark = edges.sparkSession
    if not rounds:
        return spark.createDataFrame([], "vertex string, label string")
    labels = rounds[-1].select(F.col("u").alias("vertex"), F.col("parent").alias("label"))
    for hooks in reversed(rounds[:-1]):
        up = labels.select(F.col("vertex").alias("parent"), F.col("label").alias("top"))
        here = hooks.join(up, "parent", "left").select(F.col("u").alias("vertex"), F.coalesce("top", "parent").alias("label"))
        labels = cut_lineage(labels.unionByName(here))
    roots = labels.select(F.col("label").alias("vertex"), "label").distinct()
    return labels.unionByName(roots)


def project_groups(snapshots: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, project, component) of every spelling in snapshots; a project without links is its own component."""
    spelled = snapshots.where("repo_id is not null").select("repo_id").distinct().withColumn("project", project_of(F.col("repo_id")))
    joined = links.where(F.col("link_kind").isin(*JOINING)).select(project_of(F.col("repo_id")).alias("a"), project_of(F.col("linked_repo_id")).alias("b"))
    labels = components(joined)
    return spelled.join(labels, F.col("project") == F.col("vertex"), "left").select("repo_id", "project", F.coalesce("label", "project").alias("component"))


def straddling(snapshots: DataFrame, links: DataFrame) -> DataFrame:
    """repo_ids, as spelled, of components whose snapshots carry two or more different non-null splits."""
    groups = project_groups(snapshots, links)
    seen = snapshots.where("repo_id is not null").select("repo_id", "cross_repo_split").distinct()
    rows = groups.join(seen, "repo_id")
    span = rows.groupBy("component").agg(F.min("cross_repo_split").alias("lo"), F.max("cross_repo_split").alias("hi")).where("lo <> hi").select("component")
    return groups.join(span, "component", "left_semi").select("repo_id").distinct()


def grouped_split(snapshots: DataFrame, links: DataFrame, buckets: int = 64) -> DataFrame:
    """(repo_id, project, component, n_records, split): components laid end to end, large ones first, and cut by share.

    Weight is the number of distinct records. Positions come from totals per (size class, hash)
    bucket, whose number is fixed, and running sums inside each bucket, so no task sees all
    components. A component takes the split its middle falls in. Null repo_ids belong to no project
    and are left out.
    """
    groups = cut_lineage(project_groups(snapshots, links))
    records = snapshots.where("repo_id is not null").select("repo_id", "commit_index", "commit_sha").distinct().groupBy("repo_id").agg(F.count("*").alias("n_records"))
    sized = groups.join(records, "repo_id")
    weight = sized.groupBy("component").agg(F.sum("n_records").alias("w"))
    weight = weight.withColumn("size_class", -F.floor(F.log2("w"))).withColumn("h", F.xxhash64("component")).withColumn("part", F.pmod("h", F.lit(buckets)))
    totals = weight.groupBy("size_class", "part").agg(F.sum("w").alias("t"))
    before = totals.withColumn("upto", F.sum("t").over(Window.orderBy("size_class", "part").rowsBetween(Window.unboundedPreceding, -1))).withColumn("all", F.sum("t").over(Window.partitionBy()))
    inside = Window.partitionBy("size_class", "part").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, -1)
    placed = weight.withColumn("run", F.coalesce(F.sum("w").over(inside), F.lit(0))).join(F.broadcast(before), ["size_class", "part"])
    middle = (F.coalesce("upto", F.lit(0)) + F.col("run") + F.col("w") / 2) / F.col("all")
    split = F.when(middle < SHARES[0][1], SHARES[0][0]).when(middle < SHARES[0][1] + SHARES[1][1], SHARES[1][0]).otherwise(SHARES[2][0])
    chosen = placed.select("component", split.alias("split"))
    return sized.join(chosen, "component").select("repo_id", "project", "component", "n_records", "split")
