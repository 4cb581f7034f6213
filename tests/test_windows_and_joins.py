from __future__ import annotations

import bisect
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.operators import joins, sampling, skew, windows


def reference_sizes(n: int) -> tuple[int, int, int]:
    if n < 3:
        return n, 0, 0
    train, val = max(1, int(n * 0.8)), max(1, int(n * 0.1))
    if train + val >= n:
        train = max(1, train - 1)
    return train, val, n - train - val


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 20])
def test_chronological_split_sizes(spark, n):
    rows = spark.range(n).select(F.lit("r").alias("g"), F.col("id").alias("at"))
    got = {r.split: r["count"] for r in windows.chronological_split(rows, "g", ["at"]).groupBy("split").count().collect()}
    assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == reference_sizes(n)


def test_split_of_an_empty_table_is_empty(spark):
    assert windows.chronological_split(spark.range(0).select(F.lit("r").alias("g"), "id"), "g", ["id"]).count() == 0


def test_anchors_settle_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 3, "x", "train"), ("a", 3, "y", "train"), ("b", None, "z", "train"), ("c", 1, "w", "test")], "g string, i int, commit_sha string, s string")
    got = {r.g: (r.anchor_value, r.anchor_index) for r in windows.anchors(rows, "g", "i", F.col("s") == "train").collect()}
    assert got == {"a": ("y", 3), "b": ("z", -1)}


def test_smart_cap_keeps_its_limits_and_is_stable(spark):
    rows = [(i, f"r{i % 3}", f"c{i % 5}", f"f{i % 4}" if i % 11 else None, f"t{i % 7}" if i % 13 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, repo string, sha string, file string, fn string")
    cap = lambda: windows.smart_cap(df, ["repo", "sha"], "file", "fn", "id", per_file=2, per_commit=5)
    once, twice = cap().collect(), cap().collect()
    assert sorted(once) == sorted(twice)
    assert max(Counter((r.repo, r.sha) for r in once).values()) <= 5
    assert max(Counter((r.repo, r.sha, r.file) for r in once).values()) <= 2
    assert {(r.repo, r.sha) for r in once} == {(r[1], r[2]) for r in rows}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(1, 30), min_size=1, max_size=5), total=st.integers(1, 60))
def test_largest_remainder_adds_up(spark, sizes, total):
    rows = spark.createDataFrame([(f"s{i}",) for i, n in enumerate(sizes) for _ in range(n)], "s string")
    got = {r.s: r.slots for r in windows.proportional_slots(rows, "s", total).collect()}
    assert sum(got.values()) == min(total, sum(sizes))
    assert all(got[f"s{i}"] <= n for i, n in enumerate(sizes))


def test_asof_forward_matches_brute_force(spark):
    marks = {"a": [2, 5, 9], "b": [4]}
    right = spark.createDataFrame([(g, i, f"{g}{i}") for g, v in marks.items() for i in v], "g string, at int, v string")
    left = spark.createDataFrame([(g, i) for g in ("a", "b", "c") for i in range(12)] + [("a", 5)], "g string, at int")
    for r in joins.asof_forward(left, right, "g", "at", "v").collect():
        known = marks.get(r.g, [])
        at = bisect.bisect_left(known, r["at"])
        assert r.matched == (None if not known else f"{r.g}{known[min(at, len(known) - 1)]}")


def test_cumulative_equals_range_join(spark):
    points = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "g string, i int")
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 5), ("b", 3)], "g string, i int")
    assert {(r.g, r.i): r.n_seen for r in joins.cumulative_at(points, rows, "g", "i").collect()} == {("a", 1): 2, ("a", 4): 3, ("b", 2): 0}
    assert {(r.g, r.i): r.n_seen for r in joins.cumulative_at(points, rows, "g", "i", "new").collect()} == {("a", 1): 1, ("a", 4): 1, ("b", 2): 0}


def test_misses_are_counted_in_order(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "k int")
    found, counts = joins.inner_with_misses(rows, {"a": spark.range(4).select(F.col("id").cast("int").alias("k")), "b": spark.range(2).select(F.col("id").cast("int").alias("k"))}, ["k"])
    assert sorted(r.k for r in found.collect()) == [0, 1]
    assert counts.first().asDict() == {"n_rows": 6, "missed_a": 2, "missed_b": 2}


def test_zero_fill_keeps_rows(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    vec = spark.createDataFrame([(1, [1.0, 2.0])], "k int, v array<float>")
    got = {r.k: (r.hit_v, list(r.v)) for r in joins.left_or_zeros(rows, {"v": vec}, ["k"], 2).collect()}
    assert got == {1: (1, [1.0, 2.0]), 2: (0, [0.0, 0.0])}


def test_head_per_group_is_limited_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = windows.head_per_group(rows, ["g"], ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_samples_are_stable_and_bounded(spark):
    rows = spark.range(500).select((F.col("id") % 5).alias("g"), "id")
    assert sampling.sample_rows(rows, "id", 20, "1").collect() == sampling.sample_rows(rows.repartition(7), "id", 20, "1").collect()
    assert sampling.sample_per_group(rows, ["g"], "id", 7, "1").count() == 35
    labels = sampling.random_split(rows, "g", "id", "3").groupBy("g", "split").count().collect()
    assert {(r.split, r["count"]) for r in labels} == {("train", 80), ("val", 10), ("test", 10)}


def test_round_robin_shards_partition_the_keys(spark):
    rows = spark.range(60).select(F.concat(F.lit("k"), (F.col("id") % 23).cast("string")).alias("k"))
    parts = [{r.k for r in sampling.round_robin_shard(rows, "k", 4, i).collect()} for i in range(4)]
    keys = sorted({f"k{i}" for i in range(23)})
    assert parts == [{k for n, k in enumerate(keys) if n % 4 == i} for i in range(4)]


def test_heavy_keys_and_summary_under_skew(spark):
    rows = [("hot", f"h{i}", i % 9) for i in range(900)] + [(f"r{i % 50}", f"s{i}", None if i % 10 == 0 else i) for i in range(600)] + [(None, "n1", 3), ("empty", "e1", None)]
    df = spark.createDataFrame(rows + rows[:300], "repo_id string, commit_sha string, n_new_assertions int").withColumn("n_commits", F.lit("clash"))
    assert [r.repo_id for r in skew.heavy_keys(df).collect()] == ["hot"]
    got = {r.repo_id: r for r in skew.balanced_key_summary(df).collect()}
    assert (got["hot"].n_commits, got["hot"].sum_value, got["hot"].median_value) == (900, sum(i % 9 for i in range(900)), 4.0)
    assert (got["empty"].n_commits, got["empty"].sum_value, got["empty"].median_value) == (1, None, None)
    assert got[None].n_commits == 1
    empty = df.where("false")
    assert skew.heavy_keys(empty).count() == 0 and skew.balanced_key_summary(empty).count() == 0
    assert skew.heavy_keys(df, share=0.001).count() == 51
