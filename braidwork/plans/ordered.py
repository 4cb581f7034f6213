"""Queries over ordered groups (2.5), caps and samples (2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import sampling, windows
from braidwork.plans.base import SQL_C, SQL_Q, commits, qna
from braidwork.session import table

PAIRS = {
    "w_chronological_split": (
        lambda s, d: windows.chronological_split(commits(s, d).withColumnRenamed("commit_index", "at"), "repo_id", ["at", "commit_sha"]).select("repo_id", "commit_sha", "split", F.col("commit_index").cast("long").alias("position")),
        f"""with {SQL_C}, r as (select repo_id, commit_sha, row_number() over (partition by repo_id order by commit_index, commit_sha) as rn, count(*) over (partition by repo_id) as n from c),
        z as (select *, greatest(1, floor(n * 0.8::double)) as t0, greatest(1, floor(n * 0.1::double)) as v from r), y as (select *, case when t0 + v >= n then greatest(1, t0 - 1) else t0 end as t from z)
        select repo_id, commit_sha, case when n < 3 or rn <= t then 'train' when rn <= t + v then 'val' else 'test' end as split, rn - 1 as position from y""",
    ),
    "w_previous_kept": (
        lambda s, d: windows.with_previous(commits(s, d).where("n_new_assertions > 0"), "repo_id", ["commit_index"], "commit_sha", "base_sha").select("repo_id", "commit_sha", "base_sha"),
        f"with {SQL_C} select repo_id, commit_sha, lag(commit_sha) over (partition by repo_id order by commit_index) as base_sha from c where n_new_assertions > 0",
    ),
    "w_last_train_anchor": (
        lambda s, d: windows.anchors(commits(s, d), "repo_id", "commit_index", F.col("in_repo_split") == "train"),
        f"with {SQL_C} select repo_id, arg_max(commit_sha, (commit_index, commit_sha)) as anchor_value, max(commit_index) as anchor_index from c where in_repo_split = 'train' group by repo_id",
    ),
    "w_first_test_anchor": (
        lambda s, d: windows.anchors(commits(s, d), "repo_id", "commit_index", F.col("in_repo_split") == "test", latest=False),
        f"with {SQL_C} select repo_id, arg_min(commit_sha, (commit_index, commit_sha)) as anchor_value, min(commit_index) as anchor_index from c where in_repo_split = 'test' group by repo_id",
    ),
    "w_distance": (
        lambda s, d: windows.distance_from_anchor(commits(s, d), windows.anchors(commits(s, d), "repo_id", "commit_index", F.col("in_repo_split") == "train"), "repo_id", "commit_index").select("commit_sha", "anchor_value", "n_after_anchor"),
        f"""with {SQL_C}, a as (select repo_id, arg_max(commit_sha, (commit_index, commit_sha)) as v, max(commit_index) as i from c where in_repo_split = 'train' group by repo_id)
        select commit_sha, coalesce(v, '') as anchor_value, commit_index - coalesce(i, -1) as n_after_anchor from c left join a using (repo_id)""",
    ),
    "w_keep_last": (
        lambda s, d: windows.first_per_group(qna(s, d), ["repo_id", "test_file", "lineno"], [F.desc("commit_index"), F.desc("qna_id")]).select("repo_id", "test_file", "lineno", "qna_id"),
        f"with {SQL_Q} select repo_id, test_file, lineno, qna_id from q qualify row_number() over (partition by repo_id, test_file, lineno order by commit_index desc, qna_id desc) = 1",
    ),
    "w_first_occurrence": (
        lambda s, d: windows.first_per_group(table(s, d, "qna_pairs").select("qna_id", "repo_id", "commit_index", F.md5("prefix").alias("p"), F.md5("target").alias("t")).distinct(), ["repo_id", "p", "t"], ["commit_index", "qna_id"]).select("repo_id", "qna_id"),
        """with x as (select distinct qna_id, repo_id, commit_index, md5(prefix) as p, md5(target) as t from qna_pairs)
        select repo_id, qna_id from x qualify row_number() over (partition by repo_id, p, t order by commit_index, qna_id) = 1""",
    ),
    "w_head_per_repo": (
        lambda s, d: windows.head_per_group(qna(s, d), ["repo_id"], ["commit_index", "qna_id"], 20).select("repo_id", "qna_id"),
        f"with {SQL_Q} select repo_id, qna_id from q qualify row_number() over (partition by repo_id order by commit_index, qna_id) <= 20",
    ),
    "w_position_split": (
        lambda s, d: windows.position_split(qna(s, d), "repo_id", ["commit_index", "qna_id"], 5).groupBy("repo_id", "role").agg(F.count("*").alias("n"), F.max("group_index").cast("long").alias("last_index")),
        f"""with {SQL_Q}, r as (select repo_id, row_number() over (partition by repo_id order by commit_index, qna_id) - 1 as i from q)
        select repo_id, case when i < 5 then 'eval' else 'train' end as role, count(*) as n, max(i) as last_index from r group by all""",
    ),
    "w_normalised_position": (
        lambda s, d: windows.normalised_position(commits(s, d), "repo_id", "commit_index").select("commit_sha", F.round("position", 6).alias("position"), "n_after_first"),
        f"""with {SQL_C}, e as (select repo_id, min(commit_index) as lo, max(commit_index) as hi from c group by repo_id)
        select commit_sha, round((commit_index - lo) / greatest(hi - lo, 1)::double, 6) as position, commit_index - lo as n_after_first from c join e using (repo_id)""",
    ),
    "w_percentile_positions": (
        lambda s, d: windows.percentile_positions(commits(s, d), "repo_id", ["commit_index", "commit_sha"], [0, 25, 50, 75, 100]).select("repo_id", "commit_sha"),
        f"""with {SQL_C}, r as (select *, row_number() over (partition by repo_id order by commit_index, commit_sha) - 1 as i, count(*) over (partition by repo_id) as n from c)
        select repo_id, commit_sha from r where i in (0, round_even((n - 1) * 0.25::double, 0), round_even((n - 1) * 0.5::double, 0), round_even((n - 1) * 0.75::double, 0), n - 1)""",
    ),
    "w_uniform_positions": (
        lambda s, d: windows.uniform_positions(commits(s, d), "repo_id", ["commit_index", "commit_sha"], 6).select("repo_id", "commit_sha"),
        f"""with {SQL_C}, r as (select *, row_number() over (partition by repo_id order by commit_index, commit_sha) - 1 as i, count(*) over (partition by repo_id) as n from c)
        select repo_id, commit_sha from r where n <= 6 or i in (0, n - 1) or i in (floor(n / 6.0::double), floor(2 * (n / 6.0::double)), floor(3 * (n / 6.0::double)), floor(4 * (n / 6.0::double)))""",
    ),
    "w_cap_per_function_and_file": (
        lambda s, d: windows.head_per_group(windows.head_per_group(qna(s, d), ["repo_id", "test_file", "test_function"], ["lineno", "qna_id"], 2), ["repo_id", "test_file"], ["lineno", "qna_id"], 3).select("repo_id", "test_file", "qna_id"),
        f"""with {SQL_Q}, a as (select * from q qualify row_number() over (partition by repo_id, test_file, test_function order by lineno, qna_id) <= 2)
        select repo_id, test_file, qna_id from a qualify row_number() over (partition by repo_id, test_file order by lineno, qna_id) <= 3""",
    ),
    "w_largest_remainder": (
        lambda s, d: windows.proportional_slots(qna(s, d), "assertion_type", 200).select("assertion_type", "n", F.col("slots").cast("long").alias("slots")),
        f"""with {SQL_Q}, z as (select assertion_type, count(*) as n from q group by 1), e as (select *, 200 * n / (sum(n) over ())::double as x, sum(n) over () as total from z),
        r as (select *, row_number() over (order by x - floor(x) desc, assertion_type) as rn, 200 - sum(floor(x)) over () as rest from e)
        select assertion_type, n, cast(case when total <= 200 then n else least(floor(x) + case when rn <= rest then 1 else 0 end, n) end as bigint) as slots from r""",
    ),
    "w_stratified_sample": (
        lambda s, d: windows.stratified_sample(qna(s, d), "assertion_type", 200, ["lineno", "qna_id"]).select("assertion_type", "qna_id"),
        f"""with {SQL_Q}, z as (select assertion_type, count(*) as n from q group by 1), e as (select *, 200 * n / (sum(n) over ())::double as x from z),
        r as (select *, row_number() over (order by x - floor(x) desc, assertion_type) as rn, 200 - sum(floor(x)) over () as rest from e),
        k as (select *, row_number() over (partition by assertion_type order by lineno, qna_id) as i from q)
        select k.assertion_type, qna_id from k join r using (assertion_type) where i <= floor(x) + case when rn <= rest then 1 else 0 end""",
    ),
    "w_interleave": (
        lambda s, d: windows.interleave(qna(s, d).where("test_function is not null"), ["repo_id", "test_file"], "assertion_type", ["lineno", "qna_id"], 3).select("repo_id", "test_file", "qna_id"),
        f"""with {SQL_Q}, a as (select *, row_number() over (partition by repo_id, test_file, assertion_type order by lineno, qna_id) as turn from q where test_function is not null)
        select repo_id, test_file, qna_id from a qualify row_number() over (partition by repo_id, test_file order by turn, assertion_type, lineno, qna_id) <= 3""",
    ),
    "w_smart_cap": (
        lambda s, d: windows.capped_train(qna(s, d), F.col("in_repo_split") == "train", commit=["repo_id", "commit_sha"], file="test_file", function="test_function", row_id="qna_id", per_file=2, per_commit=3).select("qna_id", "in_repo_split"),
        f"""with {SQL_Q}, r as (select *, coalesce(test_file, '') as f, coalesce(test_function, '') as g, md5('1234|' || qna_id) as luck from q where in_repo_split = 'train'),
        k as (select *, md5('1234|' || f) as fk, md5('1234|' || f || '|' || g) as gk from r),
        a as (select *, row_number() over (partition by repo_id, commit_sha, f, g order by luck, qna_id) as turn from k),
        b as (select *, row_number() over (partition by repo_id, commit_sha, f order by turn, gk, g, luck, qna_id) as in_file from a),
        e as (select * from b where in_file <= 2 qualify row_number() over (partition by repo_id, commit_sha order by in_file, fk, f, luck, qna_id) <= 3)
        select qna_id, in_repo_split from e union all select qna_id, in_repo_split from q where in_repo_split <> 'train'""",
    ),
    "w_first_seen": (
        lambda s, d: windows.first_seen(table(s, d, "file_changes").where("path is not null"), ["repo_id", "path"], "seq"),
        "select repo_id, path, min(seq) as first_index from file_changes where path is not null group by all",
    ),
    "w_preamble": (
        lambda s, d: windows.preamble(commits(s, d), "repo_id", ["commit_index", "commit_sha"]).select("repo_id", "commit_sha"),
        f"""with {SQL_C}, r as (select *, row_number() over (partition by repo_id order by commit_index, commit_sha) as rn, count(*) over (partition by repo_id) as n from c)
        select repo_id, commit_sha from r where rn <= greatest(1, floor(n * 0.1::double))""",
    ),
    "w_running_total": (
        lambda s, d: windows.running_total(commits(s, d), "repo_id", ["commit_index"], "n_new_assertions", "total").select("commit_sha", "total"),
        f"with {SQL_C} select commit_sha, cast(sum(n_new_assertions) over (partition by repo_id order by commit_index) as bigint) as total from c",
    ),
    "w_new_assertions": (
        lambda s, d: windows.new_keys(
            qna(s, d).groupBy("repo_id", "test_file", "commit_index").agg(F.collect_set(F.concat_ws("|", "assertion_type", "test_function")).alias("keys")), ["repo_id", "test_file"], ["commit_index"], "keys"
        ).select("repo_id", "test_file", "commit_index", F.size("new_keys").alias("n_new")),
        f"""with {SQL_Q}, k as (select repo_id, test_file, commit_index, list_distinct(list(concat_ws('|', assertion_type, test_function))) as keys from q group by 1, 2, 3),
        p as (select *, lag(keys) over (partition by repo_id, test_file order by commit_index) as prev from k)
        select repo_id, test_file, commit_index, cast(len(list_filter(keys, lambda x: prev is null or not list_contains(prev, x))) as int) as n_new from p""",
    ),
    "t_first_repos": (
        lambda s, d: commits(s, d).select("repo_id").distinct().orderBy("repo_id").limit(25),
        f"with {SQL_C} select distinct repo_id from c order by 1 limit 25",
    ),
    "t_sample": (
        lambda s, d: sampling.sample_rows(qna(s, d), "qna_id", 100, "42").select("qna_id", "repo_id"),
        f"with {SQL_Q} select qna_id, repo_id from q order by md5('42|' || qna_id), qna_id limit 100",
    ),
    "t_sample_per_commit": (
        lambda s, d: sampling.sample_per_group(qna(s, d), ["repo_id", "commit_sha"], "qna_id", 2, "7").select("qna_id"),
        f"with {SQL_Q} select qna_id from q qualify row_number() over (partition by repo_id, commit_sha order by md5('7|' || qna_id), qna_id) <= 2",
    ),
    "t_random_split": (
        lambda s, d: sampling.random_split(qna(s, d), "repo_id", "qna_id", "3407").select("qna_id", "split"),
        f"""with {SQL_Q}, r as (select qna_id, row_number() over (partition by repo_id order by md5('3407|' || qna_id), qna_id) as rn, count(*) over (partition by repo_id) as n from q)
        select qna_id, case when rn <= floor(n * 0.8::double) then 'train' when rn <= floor(n * (0.8::double + 0.1::double)) then 'val' else 'test' end as split from r""",
    ),
    "t_temporal_split": (
        lambda s, d: sampling.temporal_split(qna(s, d), "repo_id", "commit_index", "qna_id", "42").select("qna_id", "split"),
        f"""with {SQL_Q}, r as (select *, dense_rank() over (partition by repo_id order by commit_index) as i, row_number() over (partition by repo_id order by md5('42|' || qna_id), qna_id) as rn, count(*) over (partition by repo_id) as n from q),
        k as (select *, max(i) over (partition by repo_id) as k from r),
        m as (select *, greatest(1, round_even(k * 0.8::double, 0)) as c0 from k), z as (select *, case when c0 >= k then k - 1 else c0 end as cut from m)
        select qna_id, case when k >= 2 then case when i <= cut then 'train' else 'test' end when rn <= greatest(1, round_even(n * 0.8::double, 0)) then 'train' else 'test' end as split from z""",
    ),
    "t_tiered_cap": (
        lambda s, d: qna(s, d).groupBy("repo_id").agg(F.count("*").alias("n")).select("repo_id", sampling.tiered_cap(F.col("n")).cast("long").alias("cap")),
        f"with {SQL_Q} select repo_id, case when count(*) <= 100 then count(*) when count(*) <= 1000 then 200 when count(*) <= 5000 then 150 else 50 end as cap from q group by repo_id",
    ),
    "t_draws_with_replacement": (
        lambda s, d: sampling.draws_with_replacement(qna(s, d), qna(s, d), "repo_id", "qna_id", 8, 5, 16, "11").select("repo_id", "qna_id", F.col("draw").cast("long").alias("draw"), F.col("batch").cast("long").alias("batch")),
        f"""with {SQL_Q}, g as (select repo_id, row_number() over (order by md5('11|' || repo_id), repo_id) - 1 as g from (select distinct repo_id from q) qualify g < 8),
        z as (select repo_id, count(*) as n from q group by 1), x as (select repo_id, g, n, unnest(range(5)) as i from g join z using (repo_id)),
        y as (select repo_id, g * 5 + i as draw, ('0x' || substr(md5('11|' || repo_id || '|' || i), 1, 8))::bigint % n as pos from x),
        r as (select repo_id, qna_id, row_number() over (partition by repo_id order by qna_id) - 1 as pos from q)
        select repo_id, qna_id, draw, draw // 16 as batch from y join r using (repo_id, pos) where draw < 32""",
    ),
    "f_round_robin_shard": (
        lambda s, d: sampling.round_robin_shard(commits(s, d), "repo_id", 4, 1).groupBy("repo_id").agg(F.count("*").alias("n")),
        f"with {SQL_C}, k as (select repo_id, (dense_rank() over (order by repo_id) - 1) % 4 as i from c) select repo_id, count(*) as n from k where i = 1 group by 1",
    ),
    "f_groups_of_size": (
        lambda s, d: sampling.groups_of_size(qna(s, d), "repo_id", 10).groupBy("repo_id").agg(F.count("*").alias("n")),
        f"with {SQL_Q} select repo_id, count(*) as n from q group by 1 having count(*) >= 10",
    ),
}

QUERIES = {k: v[0] for k, v in PAIRS.items()}
ORACLE = {k: v[1] for k, v in PAIRS.items() if v[1]}
