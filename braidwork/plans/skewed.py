"""Queries of problem 5: per-key results under heavy skew."""

from __future__ import annotations

from braidwork.operators import skew
from braidwork.session import table

QUERIES = {
    "p5_found": lambda spark, d: skew.heavy_keys(table(spark, d, "commits")),
    "p5_repo_summary": lambda spark, d: skew.balanced_key_summary(table(spark, d, "commits")),
}

ORACLE = {
    "p5_found": """
        with c as (select commit_sha, any_value(repo_id) as repo_id from commits where commit_sha is not null group by commit_sha)
        select repo_id from c where repo_id is not null group by repo_id having count(*) >= (select count(*) from c) * 0.04::double""",
    "p5_repo_summary": """
        with c as (select commit_sha, any_value(repo_id) as repo_id, max(n_new_assertions) as n from commits where commit_sha is not null group by commit_sha)
        select repo_id, count(*) as n_commits, cast(sum(n) as bigint) as sum_value, quantile_cont(n::double, 0.5) as median_value from c group by repo_id""",
}
