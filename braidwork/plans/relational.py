"""Queries over joins (2.3), sets (2.7) and scans (2.1, 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import text, vectors
from braidwork.operators import joins, ordering, windows
from braidwork.plans.base import SQL_C, SQL_Q, SQL_S, SQL_T, commits, qna, scores, texts
from braidwork.session import table

SQL_SNAP = "n as (select distinct commit_sha, in_repo_split, cross_repo_split from snapshots where commit_sha is not null)"
SQL_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_ENDING = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.](\.[^.]+)$', 1))"
SQL_SKIPPED = "len(list_intersect(string_split(path, '/'), ['.git', '__pycache__', '.venv', 'venv', 'env', 'node_modules', 'dist', 'build', '.tox', '.mypy_cache'])) > 0"


def _cumulative(s, d):
    return joins.cumulative_at(commits(s, d).select("repo_id", "commit_index", "commit_sha"), qna(s, d), "repo_id", "commit_index").select("commit_sha", "n_seen")


def _zero_fill(s, d):
    vec = lambda name, c: table(s, d, name).where(vectors.is_finite(F.col(c), 64)).select("commit_sha", c).dropDuplicates(["commit_sha"])
    rows = joins.left_or_zeros(commits(s, d).select("commit_sha"), {"diff_embedding": vec("commits", "diff_embedding"), "repo_state_embedding": vec("snapshots", "repo_state_embedding")}, ["commit_sha"], 64)
    return rows.select("commit_sha", "hit_diff_embedding", "hit_repo_state_embedding", F.size("repo_state_embedding").alias("width"))


SQL_FINITE = "{0} is not null and len({0}) = 64 and list_bool_and(list_transform({0}, lambda x: isfinite(x)))"
SQL_HITS = f"""dv as (select distinct commit_sha from commits where {SQL_FINITE.format('diff_embedding')}), sv as (select distinct commit_sha from snapshots where {SQL_FINITE.format('repo_state_embedding')})"""


def _misses(s, d):
    sides = {"snapshot": table(s, d, "snapshots").select("commit_sha"), "question": qna(s, d).select("commit_sha")}
    return joins.inner_with_misses(commits(s, d), sides, ["commit_sha"])[1]


def _asof(s, d):
    marks = commits(s, d).where("n_new_assertions > 1").select("repo_id", "commit_index", "commit_sha")
    rows = commits(s, d).select("repo_id", "commit_index", F.col("commit_sha").alias("row_sha"))
    return joins.asof_forward(rows, marks, "repo_id", "commit_index", "commit_sha").select("row_sha", "matched")


def _late_fetch(s, d):
    chosen = windows.head_per_group(qna(s, d), ["repo_id"], ["commit_index", "qna_id"], 1).select("qna_id")
    wide = table(s, d, "qna_pairs").select("qna_id", "prefix", "target").join(chosen, "qna_id", "left_semi").dropDuplicates(["qna_id"])
    return wide.select("qna_id", F.length("prefix").alias("n_prefix"), F.md5("target").alias("target_md5"))


def _priority(s, d):
    paths = table(s, d, "file_changes").where("path is not null").select("repo_id", "path").distinct()
    defined = paths.where(F.col("path").endswith(".py")).select(text.dotted_module(F.col("path")).alias("module"), F.col("path").alias("file")).groupBy("module").agg(F.min("file").alias("file"))
    rows = paths.where(F.col("path").rlike(r"\.(py|js)$")).select("path").distinct()
    exact = text.dotted_module(F.regexp_replace("path", r"\.js$", ".py"))
    return joins.pick_by_priority(rows, "module", [(defined, exact), (defined, F.regexp_replace(exact, r"^src\.", "")), (defined, F.regexp_replace(exact, r"\.[^.]+$", ""))], "file").select("path", "file")


def _ordered_files(s, d):
    files = table(s, d, "file_changes").where("path is not null and new_blob is not null").select("repo_id", "seq", "path", "new_blob").distinct()
    known = table(s, d, "blobs").select(F.col("blob_sha").alias("new_blob"), F.length("text").alias("size"))
    return ordering.positions(files.join(known, "new_blob"), ["repo_id"], ["seq", "path", "new_blob"]).select("repo_id", "position", "path", "size")


def _anchor_range(s, d):
    anchor = windows.anchors(commits(s, d), "repo_id", "commit_index", F.col("in_repo_split") == "train").select("repo_id", "anchor_index")
    live = table(s, d, "qna_pairs").select("repo_id", "commit_index", "test_file", "test_function", F.md5("target").alias("t")).join(anchor, "repo_id").where(F.col("commit_index") <= F.col("anchor_index"))
    return live.groupBy("repo_id").agg(F.count_distinct(F.struct("test_file", F.coalesce("test_function", F.lit("")), F.coalesce("t", F.lit("")))).alias("n_pairs"))


PAIRS = {
    "s_pushed_scan": (
        lambda s, d: table(s, d, "commits").where((F.col("in_repo_split") == "train") & F.col("cross_repo_split").isin("train", "cr_val") & (F.col("commit_index") != 0)).select("repo_id", "commit_sha").distinct(),
        "select distinct repo_id, commit_sha from commits where in_repo_split = 'train' and cross_repo_split in ('train', 'cr_val') and commit_index <> 0",
    ),
    "s_first_rows": (lambda s, d: qna(s, d).where("cross_repo_split = 'train'").orderBy("qna_id").limit(50).select("qna_id", "repo_id"), f"with {SQL_Q} select qna_id, repo_id from q where cross_repo_split = 'train' order by qna_id limit 50"),
    "s_count_only": (lambda s, d: table(s, d, "qna_pairs").where("in_repo_split = 'train'").agg(F.count("*").alias("n")), "select count(*) as n from qna_pairs where in_repo_split = 'train'"),
    "s_snapshot_rows": (
        lambda s, d: table(s, d, "snapshots").where(F.col("in_repo_split").isin("val", "test") & F.col("repo_id").like("%/%")).groupBy("repo_id", "in_repo_split").agg(F.count("*").alias("n")),
        "select repo_id, in_repo_split, count(*) as n from snapshots where in_repo_split in ('val', 'test') and repo_id like '%/%' group by all",
    ),
    "s_commit_sequences": (
        lambda s, d: ordering.positions(commits(s, d).select("repo_id", "commit_index", "commit_sha"), ["repo_id"], ["commit_index", "commit_sha"]).select("repo_id", "position", "commit_sha"),
        f"with {SQL_C} select repo_id, row_number() over (partition by repo_id order by commit_index, commit_sha) - 1 as position, commit_sha from c",
    ),
    "s_questions_of_commits": (
        lambda s, d: joins.known_keys(qna(s, d), commits(s, d).where("commit_index < 3"), ["repo_id", "commit_sha"]).select("qna_id"),
        f"with {SQL_C}, {SQL_Q} select qna_id from q where (repo_id, commit_sha) in (select (repo_id, commit_sha) from c where commit_index < 3)",
    ),
    "s_usable_vectors": (
        lambda s, d: table(s, d, "commits").select("commit_sha", vectors.is_finite(F.col("diff_embedding"), 64).alias("usable")).distinct(),
        f"select distinct commit_sha, coalesce({SQL_FINITE.format('diff_embedding')}, false) as usable from commits",
    ),
    "f_valid_pairs": (
        lambda s, d: texts(s, d).where(text.is_valid_pair(F.col("prefix"), F.col("target"))).groupBy("assertion_type").agg(F.count("*").alias("n")),
        rf"with {SQL_T} select assertion_type, count(*) as n from t where length(prefix) > 0 and length(target) > 0 and not regexp_matches(target, '^{SQL_BLANK}*,') group by 1",
    ),
    "f_trivial_targets": (
        lambda s, d: texts(s, d).groupBy(text.is_trivial_target(F.col("target")).alias("trivial")).agg(F.count("*").alias("n")),
        rf"""with {SQL_T}, x as (select regexp_replace(regexp_replace(target, '^{SQL_BLANK}+', ''), '{SQL_BLANK}+\z', '') as t from t)
        select t is null or length(t) < 4 or (length(t) <= 6 and (t like '%)' or t like ',%')) as trivial, count(*) as n from x group by 1""",
    ),
    "f_pair_reasons": (
        lambda s, d: texts(s, d).groupBy(text.pair_reason(F.col("prefix"), F.col("target"), F.col("test_function").isNotNull()).alias("reason")).agg(F.count("*").alias("n")),
        rf"""with {SQL_T}, x as (select regexp_replace(regexp_replace(coalesce(target, ''), '^{SQL_BLANK}+', ''), '{SQL_BLANK}+\z', '') as t, test_function, string_split(regexp_replace(prefix, '{SQL_BLANK}+\z', ''), chr(10))[-1] as l from t)
        select case when t = '' then 'empty_target' when t like ',%' then 'comma_leading_target' when t in (')', '))', ')))', ']', ']]', '}}') then 'paren_only_target' when length(t) > 500 then 'target_too_long'
        when test_function is null then 'no_enclosing_function' when contains(l, '(,') then 'malformed_prefix_comma' else '' end as reason, count(*) as n from x group by 1""",
    ),
    "f_path_rules": (
        lambda s, d: table(s, d, "file_changes").where("path is not null").select("path").distinct().select("path", text.is_test_path(F.col("path")).alias("is_test"), text.is_python_test_file(F.col("path")).alias("is_python_test"), text.skips_diff_path(F.col("path")).alias("skipped"), text.matches_test_name(F.col("path")).alias("test_name")),
        rf"""with p as (select distinct path from file_changes where path is not null)
        select path, contains(lower(path), 'test') as is_test, {SQL_ENDING} = '.py' and not ({SQL_SKIPPED}) and contains(lower(path), 'test') as is_python_test,
        {SQL_ENDING} not in ('.py', '.md', '.rst') or ({SQL_SKIPPED}) or contains(lower(path), 'test') as skipped, regexp_matches(path, '(^|/)(test_[^/]*\.py$|[^/]*_test\.py$|tests?/)') as test_name from p""",
    ),
    "f_filtered_diff": (
        lambda s, d: table(s, d, "commits").select("commit_sha", F.length(text.filtered_diff(F.col("production_code_diff"))).alias("n_chars")).distinct(),
        rf"""with x as (select distinct commit_sha, coalesce(production_code_diff, '') as t from commits),
        h as (select commit_sha, t, list_filter(string_split(chr(10) || t, chr(10) || 'diff --git ')[2:], lambda z: true) as parts from x),
        u as (select commit_sha, unnest(parts) as part, generate_subscripts(parts, 1) as i, len(parts) as k from h),
        v as (select commit_sha, part, i, k, regexp_extract(part, '^a/(.+?) b/(.+?)(?:\n|\z)', 2) as path from u),
        w as (select commit_sha, sum(length(part) + 11 + case when i < k then 1 else 0 end) as n from v where path <> '' and not ({SQL_ENDING} not in ('.py', '.md', '.rst') or ({SQL_SKIPPED}) or contains(lower(path), 'test')) group by 1)
        select x.commit_sha, cast(coalesce(n, 0) as int) as n_chars from x left join w using (commit_sha)""",
    ),
    "j_keys_to_commits": (
        lambda s, d: qna(s, d).select("repo_id", "commit_sha").distinct().join(commits(s, d).select("repo_id", "commit_sha", "commit_index", "n_new_assertions"), ["repo_id", "commit_sha"], "left"),
        f"with {SQL_C}, {SQL_Q} select k.repo_id, k.commit_sha, c.commit_index, n_new_assertions from (select distinct repo_id, commit_sha from q) k left join c using (repo_id, commit_sha)",
    ),
    "j_inner_ordered": (
        lambda s, d: qna(s, d).join(commits(s, d).select("repo_id", "commit_index", "commit_timestamp"), ["repo_id", "commit_index"]).orderBy("repo_id", "commit_index", "qna_id").select("qna_id", "commit_timestamp"),
        f"with {SQL_C}, {SQL_Q} select qna_id, commit_timestamp from q join c using (repo_id, commit_index) order by q.repo_id, commit_index, qna_id",
    ),
    "j_zero_fill": (_zero_fill, f"with {SQL_HITS}, x as (select distinct commit_sha from commits) select x.commit_sha, (dv.commit_sha is not null)::int as hit_diff_embedding, (sv.commit_sha is not null)::int as hit_repo_state_embedding, 64 as width from x left join dv using (commit_sha) left join sv on sv.commit_sha = x.commit_sha"),
    "j_miss_counts": (
        _misses,
        f"""with {SQL_C} select count(*) as n_rows, count(*) filter (where commit_sha not in (select commit_sha from snapshots where commit_sha is not null)) as missed_snapshot,
        count(*) filter (where commit_sha in (select commit_sha from snapshots where commit_sha is not null) and commit_sha not in (select commit_sha from qna_pairs where commit_sha is not null)) as missed_question from c""",
    ),
    "j_missing_references": (lambda s, d: joins.missing_keys(qna(s, d).select("commit_sha").distinct(), commits(s, d), ["commit_sha"]).agg(F.count("*").alias("n")), "select count(*) as n from (select distinct commit_sha from qna_pairs) where commit_sha not in (select commit_sha from commits)"),
    "j_commits_without_snapshot": (
        lambda s, d: joins.missing_keys(commits(s, d).select("commit_sha"), table(s, d, "snapshots"), ["commit_sha"]),
        f"with {SQL_C} select commit_sha from c where commit_sha not in (select commit_sha from snapshots where commit_sha is not null)",
    ),
    "j_train_repos_only": (
        lambda s, d: joins.missing_keys(commits(s, d).where("cross_repo_split = 'train'").select("repo_id").distinct(), table(s, d, "repo_links").where("link_kind = 'fork_of'"), ["repo_id"]),
        f"with {SQL_C} select distinct repo_id from c where cross_repo_split = 'train' and repo_id not in (select repo_id from repo_links where link_kind = 'fork_of' and repo_id is not null)",
    ),
    "j_cumulative": (_cumulative, f"with {SQL_C}, {SQL_Q} select c.commit_sha, count(q.qna_id) as n_seen from c left join q on q.repo_id = c.repo_id and q.commit_index <= c.commit_index group by c.commit_sha"),
    "j_at_commit": (
        lambda s, d: joins.cumulative_at(commits(s, d).select("repo_id", "commit_index", "commit_sha"), qna(s, d), "repo_id", "commit_index", "new").select("commit_sha", "n_seen"),
        f"with {SQL_C}, {SQL_Q} select c.commit_sha, count(q.qna_id) as n_seen from c left join q on q.repo_id = c.repo_id and q.commit_index = c.commit_index group by c.commit_sha",
    ),
    "j_asof_forward": (
        _asof,
        f"""with {SQL_C}, m as (select * from c where n_new_assertions > 1), l as (select repo_id, arg_max(commit_sha, commit_index) as v from m group by 1),
        x as (select c.commit_sha as row_sha, c.repo_id, arg_min(m.commit_sha, m.commit_index) as v from c left join m on m.repo_id = c.repo_id and m.commit_index >= c.commit_index group by 1, 2)
        select row_sha, coalesce(x.v, l.v) as matched from x left join l using (repo_id)""",
    ),
    "j_truncated_keys": (
        lambda s, d: table(s, d, "qna_pairs").select(F.substring(text.strip(F.col("target")), 1, 12).alias("k"), "commit_index").where("k <> ''").groupBy("k").agg(F.min("commit_index").alias("introduced")),
        rf"with x as (select regexp_replace(regexp_replace(target, '^{SQL_BLANK}+', ''), '{SQL_BLANK}+\z', '') as t, commit_index from qna_pairs) select substr(t, 1, 12) as k, min(commit_index) as introduced from x where t <> '' group by 1",
    ),
    "j_priority_lookup": (
        _priority,
        r"""with p as (select distinct path from file_changes where path is not null), m as (select replace(regexp_replace(regexp_replace(path, '\.py$', ''), '(?:^|/)__init__$', ''), '/', '.') as module, min(path) as file from p where path like '%.py' group by 1),
        r as (select path, replace(regexp_replace(regexp_replace(regexp_replace(path, '\.js$', '.py'), '\.py$', ''), '(?:^|/)__init__$', ''), '/', '.') as k from p where regexp_matches(path, '\.(py|js)$'))
        select path, coalesce(a.file, b.file, e.file) as file from r left join m a on a.module = k left join m b on b.module = regexp_replace(k, '^src\.', '') left join m e on e.module = regexp_replace(k, '\.[^.]+$', '')""",
    ),
    "j_default_zero": (
        lambda s, d: commits(s, d).select("commit_sha").join(qna(s, d).groupBy("commit_sha").agg(F.count("*").alias("k")), "commit_sha", "left").select("commit_sha", F.coalesce("k", F.lit(0)).alias("n")),
        f"with {SQL_C}, {SQL_Q}, k as (select commit_sha, count(*) as k from q group by 1) select c.commit_sha, coalesce(k, 0) as n from c left join k using (commit_sha)",
    ),
    "j_in_all_methods": (lambda s, d: joins.in_all(scores(s, d), ["repo_id", "assertion_type"], "method", 3), f"with {SQL_Q}, {SQL_S} select repo_id, assertion_type from s group by 1, 2 having count(distinct method) = 3"),
    "j_wins_alone": (
        lambda s, d: joins.wins_alone(scores(s, d), ["repo_id", "assertion_type"], "method", "em", ["alpha"], ["beta"]),
        f"with {SQL_Q}, {SQL_S}, w as (select repo_id, assertion_type, max(case when method = 'alpha' then em end) as a, max(case when method = 'beta' then em end) as b from s group by 1, 2) select repo_id, assertion_type from w where a = 1 and b = 0",
    ),
    "j_positional": (
        lambda s, d: joins.positional(qna(s, d).groupBy("commit_sha").agg(F.array_sort(F.collect_list("qna_id")).alias("ids"), F.array_sort(F.collect_list("col_offset")).alias("cols")), ["ids", "cols"], ["commit_sha"]),
        f"""with {SQL_Q}, g as (select commit_sha, list_sort(list(qna_id)) as ids, list_sort(list(col_offset) filter (where col_offset is not null)) as cols from q group by 1)
        select commit_sha, cast(i - 1 as int) as position, ids[i] as ids, cols[i] as cols from (select *, unnest(range(1, len(ids) + 1)) as i from g)""",
    ),
    "j_anchor_range": (
        _anchor_range,
        f"""with {SQL_C}, a as (select repo_id, max(commit_index) as i from c where in_repo_split = 'train' group by 1)
        select p.repo_id, count(distinct (test_file, coalesce(test_function, ''), coalesce(md5(target), ''))) as n_pairs from qna_pairs p join a using (repo_id) where commit_index <= i group by 1""",
    ),
    "f_fork_chain": (
        lambda s, d: joins.chain_hits(table(s, d, "repo_links").where("link_kind in ('fork_of', 'renamed_to')"), "repo_id", "linked_repo_id", commits(s, d).where("cross_repo_split = 'train'").select("repo_id")),
        """with recursive l as (select distinct repo_id, linked_repo_id as p from repo_links where link_kind in ('fork_of', 'renamed_to')), r as (select repo_id, p from l union select r.repo_id, l.p from r join l on r.p = l.repo_id)
        select distinct repo_id from r where p in (select repo_id from commits where cross_repo_split = 'train')""",
    ),
    "j_late_fetch": (
        _late_fetch,
        f"""with {SQL_Q}, k as (select qna_id from q qualify row_number() over (partition by repo_id order by commit_index, qna_id) = 1)
        select distinct qna_id, cast(length(prefix) as int) as n_prefix, md5(target) as target_md5 from qna_pairs where qna_id in (select qna_id from k)""",
    ),
    "j_ordered_files": (
        _ordered_files,
        """with f as (select distinct repo_id, seq, path, new_blob from file_changes where path is not null and new_blob is not null)
        select repo_id, row_number() over (partition by repo_id order by seq, path, new_blob) - 1 as position, path, cast(length(text) as int) as size from f join blobs on blob_sha = new_blob""",
    ),
    "u_union_keys": (lambda s, d: commits(s, d).select("commit_sha").union(table(s, d, "snapshots").select("commit_sha")).distinct(), "select commit_sha from commits union select commit_sha from snapshots"),
    "u_union_all": (
        lambda s, d: commits(s, d).select("repo_id", "n_new_assertions").unionByName(table(s, d, "snapshots").select("repo_id", "n_added_assertions"), allowMissingColumns=True).groupBy("repo_id").agg(F.count("*").alias("n"), F.sum("n_added_assertions").alias("added")),
        f"with {SQL_C}, u as (select repo_id, null as a from c union all select repo_id, n_added_assertions from snapshots) select repo_id, count(*) as n, cast(sum(a) as bigint) as added from u group by 1",
    ),
    "u_intersection": (lambda s, d: commits(s, d).select("repo_id").intersect(table(s, d, "repo_links").select("repo_id")), "select repo_id from commits intersect select repo_id from repo_links"),
    "u_difference": (lambda s, d: commits(s, d).select("repo_id").subtract(table(s, d, "documents").select("repo_id")), "select repo_id from commits except select repo_id from documents"),
    "u_difference_all": (lambda s, d: table(s, d, "qna_pairs").select("commit_sha").exceptAll(commits(s, d).select("commit_sha")).groupBy("commit_sha").agg(F.count("*").alias("n")), f"with {SQL_C}, x as (select commit_sha from qna_pairs except all select commit_sha from c) select commit_sha, count(*) as n from x group by 1"),
    "u_priority_split": (
        lambda s, d: table(s, d, "snapshots").where("repo_id is not null and cross_repo_split is not null").groupBy("repo_id").agg(F.min_by("cross_repo_split", F.array_position(F.array(*map(F.lit, ("train", "cr_val", "cr_test", "ood_test"))), F.col("cross_repo_split"))).alias("split")),
        "select repo_id, arg_min(cross_repo_split, list_position(['train', 'cr_val', 'cr_test', 'ood_test'], cross_repo_split)) as split from snapshots where repo_id is not null and cross_repo_split is not null group by 1",
    ),
    "u_last_wins": (
        lambda s, d: windows.first_per_group(table(s, d, "file_changes").where("path is not null").select("repo_id", "path", "seq", "new_blob").distinct(), ["repo_id", "path"], [F.desc("seq"), "new_blob"]).select("repo_id", "path", "new_blob"),
        "with f as (select distinct repo_id, path, seq, new_blob from file_changes where path is not null) select repo_id, path, new_blob from f qualify row_number() over (partition by repo_id, path order by seq desc, new_blob) = 1",
    ),
}

QUERIES = {k: v[0] for k, v in PAIRS.items()}
ORACLE = {k: v[1] for k, v in PAIRS.items() if v[1]}
