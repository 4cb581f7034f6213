"""Queries over aggregations (2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import text
from braidwork.operators import ordering, stats
from braidwork.plans.base import SQL_C, SQL_Q, SQL_S, SQL_T, commits, qna, scores, texts
from braidwork.session import table

EDGES = [(0, "0"), (1, "1..4"), (5, "5..19"), (20, "20..49"), (50, ">=50")]
SQL_BUCKET = "case when {x} >= 50 then '>=50' when {x} >= 20 then '20..49' when {x} >= 5 then '5..19' when {x} >= 1 then '1..4' else '0' end"
SQL_DIST = "count(v) as n, min(v) as min, max(v) as max, round(avg(v), 6) as mean, median(v) as median, round(stddev_pop(v), 6) as std, round(quantile_cont(v, 0.1), 6) as p10, round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.75), 6) as p75, round(quantile_cont(v, 0.9), 6) as p90, round(quantile_cont(v, 0.95), 6) as p95, round(quantile_cont(v, 0.99), 6) as p99"
METRICS = "round(sum(em)::double / count(*), 6) as em, round(avg(es), 6) as es"


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def _dist(df, x, *groups):
    out = df.groupBy(*groups).agg(*stats.distribution(x, (10, 25, 75, 90, 95, 99)))
    return _rounded(out, "mean", "std", "p10", "p25", "p75", "p90", "p95", "p99")


def _means(df, *groups):
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("es"), 6).alias("es"))


def _per_repo(s, d):
    return scores(s, d).groupBy("repo_id", "cross_repo_split").agg(F.count("*").alias("n"), F.avg("em").alias("em"), F.avg("es").alias("es"), F.max("commit_index").alias("n_after"))


SQL_REPO = "r as (select repo_id, cross_repo_split, count(*) as n, avg(em) as em, avg(es) as es, max(commit_index) as n_after from s group by 1, 2)"


def _partial_then_final(s, d):
    shards = scores(s, d).groupBy("method", (F.col("qna_id") % 4).alias("shard")).agg(F.count("*").alias("n"), F.sum("em").alias("em"), F.sum("es").alias("es"))
    return shards.groupBy("method").agg(F.sum("n").alias("n"), F.round(F.sum("em") / F.sum("n"), 6).alias("em"), F.round(F.sum("es") / F.sum("n"), 6).alias("es"))


def _answers(s, d):
    """A stand-in prediction: the target of the question before it of the same type."""
    t = texts(s, d).where("target is not null")
    before = ordering.neighbours(table(s, d, "qna_pairs").where("target is not null").select("assertion_type", "qna_id").distinct(), ["assertion_type"], ["qna_id"], "qna_id")
    got = t.select(F.col("qna_id").alias("previous"), F.col("target").alias("got"))
    return t.join(before, "qna_id").join(got, "previous").drop("previous")


SQL_ANSWERS = f"{SQL_T}, w as (select *, lag(target) over (partition by assertion_type order by qna_id) as got from t where target is not null), a as (select * from w where got is not null)"


def _coverage(s, d):
    before, after = qna(s, d), qna(s, d).where("lineno % 5 > 0")
    sides = before.select("repo_id", "commit_sha", "test_file", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select("repo_id", "commit_sha", "test_file", F.lit(0).alias("a"), F.lit(1).alias("b")))
    count = lambda *k: sides.groupBy(*k).agg(F.max("a").alias("a"), F.max("b").alias("b")).agg(F.lit("+".join(k)).alias("key"), F.sum("a").alias("before"), F.sum("b").alias("after"))
    return count("repo_id").unionByName(count("repo_id", "commit_sha")).unionByName(count("repo_id", "commit_sha", "test_file"))


def _positions(s, d):
    files = table(s, d, "file_changes").where("path is not null").select("repo_id", "seq", "path").distinct()
    flagged = files.withColumn("t", text.is_test_path(F.col("path")).cast("int"))
    span = flagged.groupBy("repo_id").agg(F.min(F.when(F.col("t") == 1, F.col("seq"))).alias("first"), F.max(F.when(F.col("t") == 1, F.col("seq"))).alias("last"), F.count("*").alias("n"))
    inside = flagged.join(span, "repo_id").where("seq between first and last").groupBy("repo_id").agg(F.count("*").alias("inside"))
    return span.join(inside, "repo_id", "left").select("repo_id", "first", "last", F.round(F.coalesce("inside", F.lit(0)) / F.col("n"), 6).alias("share"))


def _exact_match(s, d):
    a = _answers(s, d)
    clean = text.cleaned_prediction(F.col("got"), F.col("target"))
    return a.groupBy("assertion_type").agg(F.count("*").alias("n"), F.sum(text.exact_match(clean, text.without_comment(F.col("target"))).cast("long")).alias("hits"))


PAIRS = {
    "a_value_counts": (lambda s, d: stats.value_counts(qna(s, d), "assertion_type"), f"with {SQL_Q} select assertion_type, count(*) as n from q group by 1 order by 2 desc, 1"),
    "a_top_repos": (lambda s, d: stats.value_counts(qna(s, d), "repo_id").limit(20), f"with {SQL_Q} select repo_id, count(*) as n from q group by 1 order by 2 desc, 1 limit 20"),
    "a_distribution": (lambda s, d: _dist(commits(s, d), F.col("n_new_assertions"), "cross_repo_split"), f"with {SQL_C} select cross_repo_split, {SQL_DIST} from (select cross_repo_split, n_new_assertions::double as v from c) group by 1"),
    "a_length_rollup": (
        lambda s, d: _dist(texts(s, d).select("in_repo_split", F.length("prefix").alias("v")).withColumn("split", F.explode(F.array("in_repo_split", F.lit("all")))), F.col("v"), "split"),
        f"with {SQL_T}, x as (select in_repo_split as split, length(prefix)::double as v from t union all select 'all', length(prefix) from t) select split, {SQL_DIST} from x group by 1",
    ),
    "a_rollup": (lambda s, d: qna(s, d).rollup("cross_repo_split", "in_repo_split").agg(F.count("*").alias("n")), f"with {SQL_Q} select cross_repo_split, in_repo_split, count(*) as n from q group by rollup(cross_repo_split, in_repo_split)"),
    "a_cube": (lambda s, d: qna(s, d).cube("cross_repo_split", "assertion_type").agg(F.count("*").alias("n")), f"with {SQL_Q} select cross_repo_split, assertion_type, count(*) as n from q group by cube(cross_repo_split, assertion_type)"),
    "a_floor_percentile": (
        lambda s, d: stats.floor_percentile(qna(s, d), "assertion_type", "lineno", (25, 50, 75, 90)),
        f"with {SQL_Q}, l as (select assertion_type, list_sort(list(lineno)) as v, count(*) as n from q group by 1) select assertion_type, v[least(n * 25 // 100, n - 1) + 1] as p25, v[least(n * 50 // 100, n - 1) + 1] as p50, v[least(n * 75 // 100, n - 1) + 1] as p75, v[least(n * 90 // 100, n - 1) + 1] as p90 from l",
    ),
    "a_counters": (
        lambda s, d: qna(s, d).groupBy("repo_id").agg(F.count("*").alias("n"), F.count_distinct("commit_sha").alias("commits"), F.count_distinct("test_file").alias("files"), F.sum((F.col("in_repo_split") == "train").cast("long")).alias("train"), F.sum(F.col("col_offset").isNull().cast("long")).alias("no_column")),
        f"with {SQL_Q} select repo_id, count(*) as n, count(distinct commit_sha) as commits, count(distinct test_file) as files, count(*) filter (where in_repo_split = 'train') as train, count(*) filter (where col_offset is null) as no_column from q group by 1",
    ),
    "a_added_and_modified": (
        lambda s, d: table(s, d, "snapshots").where("cross_repo_split is not null").groupBy("cross_repo_split").pivot("in_repo_split", ["train", "val", "test"]).agg(F.sum("n_added_assertions").alias("added"), F.sum("n_modified_assertions").alias("modified")),
        "select cross_repo_split, " + ", ".join(f"cast(sum(n_{k}_assertions) filter (where in_repo_split = '{p}') as bigint) as {p}_{k}" for p in ("train", "val", "test") for k in ("added", "modified")) + " from snapshots where cross_repo_split is not null group by 1",
    ),
    "a_distinct_per_commit": (
        lambda s, d: qna(s, d).groupBy("repo_id", "commit_index").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("test_file") != "", F.col("test_file"))).alias("files"), F.count_distinct("test_function").alias("functions"), F.count_distinct("assertion_type").alias("types")),
        f"with {SQL_Q} select repo_id, commit_index, count(*) as n, count(distinct nullif(test_file, '')) as files, count(distinct test_function) as functions, count(distinct assertion_type) as types from q group by 1, 2",
    ),
    "a_cap_grid": (
        lambda s, d: stats.cap_grid(qna(s, d), ["repo_id", "commit_sha"], "test_file", [1, 2, 4, 8]),
        f"""with {SQL_Q}, f as (select repo_id, commit_sha, test_file, count(*) as n from q group by all), g as (select unnest([1, 2, 4, 8]) as cap),
        c as (select repo_id, commit_sha, cap, sum(n) as n, sum(least(n, cap)) as b from f cross join g group by all)
        select cap, cast(sum(least(n, cap)) as bigint) as kept_per_commit, cast(sum(b) as bigint) as kept_per_file, cast(sum(least(b, cap * 2)) as bigint) as kept_both from c group by 1""",
    ),
    "a_commit_means": (lambda s, d: _means(scores(s, d), "repo_id", "commit_sha"), f"with {SQL_Q}, {SQL_S} select repo_id, commit_sha, count(*) as n, {METRICS} from s group by 1, 2"),
    "a_partial_then_final": (_partial_then_final, f"with {SQL_Q}, {SQL_S} select method, count(*) as n, {METRICS} from s group by 1"),
    "a_weighted_mean": (
        lambda s, d: _rounded(_per_repo(s, d).groupBy("cross_repo_split").agg(stats.weighted_mean("em", "n").alias("em"), stats.weighted_mean("es", "n").alias("es")), "em", "es"),
        f"with {SQL_Q}, {SQL_S}, {SQL_REPO} select cross_repo_split, round(sum(n * em) / sum(n), 6) as em, round(sum(n * es) / sum(n), 6) as es from r group by 1",
    ),
    "a_bucket_means": (
        lambda s, d: _rounded(stats.bucket_means(_per_repo(s, d), "n_after", EDGES, ["em", "es"], "n", "repo_id"), "em", "es"),
        f"with {SQL_Q}, {SQL_S}, {SQL_REPO} select {SQL_BUCKET.format(x='n_after')} as bucket, cast(sum(n) as bigint) as n_pairs, count(*) as n_rows, count(distinct repo_id) as n_repos, round(sum(n * em) / sum(n), 6) as em, round(sum(n * es) / sum(n), 6) as es from r group by 1",
    ),
    "a_closed_bins": (
        lambda s, d: _rounded(stats.closed_bins(_per_repo(s, d), "es", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0], ["em"], "n", "repo_id"), "em"),
        f"""with {SQL_Q}, {SQL_S}, {SQL_REPO}, b as (select * from (values (0.0::double, 0.25::double, false), (0.25, 0.5, false), (0.5, 0.75, false), (0.75, 0.9, false), (0.9, 1.0, true)) v(lo, hi, final))
        select lo, hi, count(n) as n_rows, cast(coalesce(sum(n), 0) as bigint) as n_assertions, count(distinct repo_id) as n_repos, round(sum(n * em) / sum(n), 6) as em from b left join r on es >= lo and (es < hi or final and es = hi) group by 1, 2""",
    ),
    "a_method_summary": (
        lambda s, d: scores(s, d).groupBy("method").agg(F.count("*").alias("n_qnas"), F.count_distinct("repo_id").alias("n_repos"), F.count_distinct("repo_id", "commit_sha").alias("n_commits"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("es"), 6).alias("es")),
        f"with {SQL_Q}, {SQL_S} select method, count(*) as n_qnas, count(distinct repo_id) as n_repos, count(distinct (repo_id, commit_sha)) as n_commits, {METRICS} from s group by 1",
    ),
    "a_per_type": (lambda s, d: _means(scores(s, d), "assertion_type"), f"with {SQL_Q}, {SQL_S} select assertion_type, count(*) as n, {METRICS} from s group by 1"),
    "a_assertion_styles": (
        lambda s, d: texts(s, d).groupBy(text.assertion_style(F.col("prefix")).alias("style")).agg(F.count("*").alias("n")),
        rf"with {SQL_T}, x as (select string_split(regexp_replace(prefix, '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}]+\z', ''), chr(10))[-1] as l from t) select case when contains(l, 'self.assert') or contains(l, 'self.Assert') then 'self.assert*' when contains(l, 'pytest.') then 'pytest.*' else 'assert' end as style, count(*) as n from x group by 1",
    ),
    "a_linear_fit": (
        lambda s, d: _rounded(_per_repo(s, d).groupBy("cross_repo_split").agg(*stats.linear_fit("n", "es")), "slope", "intercept"),
        f"with {SQL_Q}, {SQL_S}, {SQL_REPO} select cross_repo_split, round(case when coalesce(var_pop(n), 0) = 0 then 0 else regr_slope(es, n) end, 6) as slope, round(case when coalesce(var_pop(n), 0) = 0 then avg(es) else regr_intercept(es, n) end, 6) as intercept from r group by 1",
    ),
    "a_log_fit": (
        lambda s, d: _rounded(_per_repo(s, d).groupBy("cross_repo_split").agg(*stats.log_fit("n", "es")), "a", "b", "r2", digits=5),
        f"with {SQL_Q}, {SQL_S}, {SQL_REPO} select cross_repo_split, round(regr_slope(es, ln(n)), 5) as a, round(regr_intercept(es, ln(n)), 5) as b, round(regr_r2(es, ln(n)), 5) as r2 from r where n > 0 group by 1",
    ),
    "a_cutoff_medians": (
        lambda s, d: _rounded(_per_repo(s, d).groupBy((F.col("n") >= 50).alias("large")).agg(F.percentile("es", 0.5).alias("median_es"), F.count("*").alias("k")), "median_es"),
        f"with {SQL_Q}, {SQL_S}, {SQL_REPO} select n >= 50 as large, round(median(es), 6) as median_es, count(*) as k from r group by 1",
    ),
    "a_coverage": (
        _coverage,
        f"""with {SQL_Q}, b as (select * from q where lineno % 5 > 0)
        select 'repo_id' as key, (select count(distinct repo_id) from q) as before, (select count(distinct repo_id) from b) as after
        union all select 'repo_id+commit_sha', (select count(distinct (repo_id, commit_sha)) from q), (select count(distinct (repo_id, commit_sha)) from b)
        union all select 'repo_id+commit_sha+test_file', (select count(distinct (repo_id, commit_sha, test_file)) from q), (select count(distinct (repo_id, commit_sha, test_file)) from b)""",
    ),
    "a_flag_positions": (
        _positions,
        """with f as (select distinct repo_id, seq, path, contains(lower(path), 'test') as t from file_changes where path is not null), p as (select repo_id, min(seq) filter (where t) as first, max(seq) filter (where t) as last, count(*) as n from f group by 1)
        select p.repo_id, first, last, round(count(f.seq)::double / n, 6) as share from p left join f on f.repo_id = p.repo_id and f.seq between first and last group by p.repo_id, first, last, n""",
    ),
    "a_union_counts": (
        lambda s, d: qna(s, d).select("repo_id", "commit_sha", F.lit(0).alias("o"), F.lit("qna").alias("label")).unionByName(table(s, d, "snapshots").where("repo_id is not null").select("repo_id", "commit_sha", F.lit(1).alias("o"), F.lit("snapshots").alias("label"))).groupBy("repo_id", "commit_sha").agg(F.count("*").alias("n"), F.min_by("label", "o").alias("label")),
        f"with {SQL_Q}, u as (select repo_id, commit_sha, 0 as o, 'qna' as label from q union all select repo_id, commit_sha, 1, 'snapshots' from snapshots where repo_id is not null) select repo_id, commit_sha, count(*) as n, arg_min(label, o) as label from u group by 1, 2",
    ),
    "a_roles": (
        lambda s, d: qna(s, d).groupBy("cross_repo_split", "in_repo_split").agg(F.count("*").alias("n"), F.count_distinct("repo_id").alias("n_repos"), F.count_distinct("repo_id", "commit_sha").alias("n_commits")),
        f"with {SQL_Q} select cross_repo_split, in_repo_split, count(*) as n, count(distinct repo_id) as n_repos, count(distinct (repo_id, commit_sha)) as n_commits from q group by 1, 2",
    ),
    "a_duplicate_rate": (
        lambda s, d: table(s, d, "qna_pairs").select("qna_id", "cross_repo_split", F.md5("prefix").alias("p"), F.md5("target").alias("t")).distinct().groupBy("cross_repo_split").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(F.struct("p", F.coalesce("t", F.lit(""))))).alias("repeats")),
        "with x as (select distinct qna_id, cross_repo_split, md5(prefix) as p, md5(target) as t from qna_pairs) select cross_repo_split, count(*) as n, count(*) - count(distinct (p, coalesce(t, ''))) as repeats from x group by 1",
    ),
    "a_method_by_suite": (
        lambda s, d: scores(s, d).groupBy("method").pivot("cross_repo_split", ["train", "cr_val", "cr_test", "ood_test"]).agg(F.round(F.avg("es"), 6)),
        f"with {SQL_Q}, {SQL_S} select method, " + ", ".join(f"round(avg(es) filter (where cross_repo_split = '{p}'), 6) as {p}" for p in ("train", "cr_val", "cr_test", "ood_test")) + " from s group by 1",
    ),
    "a_median_per_method": (
        lambda s, d: _rounded(scores(s, d).groupBy("method", "repo_id").agg(F.avg("em").alias("em")).groupBy("method").agg(F.percentile("em", 0.5).alias("median_em")), "median_em"),
        f"with {SQL_Q}, {SQL_S}, r as (select method, repo_id, avg(em) as em from s group by 1, 2) select method, round(median(em), 6) as median_em from r group by 1",
    ),
    "a_pair_statistics": (
        lambda s, d: texts(s, d).groupBy("assertion_type").agg(F.count("*").alias("n"), F.round(F.avg(F.length("prefix")), 4).alias("mean_chars"), F.round(F.avg(text.n_lines(F.col("prefix"))), 4).alias("mean_breaks"), F.round(F.avg(F.col("prefix").contains("import ").cast("int")), 6).alias("import_share"), F.max(text.token_estimate(F.col("prefix"))).alias("most_tokens")),
        f"with {SQL_T} select assertion_type, count(*) as n, round(avg(length(prefix)), 4) as mean_chars, round(avg(length(prefix) - length(replace(prefix, chr(10), ''))), 4) as mean_breaks, round(avg(contains(prefix, 'import ')::int), 6) as import_share, max(length(prefix) // 4) as most_tokens from t group by 1",
    ),
    "a_bootstrap": (lambda s, d: stats.bootstrap_interval(scores(s, d), "method", "es"), None),
    "a_cluster_bootstrap": (lambda s, d: stats.cluster_bootstrap(_per_repo(s, d), "cross_repo_split", "repo_id", "es", "n"), None),
    "a_plain_sql": (
        lambda s, d: (commits(s, d).createOrReplaceTempView("_commits_once"), s.sql("select cross_repo_split, count(*) as n, count(distinct repo_id) as repos, max(commit_index) as deepest from _commits_once group by cross_repo_split having count(*) > 1"))[1],
        f"with {SQL_C} select cross_repo_split, count(*) as n, count(distinct repo_id) as repos, max(commit_index) as deepest from c group by 1 having count(*) > 1",
    ),
}

QUERIES = {k: v[0] for k, v in PAIRS.items()}
ORACLE = {k: v[1] for k, v in PAIRS.items() if v[1]}
