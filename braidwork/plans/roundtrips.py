"""Queries over readers and writers (2.1): what is written to the shared folder and read again equals its source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from braidwork.operators import extraction, ordering
from braidwork.plans.base import SQL_C, SQL_Q, commits, qna
from braidwork.session import checkpoint_root, table
from braidwork.sources import history, readers, sinks


def _folder(s) -> str:
    return f"{checkpoint_root(s)}/roundtrip-{uuid.uuid4().hex}"


def _tables(s, d):
    where = _folder(s)
    sinks.write_tables(commits(s, d).select("repo_id", "commit_sha", "commit_index", "cross_repo_split"), where)
    return readers.scan(s.read.parquet(where), ["repo_id", "commit_sha", "commit_index"], cross_repo_split="train")


def _layout(s, d):
    where = _folder(s)
    commits(s, d).select("repo_id", "commit_sha").write.parquet(f"{where}/commits")
    qna(s, d).select("qna_id", "repo_id", "commit_sha").write.parquet(f"{where}/qna")
    left, right = readers.load_tables(s, where)
    return right.groupBy("repo_id", "task").agg(F.count("*").alias("n")).join(left.groupBy("repo_id").agg(F.count("*").alias("n_commits")), "repo_id")


def _concat(s, d):
    where = _folder(s)
    c = commits(s, d).select("repo_id", "commit_sha", "commit_index")
    for k in range(2):
        c.where(F.col("commit_index") % 2 == k).write.parquet(f"{where}/shard{k}")
    sinks.concat_shards(s, [f"{where}/shard0", f"{where}/shard1"], f"{where}/whole", 3)
    return s.read.parquet(f"{where}/whole")


def _replaced(s, d):
    where = _folder(s)
    c = commits(s, d).where("cross_repo_split is not null").select("commit_sha", "cross_repo_split", F.lit(0).alias("turn"))
    sinks.replace_partitions(c, where, ["cross_repo_split"])
    sinks.replace_partitions(c.where("cross_repo_split = 'train'").withColumn("turn", F.lit(1)), where, ["cross_repo_split"])
    return s.read.parquet(where).groupBy("cross_repo_split", "turn").agg(F.count("*").alias("n"))


def _upserted(s, d):
    base = commits(s, d).select("commit_sha", "commit_index", F.lit(0).alias("turn"))
    return sinks.upserted(base, base.where("commit_index % 2 = 0").withColumn("turn", F.lit(1)), ["commit_sha"])


def _sqlite(s, d):
    where = _folder(s)
    base = commits(s, d).select("commit_sha", "repo_id", "commit_index", F.lit(0).alias("turn"))
    sinks_done = [history.write_sqlite(rows, where, "commits", ["commit_sha"]) for rows in (base, base.where("commit_index % 2 = 0").withColumn("turn", F.lit(1)))]
    assert len(sinks_done) == 2
    return history.read_sqlite(s, readers._paths(s, f"{where}/*.sqlite"), "select distinct repo_id, commit_index, commit_sha, turn from commits where commit_index > 0 order by repo_id, commit_index", "repo_id string, commit_index int, commit_sha string, turn int")


def _manifest(s, d):
    where = _folder(s)
    rows = commits(s, d).select("repo_id", "commit_sha", "commit_index", F.col("in_repo_split").alias("role"), F.lit("").alias("anchor_sha"), F.lit(-1).alias("anchor_index"), F.lit(0).alias("n_commits_after_anchor"))
    sinks.write_manifest(rows, where)
    return readers.read_manifest(s, where).select("repo_id", "commit_sha", "commit_index", "role", "anchor_index")


def _pairs(s, d):
    rows = table(s, d, "qna_pairs").select("qna_id", "repo_id", "prefix", "target", "assertion_type", F.lit("").alias("difficulty"), F.lit(0).alias("context_lines")).dropDuplicates(["qna_id"])
    return ordering.positions(rows, ["repo_id"], ["qna_id"])


def _split_files(s, d):
    where = _folder(s)
    sinks.write_split_files(_pairs(s, d), where)
    rows = readers.read_split_file(s, where, a_line_each=True)
    return rows.groupBy("repo_id", "assertion_type").agg(F.count("*").alias("n"), F.sum(F.length("prefix")).alias("n_chars"))


def _bench_file(s, d):
    where = _folder(s)
    sinks.write_split_files(_pairs(s, d), where)
    return readers.read_bench(s, where, 5, 12, a_line_each=True).select("repo_id", "rank", F.md5("prefix").alias("prefix_md5"))


def _bench(s, d):
    return readers.ordered_bench(table(s, d, "qna_pairs").select("repo_id", "commit_index", "qna_id", "prefix", "target"), 20, 10).select("repo_id", "rank", "qna_id")


def _lines(s, d):
    where = _folder(s)
    rows = commits(s, d).groupBy("repo_id").agg(F.count("*").cast("int").alias("stars"), F.max("commit_index").alias("size_kb")).withColumnRenamed("repo_id", "full_name")
    sinks.append_lines(rows.where("stars % 2 = 0"), where)
    sinks.append_lines(rows.where("stars % 2 = 1"), where)
    return readers.read_mined(s, where).select("full_name", "stars", "size_kb", F.col("language").isNull().alias("no_language"))


def _csv(s, d):
    where = _folder(s)
    sinks.write_csv(qna(s, d).select("qna_id", "test_file", "lineno"), where)
    return s.read.csv(where, header=True, schema="qna_id long, test_file string, lineno int")


def _id_list(s, d):
    where = _folder(s)
    line = F.explode(F.array(F.col("repo_id"), F.concat(F.lit("# "), F.col("repo_id")), F.lit("  "))).alias("value")
    commits(s, d).select("repo_id").distinct().select(line).write.text(where)
    return readers.read_id_list(s, where)


def _log(s, d):
    where = _folder(s)
    changes = table(s, d, "file_changes").where("commit_sha is not null and path is not null").select("commit_sha", "parent_sha", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "status", "path", "old_path").distinct()
    history.write_log(changes, where)
    return history.read_log(s, where).select("commit_sha", "parent_sha", "ts", "status", "path", "old_path")


def _tree(s, d):
    where = _folder(s)
    sizes = table(s, d, "blobs").where("text is not null").select("blob_sha", F.octet_length("text").alias("size"))
    files = table(s, d, "file_changes").where("path is not null").select("path", F.col("new_blob").alias("blob_sha")).distinct().join(sizes, "blob_sha")
    files.select(history.tree_lines(files).alias("value")).write.text(where)
    return history.read_tree(s, where, most_bytes=2000, ending=".py").select("blob_sha", "size", "path")


def _dumps(s, d):
    where = _folder(s)
    history.write_blob_dumps(table(s, d, "blobs"), where)
    return history.read_blob_dumps(s, where).select("blob_sha", F.md5("text").alias("text_md5"))


def _numstat(s, d):
    rows = table(s, d, "file_changes").where("path is not null and commit_sha is not null").select("commit_sha", "path", (F.length("path") % 50).alias("a")).distinct()
    report = rows.select(F.concat_ws("\n", "commit_sha", F.concat_ws("\t", F.col("a").cast("string"), F.lit("-"), "path")).alias("report"), "commit_sha")
    found = extraction.exploded(report, ["commit_sha"], "report", extraction.numstat_lines, "sha string, added int, deleted int, path string")
    return found.select("sha", "added", "deleted", "path")


def _blame(s, d):
    rows = qna(s, d).where("commit_sha is not null").select("qna_id", F.concat("commit_sha", F.lit(" 1 "), F.col("lineno").cast("string"), F.lit(" 1\nauthor a\n\tcode")).alias("report"))
    return extraction.exploded(rows, ["qna_id"], "report", extraction.blame_lines, "lineno int, sha string")


def _lazy(s, d):
    name, rows = next(readers.repositories(qna(s, d)))
    return rows.select(F.lit(name).alias("repo_id"), "qna_id")


PAIRS = {
    "k_tables": (_tables, f"with {SQL_C} select repo_id, commit_sha, commit_index from c where cross_repo_split = 'train'"),
    "k_layout": (_layout, f"with {SQL_C}, {SQL_Q}, n as (select repo_id, count(*) as n_commits from c group by 1), m as (select repo_id, count(*) as n from q group by 1) select repo_id, 'assert_rhs' as task, n, n_commits from m join n using (repo_id)"),
    "k_concat_shards": (_concat, f"with {SQL_C} select repo_id, commit_sha, commit_index from c"),
    "k_replaced_partitions": (_replaced, f"with {SQL_C} select cross_repo_split, case when cross_repo_split = 'train' then 1 else 0 end as turn, count(*) as n from c where cross_repo_split is not null group by 1, 2"),
    "k_upserted": (_upserted, f"with {SQL_C} select commit_sha, commit_index, case when commit_index % 2 = 0 then 1 else 0 end as turn from c"),
    "s_sqlite": (_sqlite, f"with {SQL_C} select repo_id, commit_index, commit_sha, case when commit_index % 2 = 0 then 1 else 0 end as turn from c where commit_index > 0"),
    "k_manifest": (_manifest, f"with {SQL_C} select repo_id, commit_sha, commit_index, in_repo_split as role, -1 as anchor_index from c"),
    "k_split_files": (
        _split_files,
        r"with t as (select qna_id, any_value(repo_id) as repo_id, any_value(prefix) as prefix, any_value(target) as target, any_value(assertion_type) as assertion_type from qna_pairs group by 1) select repo_id, assertion_type, count(*) as n, cast(sum(length(prefix)) as bigint) as n_chars from t where length(prefix) > 0 and length(target) > 0 and not regexp_matches(target, '^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*,') group by 1, 2",
    ),
    "s_bench": (
        _bench,
        """with k as (select repo_id, prefix, coalesce(target, '') as t, min((commit_index, qna_id)) as k from qna_pairs group by all), r as (select distinct repo_id from qna_pairs order by 1 limit 10),
        n as (select repo_id, k[2] as qna_id, cast(row_number() over (partition by repo_id order by k) as int) as rank from k where repo_id in (select repo_id from r)) select repo_id, rank, qna_id from n where rank <= 20""",
    ),
    "s_bench_file": (
        _bench_file,
        r"""with t as (select qna_id, any_value(repo_id) as repo_id, any_value(prefix) as prefix, any_value(target) as target from qna_pairs group by 1),
        v as (select * from t where length(prefix) > 0 and length(target) > 0 and not regexp_matches(target, '^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*,')), r as (select distinct repo_id from v order by 1 limit 12)
        select repo_id, cast(row_number() over (partition by repo_id order by qna_id) as int) as rank, md5(prefix) as prefix_md5 from v where repo_id in (select repo_id from r) qualify rank <= 5""",
    ),
    "k_lines": (_lines, f"with {SQL_C} select repo_id as full_name, cast(count(*) as int) as stars, max(commit_index) as size_kb, true as no_language from c group by 1"),
    "k_csv": (_csv, f"with {SQL_Q} select qna_id, test_file, lineno from q"),
    "k_registry": (
        lambda s, d: sinks.registry_view(table(s, d, "file_changes").where("path is not null").select("repo_id", "path", "seq", "status").distinct().withColumn("fingerprint", F.sha2(F.concat_ws("/", "repo_id", "path"), 256)), "fingerprint", "seq").select("repo_id", "path", "seq"),
        "select repo_id, path, max(seq) as seq from file_changes where path is not null group by 1, 2",
    ),
    "k_provenance": (lambda s, d: sinks.provenance(table(s, d, "blobs").where("text is not null").select(F.col("blob_sha").alias("path"), F.encode("text", "UTF-8").alias("content"))), "select blob_sha as path, sha256(text) as sha256 from blobs where text is not null"),
    "s_id_list": (_id_list, "select distinct repo_id from commits"),
    "s_git_log": (_log, "select distinct commit_sha, parent_sha, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, status, path, old_path from file_changes where commit_sha is not null and path is not null"),
    "s_git_tree": (_tree, "select distinct blob_sha, octet_length(encode(text)) as size, path from file_changes join blobs on blob_sha = new_blob where path like '%.py' and octet_length(encode(text)) <= 2000"),
    "s_git_blobs": (_dumps, "select blob_sha, md5(text) as text_md5 from blobs where text is not null"),
    "s_git_numstat": (_numstat, "select distinct commit_sha as sha, cast(length(path) % 50 as int) as added, 0 as deleted, path from file_changes where path is not null and commit_sha is not null"),
    "e_blame": (_blame, f"with {SQL_Q} select qna_id, lineno, commit_sha as sha from q where commit_sha is not null"),
    "s_lazy_repositories": (_lazy, f"with {SQL_Q} select repo_id, qna_id from q where repo_id = (select min(repo_id) from q)"),
}

QUERIES = {k: v[0] for k, v in PAIRS.items()}
ORACLE = {k: v[1] for k, v in PAIRS.items() if v[1]}
