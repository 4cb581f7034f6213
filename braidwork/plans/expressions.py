"""Queries over scalar functions (2.8), vectors, retrieval (2.9), extraction (2.10) and state (2.11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwork.functions import scores as score_functions
from braidwork.functions import text, vectors
from braidwork.operators import extraction, geometry, retrieval
from braidwork.plans.base import SQL_C, SQL_Q, SQL_T, commits, qna, texts
from braidwork.plans.summaries import _answers
from braidwork.session import table
from braidwork.streaming import stateful

B = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x):
    return rf"regexp_replace(regexp_replace({x}, '^{B}+', ''), '{B}+\z', '')"


def sql_collapse(x):
    return rf"trim(regexp_replace({x}, '{B}+', ' ', 'g'), ' ')"


SQL_MATCH = sql_collapse("replace(replace(regexp_replace(" + sql_strip("target") + r", '[:, \t]+\z', ''), ', ', ','), ' ,', ',')")
SQL_TOKENS = "regexp_extract_all(lower({0}), '[a-zA-Z_][a-zA-Z0-9_]*|\\d+')"


def _bm25_sides(s, d):
    return table(s, d, "documents").where("text is not null"), table(s, d, "heldout_items").where("item_id % 20 = 0"), "doc_id", "item_id"


def _bm25(s, d, k=10):
    best = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    found = retrieval.bm25_scores(*_bm25_sides(s, d)).withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)
    return found.select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def _bm25_pruned(s, d, k=10):
    return retrieval.bm25_top_k(*_bm25_sides(s, d), k).select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


SQL_BM25 = f"""with d as (select doc_id, {SQL_TOKENS.format('text')} as t from documents where text is not null), n as (select count(*) as n, avg(len(t)) as avgdl from d),
    p as (select doc_id, len(t) as dl, unnest(t) as term from d), f as (select doc_id, dl, term, count(*) as tf from p group by all), df as (select term, count(*) as df from f group by 1),
    q as (select item_id, unnest({SQL_TOKENS.format('text')}) as term from heldout_items where item_id % 20 = 0), g as (select item_id, term, count(*) as qf from q group by all),
    s as (select item_id, doc_id, sum(qf * ln((n.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from g join f using (term) join df using (term) cross join n group by 1, 2)
    select item_id, doc_id, round(score, 4) as score, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) - 1 as rank from s qualify rank < 10"""


def _dense(s, d):
    e = table(s, d, "embeddings")
    return retrieval.dense_top_k(e, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding", 10)


SQL_DENSE = """with q as (select vec_id as query_id, embedding as v from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id, list_dot_product(v::double[], embedding::double[]) / sqrt(list_dot_product(v::double[], v::double[]) * list_dot_product(embedding::double[], embedding::double[])) as c from q, embeddings where query_id <> vec_id)
    select query_id, vec_id, round(c, 6) as cosine, cast(row_number() over (partition by query_id order by round(c, 9) desc, vec_id) as int) as rank from s qualify rank <= 10"""


def _fused(s, d):
    dense = _dense(s, d).select("query_id", "vec_id", (F.col("rank") - 1).alias("rank"))
    label = table(s, d, "embeddings").select("vec_id", "label")
    by_label = dense.join(label, "vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("label", "vec_id")) - 1).select("query_id", "vec_id", "rank")
    return retrieval.fused([dense, by_label], "query_id", "vec_id", 5).select("query_id", "vec_id", F.round("score", 9).alias("score"), "rank")


SQL_FUSED = f"""with x as ({SQL_DENSE}), y as (select query_id, vec_id, row_number() over (partition by query_id order by label, vec_id) as r from x join embeddings using (vec_id)),
    u as (select query_id, vec_id, 1.0::double / (60 + rank) as s from x union all select query_id, vec_id, 1.0::double / (60 + r) from y), z as (select query_id, vec_id, sum(s) as score from u group by 1, 2)
    select query_id, vec_id, round(score, 9) as score, cast(row_number() over (partition by query_id order by round(score, 12) desc, vec_id) - 1 as int) as rank from z qualify rank < 5"""


def _packed(s, d):
    t = table(s, d, "documents").where("text is not null and repo_id is not null")
    return retrieval.packed_context(t.select("repo_id", F.col("doc_id").alias("block_id"), (F.col("doc_id") % 7).cast("double").alias("score"), F.length("text").alias("full_size"), (F.length("text") / 4).cast("long").alias("short_size")), "repo_id", 2000)


def _file_weights(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("label").alias("g"), vectors.unit(F.col("embedding")).alias("v"))
    mean = vectors.pooled(e, "g", "v").withColumnRenamed("pooled", "m")
    odd = e.join(mean, "g").withColumn("score", F.lit(1.0) - vectors.cosine(F.col("v"), F.col("m")))
    return vectors.softmax_weights(odd, "g", "score", 0.1).select("vec_id", F.round("weight", 8).alias("weight"))


SQL_WEIGHTS = """with e as (select vec_id, label as g, list_transform(embedding::double[], lambda x: x / (sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-12)) as v from embeddings),
    c as (select g, i, avg(v[i]) as m from e, range(1, 65) r(i) group by 1, 2), m as (select g, list(m order by i) as m from c group by 1),
    s as (select vec_id, g, 1 - list_dot_product(v, m) / sqrt(list_dot_product(v, v) * list_dot_product(m, m)) as score from e join m using (g)),
    x as (select *, exp((score - max(score) over (partition by g)) / 0.1) as ex from s) select vec_id, round(ex / sum(ex) over (partition by g), 8) as weight from x"""


def _pooled(how):
    def run(s, d):
        p = vectors.pooled(table(s, d, "embeddings"), "label", "embedding", how)
        return p.select("label", F.posexplode("pooled").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))

    return run


def _sql_pooled(parts):
    both = [f"select label, cast(i - 1 + {64 * n} as int) as pos, round({f}(embedding[i]::double), 6) as x from embeddings, range(1, 65) r(i) group by label, i" for n, f in enumerate(parts)]
    return " union all ".join(both)


def _windows_of(documents):
    ids = F.sequence(F.lit(1), F.length("text"))
    w = documents.where("length(text) > 0").select("doc_id", vectors.token_windows(ids, 100, 20).alias("w"))
    return w.select("doc_id", F.posexplode("w").alias("i", "w")).select("doc_id", "i", F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"))


def _windows(s, d):
    return _windows_of(table(s, d, "documents"))


def _extracted(s, d):
    """Round trip: a prefix and its target make a source whose last assertion is the pair itself."""
    sources = texts(s, d).where("target is not null").select("qna_id", F.col("target").alias("stored"), F.concat("prefix", "target").alias("text"))
    found = extraction.source_assertions(sources, ["qna_id"])
    same = sources.join(found, "qna_id").where(F.col("target") == text.strip(F.col("stored")))
    return same.groupBy("assertion_type").agg(F.count("*").alias("n"))


def _changes_with_keys(s, d):
    """File versions with a key for every definition in them."""
    from pyspark.sql.types import ArrayType, LongType

    @F.pandas_udf(ArrayType(LongType()))
    def keys(source):
        import xxhash

        return source.map(lambda t: None if t is None else sorted({xxhash.xxh64_intdigest(f"{n}\0{' '.join(c.split())}") - (1 << 63) for n, c in extraction.chunks("", t)}))

    known = table(s, d, "blobs").select(F.col("blob_sha").alias("new_blob"), keys("text").alias("keys"))
    changes = table(s, d, "file_changes").select("repo_id", "seq", "status", "path", "old_path", "new_blob").distinct()
    return changes.join(known, "new_blob", "left").drop("new_blob")



def _metrics(s, d):
    a = _answers(s, d)
    clean, ref = text.cleaned_prediction(F.col("got"), F.col("target")), text.without_comment(F.col("target"))
    scored = a.select("assertion_type", clean.alias("p"), ref.alias("r")).withColumn("es", score_functions.edit_similarity("p", "r")).withColumn("cb", score_functions.code_bleu("p", "r")).withColumn("em", text.exact_match(F.col("p"), F.col("r")).cast("int"))
    return scored.groupBy("assertion_type").agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("es"), 6).alias("es"), F.round(F.avg("cb"), 6).alias("cb"))


PAIRS = {
    "x_collapsed": (lambda s, d: texts(s, d).select("qna_id", F.md5(text.collapse(F.col("prefix"))).alias("m"), F.md5(text.one_line(F.col("target"))).alias("o")), f"with {SQL_T} select qna_id, md5({sql_collapse('prefix')}) as m, md5(case when contains(target, chr(10)) then {sql_collapse('target')} else target end) as o from t"),
    "x_match_form": (lambda s, d: texts(s, d).where("target is not null").select("qna_id", text.match_form(F.col("target")).alias("f")), f"with {SQL_T} select qna_id, {SQL_MATCH} as f from t where target is not null"),
    "x_comments": (lambda s, d: texts(s, d).where("target is not null").select("qna_id", text.without_comment(F.col("target")).alias("f")), f"with {SQL_T} select qna_id, " + sql_strip("string_split(target, '#')[1]") + " as f from t where target is not null"),
    "x_search_tokens": (lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.size(text.search_tokens(F.col("text"))).alias("n")), f"select doc_id, cast(len({SQL_TOKENS.format('text')}) as int) as n from documents where text is not null"),
    "x_frameworks": (
        lambda s, d: table(s, d, "blobs").groupBy(text.framework(F.col("text")).alias("framework"), F.array_join(text.test_tags(F.col("text")), ",").alias("tags")).agg(F.count("*").alias("n")),
        """with b as (select lower(text) as l from blobs), u as (select l, contains(l, 'import unittest') or contains(l, 'from unittest') or contains(l, 'unittest.') as u, contains(l, 'import pytest') or contains(l, 'from pytest') or contains(l, 'pytest.') as p from b)
        select case when u and p then 'mixed' when u then 'unittest' when p then 'pytest' else 'unknown' end as framework, concat_ws(',', case when contains(l, 'class ') then 'class_based' end, case when contains(l, 'unittest') then 'unittest_class' end,
        case when contains(l, 'mock') or contains(l, 'patch(') then 'mock' end, case when contains(l, '@pytest.fixture') then 'fixture_based' end, case when contains(l, 'parametrize') then 'parametrized' end, case when contains(l, 'async def ') or contains(l, 'pytest.mark.asyncio') then 'async' end) as tags, count(*) as n from u group by 1, 2""",
    ),
    "x_sizes": (
        lambda s, d: texts(s, d).select("qna_id", text.n_lines(F.col("prefix")).alias("breaks"), text.token_estimate(F.col("prefix")).cast("long").alias("quarter"), F.md5(text.last_chars(F.col("prefix"), 80)).alias("tail"), F.md5(text.shortened(F.col("prefix"), 50)).alias("short"), F.md5(text.last_lines(F.col("prefix"), 2)).alias("lines")),
        f"with {SQL_T} select qna_id, cast(length(prefix) - length(replace(prefix, chr(10), '')) as int) as breaks, length(prefix) // 4 as quarter, md5(right(prefix, 80)) as tail, md5(case when length(prefix) > 50 then left(prefix, 50) || '...' else prefix end) as short, md5(array_to_string(string_split(prefix, chr(10))[-2:], chr(10))) as lines from t",
    ),
    "x_names": (
        lambda s, d: table(s, d, "file_changes").where("path is not null").select("repo_id", "path").distinct().select("repo_id", "path", text.slug(F.col("path")).alias("slug"), text.dotted_module(F.col("path")).alias("module"), text.unslug(text.slug(F.col("repo_id"))).alias("back")),
        r"with p as (select distinct repo_id, path from file_changes where path is not null) select repo_id, path, replace(path, '/', '__') as slug, replace(regexp_replace(regexp_replace(path, '\.py$', ''), '(?:^|/)__init__$', ''), '/', '.') as module, regexp_replace(replace(repo_id, '/', '__'), '__', '/') as back from p",
    ),
    "x_owner_and_name": (
        lambda s, d: table(s, d, "snapshots").select("repo_id").where("repo_id is not null").distinct().select("repo_id", text.owner_and_name(text.repo_key(F.col("repo_id"))).alias("project")),
        r"with r as (select distinct repo_id, lower(trim(repo_id)) as k from snapshots where repo_id is not null) select repo_id, regexp_extract(regexp_replace(k, '(?:\.git)?/*\s*$', ''), '([^/:\s]+/[^/:\s]+)$', 1) as project from r",
    ),
    "x_event_keys": (
        lambda s, d: qna(s, d).select("qna_id", text.event_key(F.col("assertion_event_id"), F.col("test_file"), F.col("lineno"), F.col("col_offset")).alias("k"), text.fingerprint(F.col("repo_id"), F.col("commit_sha")).alias("fp")),
        f"with {SQL_Q} select qna_id, coalesce(nullif(assertion_event_id, ''), concat_ws('::', test_file, lineno, coalesce(col_offset, -1))) as k, substr(sha256(repo_id || chr(0) || commit_sha), 1, 16) as fp from q",
    ),
    "d_timestamps": (
        lambda s, d: commits(s, d).select("commit_sha", F.date_format(F.try_to_timestamp("commit_timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts")),
        f"with {SQL_C} select commit_sha, strftime(try_cast(commit_timestamp as timestamptz) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as ts from c",
    ),
    "d_latest_day": (
        lambda s, d: commits(s, d).groupBy("repo_id").agg(F.max(F.date_format(F.try_to_timestamp("commit_timestamp"), "yyyy-MM-dd")).alias("day")),
        f"with {SQL_C} select repo_id, max(strftime(try_cast(commit_timestamp as timestamptz) at time zone 'UTC', '%Y-%m-%d')) as day from c group by 1",
    ),
    "m_scaled": (
        lambda s, d: _scaled(s, d),
        f"with {SQL_C}, e as (select repo_id, min(ln(1 + n_new_assertions)) as lo, max(ln(1 + n_new_assertions)) as hi from c group by 1) select commit_sha, round(case when hi = lo then 1.0 else (ln(1 + n_new_assertions) - lo) / (hi - lo + 1e-8) end, 6) as x from c join e using (repo_id) where n_new_assertions is not null",
    ),
    "m_path_bonus": (
        lambda s, d: table(s, d, "file_changes").where("path is not null").select("path").distinct().select("path", F.round(vectors.path_bonus(F.col("path")) + vectors.depth_bonus(F.col("path")), 3).alias("bonus")),
        r"with p as (select distinct path, lower(path) as l, len(list_filter(string_split(path, '/'), lambda x: x <> '')) as k from file_changes where path is not null) select path, round(case when regexp_matches(l, '(^|/)(__init__\.py|setup\.py|conf\.py|version\.py|constants?\.py|typing.*\.py)$') then -0.25 else 0 end + case when regexp_matches(l, '(^|/)(src/|core/|lib/)') then 0.15 else 0 end + case k when 0 then 0.2 when 1 then 0.1 else 0 end, 3)::double as bonus from p",
    ),
    "v_mean_pool": (_pooled("mean"), _sql_pooled(["avg"])),
    "v_max_mean_pool": (_pooled("max_mean"), _sql_pooled(["max", "avg"])),
    "v_file_weights": (_file_weights, SQL_WEIGHTS),
    "v_norms": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.norm(vectors.unit(F.col("embedding"))), 5).alias("unit_norm")),
        "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as norm, 1.0::double as unit_norm from embeddings",
    ),
    "v_repeated_vectors": (
        lambda s, d: table(s, d, "embeddings").agg((F.count("*") - F.count_distinct(F.transform("embedding", lambda x: F.bround(x.cast("double"), 4)))).alias("repeats")),
        "select count(*) - count(distinct list_transform(embedding, lambda x: round_even(x::double, 4))) as repeats from embeddings",
    ),
    "v_token_windows": (
        _windows,
        """with t as (select doc_id, length(text) as n from documents where length(text) > 0), w as (select doc_id, n, unnest(range(0, greatest(0, ceil((n - 100) / 80.0)::int) + 1)) as i from t)
        select doc_id, cast(i as int) as i, cast(i * 80 + 1 as int) as first, cast(least(i * 80 + 100, n) as int) as last from w where least(100, n - i * 80) >= 16""",
    ),
    "v_block_similarity": (
        lambda s, d: geometry.similarity(table(s, d, "embeddings"), "vec_id", "embedding", table(s, d, "embeddings").where("vec_id % 20 = 0")).groupBy("a").agg(F.round(F.avg("cosine"), 6).alias("mean_cosine")),
        """with q as (select vec_id as a, embedding::double[] as v from embeddings where vec_id % 20 = 0), e as (select vec_id as b, embedding::double[] as w from embeddings)
        select a, round(avg(list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w))), 6) as mean_cosine from q, e where a <> b group by a""",
    ),
    "v_diversity": (
        lambda s, d: geometry.whole_diversity(table(s, d, "embeddings"), "vec_id", "embedding").select(F.round("mean_cosine", 6).alias("mean_cosine"), "n_pairs"),
        """with m as (select i, avg(embedding[i]::double) as m from embeddings, range(1, 65) r(i) group by i), l as (select list(m order by i) as m from m),
        e as (select vec_id, list_transform(range(1, 65), lambda i: embedding[i]::double - l.m[i]) as v from embeddings, l), n as (select count(*) as n from e),
        x as (select i, sum(v[i] / sqrt(list_dot_product(v, v))) as s from e, range(1, 65) r(i) group by i)
        select round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) as mean_cosine, cast(max(n) * (max(n) - 1) as bigint) as n_pairs from x, n""",
    ),
    "m_principal_axes": (
        lambda s, d: geometry.principal_axes(table(s, d, "embeddings"), "vec_id", "embedding", 64).groupBy().agg(F.count("*").alias("n"), F.round(F.sum(F.col("position") * F.col("position")) / F.count_distinct("vec_id"), 3).alias("variance")),
        "with v as (select i, var_pop(embedding[i]::double) as v from embeddings, range(1, 65) r(i) group by i) select (select count(*) * 64 from embeddings) as n, round(sum(v), 3) as variance from v",
    ),
    "r_bm25": (_bm25, SQL_BM25),
    "r_bm25_pruned": (_bm25_pruned, SQL_BM25),
    "r_dense_top_k": (_dense, SQL_DENSE),
    "r_fused": (_fused, SQL_FUSED),
    "r_packed_context": (
        _packed,
        """with recursive o as (select repo_id, doc_id, length(text) as f, length(text) // 4 as c, row_number() over (partition by repo_id order by doc_id % 7 desc, doc_id) as rn from documents where text is not null and repo_id is not null),
        r as (select repo_id, rn, doc_id, case when f <= 2000 then 'full' when c <= 2000 then 'short' end as form, 2000 - case when f <= 2000 then f when c <= 2000 then c else 0 end as room from o where rn = 1
            union all select o.repo_id, o.rn, o.doc_id, case when f <= room then 'full' when c <= room then 'short' end, room - case when f <= room then f when c <= room then c else 0 end from r join o on o.repo_id = r.repo_id and o.rn = r.rn + 1)
        select repo_id, cast(row_number() over (partition by repo_id order by rn) - 1 as int) as position, doc_id as block_id, form from r where form is not null""",
    ),
    "r_chunks": (lambda s, d: extraction.source_chunks(table(s, d, "file_changes").where("path like '%.py'").select("path", F.col("new_blob").alias("blob_sha")).distinct().join(table(s, d, "blobs"), "blob_sha").select("blob_sha", "path", "text"), ["blob_sha", "path"], "path").groupBy("path").agg(F.count("*").alias("n")), None),
    "e_assertions": (_extracted, None),
    "e_imports": (lambda s, d: extraction.exploded(table(s, d, "blobs"), ["blob_sha"], "text", extraction.imports, "module string, name string, level int").groupBy("module").agg(F.count("*").alias("n")), None),
    "e_separated": (lambda s, d: extraction.separated(table(s, d, "file_changes").where("path is not null").select("repo_id", "path").distinct(), "path").groupBy("repo_id", "kind").agg(F.count("*").alias("n")), "select repo_id, case when contains(lower(path), 'test') then 'test' else 'regular' end as kind, count(*) as n from (select distinct repo_id, path from file_changes where path is not null) group by 1, 2"),
    "x_metrics": (_metrics, None),
    "x_error_classes": (lambda s, d: _answers(s, d).where(F.col("got") != F.col("target")).groupBy(score_functions.error_class("target", "got").alias("kind")).agg(F.count("*").alias("n")), None),
    "x_difficulty_exact": (lambda s, d: texts(s, d).where("target is not null").groupBy(score_functions.difficulty_exact("target").alias("difficulty")).agg(F.count("*").alias("n")), None),
    "z_new_definitions": (lambda s, d: stateful.new_assertions(_changes_with_keys(s, d)), None),
    "z_only_new_blobs": (
        lambda s, d: stateful.only_new(table(s, d, "blobs").select("blob_sha"), table(s, d, "file_changes").where("seq < 5").select(F.col("new_blob").alias("blob_sha")), "blob_sha"),
        "select distinct blob_sha from blobs where blob_sha not in (select new_blob from file_changes where seq < 5 and new_blob is not null)",
    ),
}


def _scaled(s, d):
    rows = commits(s, d).where("n_new_assertions is not null").withColumn("l", F.log1p("n_new_assertions"))
    ends = rows.groupBy("repo_id").agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    return rows.join(ends, "repo_id").select("commit_sha", F.round(vectors.scaled_01(F.col("l"), F.col("lo"), F.col("hi")), 6).alias("x"))


QUERIES = {k: v[0] for k, v in PAIRS.items()}
ORACLE = {k: v[1] for k, v in PAIRS.items() if v[1]}
