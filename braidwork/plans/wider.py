"""Further queries over joins, aggregates, samples, vectors, text and retrieval (2.2-2.9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwork.functions import scores as score_functions
from braidwork.functions import text, vectors
from braidwork.operators import context, extraction, geometry, joins, ordering, retrieval, sampling, stats, windows
from braidwork.plans.base import SQL_C, SQL_Q, SQL_S, SQL_T, commits, qna, scores, texts
from braidwork.plans.expressions import SQL_DENSE, _dense, _file_weights, sql_strip
from braidwork.plans.summaries import SQL_ANSWERS, _answers, _exact_match
from braidwork.session import table
from braidwork.streaming import stateful

VALUES = ("em", "es")
# Stand-in scores of six methods.
SQL_SIX = "x as (select repo_id, assertion_type, 'm' || (lineno % 6) as method, max(((col_offset + lineno) % 5 = 0)::int) as hit from q where col_offset is not null group by all)"


def _six(s, d):
    rows = qna(s, d).where("col_offset is not null").select("repo_id", "assertion_type", F.concat(F.lit("m"), F.col("lineno") % 6).alias("method"), ((F.col("col_offset") + F.col("lineno")) % 5 == 0).cast("int").alias("hit"))
    return rows.groupBy("repo_id", "assertion_type", "method").agg(F.max("hit").alias("hit"))


def _per_method_repo(s, d):
    return scores(s, d).groupBy("method", "repo_id").agg(F.avg("em").alias("em"), F.count("*").alias("n"))


def _timeline(s, d):
    """Per method and bin of positions, weighted means of what four shards report."""
    bins = F.floor(F.col("commit_index") / 10).alias("bin")
    shards = scores(s, d).groupBy("method", bins, (F.col("qna_id") % 4).alias("shard")).agg(F.count("*").alias("n"), F.avg("em").alias("em"), F.avg("es").alias("es"))
    return shards.groupBy("method", "bin").agg(F.sum("n").alias("n"), *(F.round(stats.weighted_mean(v, "n"), 6).alias(v) for v in VALUES))


def _intervals(s, d):
    return stats.bootstrap_intervals(scores(s, d), "method", VALUES, 200)


def _merged(s, d):
    rows = scores(s, d)
    return stats.merged_intervals([rows.where(F.col("qna_id") % 3 == k) for k in range(3)], "method", VALUES, 200)


def _interval_means(found):
    """What does not depend on chance: means and counts, and that each interval holds its mean."""
    return found.select("method", "metric", "n", F.round("mean", 6).alias("mean"), (F.col("low") <= F.col("mean") + 1e-9).alias("above"), (F.col("high") >= F.col("mean") - 1e-9).alias("below"))


SQL_INTERVALS = f"with {SQL_Q}, {SQL_S} select method, metric, count(*) as n, round(avg(v), 6) as mean, true as above, true as below from (select method, 'em' as metric, em::double as v from s union all select method, 'es', es from s) group by 1, 2"


def _coverage_share(s, d):
    from braidwork.plans.summaries import _coverage

    return _coverage(s, d).select("key", (F.col("before") - F.col("after")).alias("dropped"), F.round(F.col("after") / F.col("before"), 6).alias("kept"))


def _old_and_new(s, d):
    """Means of stored scores beside those of scores computed anew; here the new ones count a hit at even columns only."""
    both = qna(s, d).select("assertion_type", (F.col("lineno") % 2).alias("old"), F.when(F.coalesce("col_offset", F.lit(0)) % 2 == 0, F.col("lineno") % 2).otherwise(0).alias("new"))
    return both.groupBy("assertion_type").agg(F.count("*").alias("n"), F.round(F.avg("old"), 6).alias("old"), F.round(F.avg("new"), 6).alias("new"), F.round(F.avg("new") - F.avg("old"), 6).alias("change"))


def _quality_cap(s, d):
    """At most five pairs of a test function, those on several lines first, then the longest."""
    rows = texts(s, d).where("target is not null and test_function is not null").select("qna_id", "repo_id", "test_function", F.col("target").contains("\n").cast("int").alias("wide"), F.length("target").alias("size"))
    return windows.head_per_group(rows, ["repo_id", "test_function"], [F.desc("wide"), F.desc("size"), F.asc("qna_id")], 5).select("qna_id")


def _snapshot_files(s, d):
    """Files of each commit's repository up to that commit meet their vectors, many to many, and are pooled per commit."""
    files = table(s, d, "file_changes").where("path is not null").select("repo_id", "commit_sha", (F.col("seq") % 50).cast("long").alias("vec_id")).distinct()
    met = files.where("commit_sha is not null").join(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return vectors.pooled(met, "commit_sha", "embedding", "mean").select("commit_sha", F.posexplode("pooled").alias("pos", "x")).select("commit_sha", "pos", F.round("x", 6).alias("x"))


def _running_offset(s, d):
    groups = qna(s, d).groupBy("commit_sha").agg(F.count("*").alias("k"))
    values = table(s, d, "events").select(F.col("event_id").alias("at"), F.col("value").alias("v"))
    return joins.by_running_offset(groups, values, "commit_sha", "k", "v", "at").select("commit_sha", "position", "offset", F.round("v", 6).alias("v"))


def _sized(s, d):
    c = commits(s, d).where("n_new_assertions is not null")
    ends = c.groupBy("repo_id").agg(F.min("n_new_assertions").alias("lo"), F.max("n_new_assertions").alias("hi"), F.min(F.when(F.col("n_new_assertions") > 0, F.col("n_new_assertions"))).alias("lop"), F.max(F.when(F.col("n_new_assertions") > 0, F.col("n_new_assertions"))).alias("hip"))
    x = F.col("n_new_assertions")
    return c.join(ends, "repo_id").select("commit_sha", F.round(vectors.log_sized(x, F.col("lo"), F.col("hi")), 5).alias("log"), F.round(vectors.root_sized(x, F.col("lop"), F.col("hip")), 5).alias("root"), F.round(vectors.clamp(x.cast("double"), 2.0, 6.0), 5).alias("clamped"))


SQL_SIZED = f"""with {SQL_C}, e as (select repo_id, min(n_new_assertions) as lo, max(n_new_assertions) as hi, min(n_new_assertions) filter (where n_new_assertions > 0) as lop, max(n_new_assertions) filter (where n_new_assertions > 0) as hip from c where n_new_assertions is not null group by 1),
    x as (select commit_sha, n_new_assertions as n, ln(1 + greatest(n_new_assertions, 0)) as t, ln(1 + greatest(lo, 0)) as lo, ln(1 + greatest(hi, 0)) as hi, sqrt(lop) as lop, sqrt(hip) as hip from c join e using (repo_id) where n_new_assertions is not null)
    select commit_sha, round(case when hi <= 0 then 8.0 when hi <= lo then 50.0 else 5 + 95 * (t - lo) / (hi - lo + 1e-9) end, 5) as log, round(case when n <= 0 then 6.0 when hip <= lop then 40.0 else 15 + 120 * (sqrt(n) - lop) / (hip - lop + 1e-9) end, 5) as root, greatest(2.0, least(n, 6.0))::double as clamped from x"""


def _narrow_windows(least):
    def run(s, d):
        ids = F.sequence(F.lit(1), F.length("text"))
        w = table(s, d, "documents").where("length(text) > 0").select("doc_id", vectors.token_windows(ids, 100, 20, least).alias("w"))
        return w.select("doc_id", F.size("w").alias("n"), F.size(F.element_at("w", -1)).alias("last")) if least == 0 else w.select("doc_id", F.size("w").alias("n"))

    return run


def _weighted_pool(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("label").alias("g"), "embedding")
    weighed = e.join(_file_weights_all(s, d), "vec_id")
    pooled = vectors.weighted_pool(weighed, "g", "embedding", "weight", 0.5, 2.0)
    return pooled.select("g", F.posexplode("pooled").alias("pos", "x")).select("g", "pos", F.round("x", 5).alias("x"))


def _file_weights_all(s, d):
    """V7: weights from distinctiveness, size, path, depth and number of lines; size and lines are stand-ins from the id."""
    e = table(s, d, "embeddings").select("vec_id", F.col("label").alias("g"), vectors.unit(F.col("embedding")).alias("v"), F.log1p(F.greatest(F.lit(1), F.col("vec_id") % 97).cast("double")).alias("size"), (F.col("vec_id") % 31).alias("n_lines"), F.concat(F.lit("src/m"), F.col("vec_id").cast("string"), F.lit("/core.py")).alias("path"))
    mean = vectors.pooled(e, "g", "v").withColumnRenamed("pooled", "m")
    ends = e.groupBy("g").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    odd = e.join(mean, "g").join(ends, "g").withColumn("score", vectors.file_scores(F.lit(1.0) - vectors.cosine(F.col("v"), F.col("m")), vectors.scaled_01(F.col("size"), F.col("lo"), F.col("hi")), F.col("path"), F.col("n_lines")))
    return vectors.softmax_weights(odd, "g", "score", 0.5).select("vec_id", "weight")


SQL_WEIGHTS = """e as (select vec_id, label as g, embedding, list_transform(embedding::double[], lambda x: x / (sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-12)) as v, ln(1 + greatest(1, vec_id % 97)) as size, vec_id % 31 as n_lines from embeddings),
    c as (select g, i, avg(v[i]) as m from e, range(1, 65) r(i) group by 1, 2), m as (select g, list(m order by i) as m from c group by 1), z as (select g, min(size) as lo, max(size) as hi from e group by 1),
    s as (select vec_id, g, 1 - list_dot_product(v, m) / sqrt(list_dot_product(v, v) * list_dot_product(m, m)) + 0.3 * (case when hi = lo then 1.0 else (size - lo) / (hi - lo + 1e-8) end) + 0.15 + 0.15 * ln(least(greatest(n_lines, 1) / 20.0::double, 1.0) + 1e-6) as score from e join m using (g) join z using (g)),
    x as (select *, exp((score - max(score) over (partition by g)) / 0.5) as ex from s), w as (select vec_id, g, ex / sum(ex) over (partition by g) as weight from x)"""


def _few_shot(s, d):
    """The three nearest examples of each query, best first, put before it."""
    named = table(s, d, "embeddings").select("vec_id", F.concat(F.lit("case "), F.col("vec_id").cast("string"), F.lit(" -> "), F.col("label").cast("string")).alias("example"))
    near = _dense(s, d).where("rank <= 3").join(named, "vec_id")
    asked = near.select("query_id").distinct().select("query_id", F.concat(F.lit("case "), F.col("query_id").cast("string"), F.lit(" -> ")).alias("prefix"))
    return retrieval.few_shot_prompts(asked, near, "query_id", "prefix", "example", "rank").select("query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n_chars"))


SQL_FEW = f"""with n as ({SQL_DENSE}), k as (select query_id, string_agg('case ' || vec_id || ' -> ' || label, chr(10) || chr(10) || '# ---' || chr(10) || chr(10) order by rank) as t from n join embeddings using (vec_id) where rank <= 3 group by 1),
    p as (select query_id, '# Examples of assertion completions:' || chr(10) || chr(10) || t || chr(10) || chr(10) || '# ---' || chr(10) || chr(10) || '# Now complete the following assertion:' || chr(10) || 'case ' || query_id || ' -> ' as prompt from k)
    select query_id, md5(prompt) as prompt_md5, cast(length(prompt) as int) as n_chars from p"""


def _window_index(s, d):
    """Windows of search tokens with their place; vectors are input columns and join on (doc_id, window)."""
    return retrieval.window_index(table(s, d, "documents"), "doc_id", "text", 64, 16, 8).select("doc_id", "window", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


SQL_TOKENS = "regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*|\\d+')"
SQL_INDEX = f"""with t as (select doc_id, {SQL_TOKENS} as t from documents where text is not null), n as (select *, len(t) as n from t where len(t) > 0), w as (select *, unnest(range(0, greatest(0, ceil((n - 64) / 48.0)::int) + 1)) as i from n), x as (select doc_id, i, t[i * 48 + 1:i * 48 + 64] as u from w)
    select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as window, cast(len(u) as int) as n, md5(array_to_string(u, ' ')) as tokens_md5 from x where len(u) >= 8"""


def _newest_files(s, d):
    """The last version of every Python file."""
    changes = table(s, d, "file_changes").where("path like '%.py' and new_blob is not null").select("repo_id", "path", "seq", "new_blob").distinct()
    newest = windows.first_per_group(changes, ["repo_id", "path"], [F.desc("seq"), "new_blob"])
    return newest.select("repo_id", "path", F.col("new_blob").alias("blob_sha")).join(table(s, d, "blobs"), "blob_sha").select("repo_id", "path", "text")


def _contextual(s, d):
    sources = texts(s, d).where("target is not null").select("qna_id", F.concat("prefix", "target").alias("text"))
    return extraction.exploded(sources, ["qna_id"], "text", context.contextual_assertions, "assertion_type string, structured string, last_lines string, target string, lineno int").groupBy("assertion_type").agg(F.count("*").alias("n"), F.sum((F.length("structured") <= F.length("last_lines")).cast("long")).alias("shorter"))


def _condensed(s, d):
    @F.pandas_udf("string")
    def condensed(source):
        return source.map(lambda t: None if t is None else context.condensed_source(t))

    return table(s, d, "blobs").select("blob_sha", F.length(condensed("text")).alias("n_chars"), F.length("text").alias("n_before")).groupBy((F.col("n_chars") <= F.col("n_before")).alias("shorter")).agg(F.count("*").alias("n"))


def _table_function(s, d, function, columns):
    """On the test sources that prefixes and targets make, and on the files."""
    tests = texts(s, d).where("target is not null").select(F.col("qna_id").cast("string").alias("id"), F.concat("prefix", "target").alias("text"))
    files = table(s, d, "blobs").select(F.col("blob_sha").alias("id"), "text")
    return extraction.exploded(tests.unionByName(files), ["id"], "text", function, columns)


def _spliced(s, d):
    """The rest of a prefix's last line, from its end on, replaced by an answer."""

    @F.pandas_udf("string")
    def spliced(prefix):
        return prefix.map(lambda p: extraction.spliced(p, p.count("\n") + 1, len(p) - p.rfind("\n") - 1, "answer") if p and not p.endswith("\n") and "\r" not in p and len(p.splitlines()) == p.count("\n") + 1 else (p or "") + "answer")

    return texts(s, d).select("qna_id", F.md5(spliced("prefix")).alias("source_md5"))


def _compressed(s, d):
    @F.pandas_udf("string")
    def compressed(source):
        return source.map(lambda t: None if t is None else extraction.compressed(t))

    return table(s, d, "blobs").select((F.length(compressed("text")) <= F.length("text")).alias("shorter")).groupBy("shorter").agg(F.count("*").alias("n"))


def _test_content(s, d):
    @F.pandas_udf("boolean")
    def holds(source):
        return source.map(context.is_test_content)

    return table(s, d, "blobs").where("text is not null").select("blob_sha", holds("text").alias("is_test"), text.mentions_tests(F.col("text")).alias("mentions")).groupBy("is_test", "mentions").agg(F.count("*").alias("n"))


def _metric_struct(s, d):
    """The five fields of a scored answer."""
    a = _answers(s, d)
    clean, ref = text.cleaned_prediction(F.col("got"), F.col("target")), text.without_comment(F.col("target"))
    return a.select("qna_id", score_functions.metrics(clean, ref).alias("m")).select("qna_id", "m.*").groupBy("exact_match").agg(F.count("*").alias("n"), F.round(F.avg("edit_similarity"), 6).alias("es"), F.round(F.avg("code_bleu"), 6).alias("cb"), F.count_distinct("pred_clean").alias("answers"), F.count_distinct("ref_clean").alias("targets"))


NUMBER = r"^[+-]?(?:(?:\d+(?:_\d+)*)?\.?\d+(?:_\d+)*|\d+(?:_\d+)*\.)(?:[eE][+-]?\d+)?$"
WORDY = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def _is_number(x):
    return f"(regexp_matches({x}, '{NUMBER}') or regexp_matches({x}, '{WORDY}'))"


SQL_CLASSES = rf"""y as (select *, {sql_strip('target')} as u from t where target is not null), z as (select *, regexp_replace(u, '\)+\z', '') as v from y),
    k as (select *, case when v in ('True', 'False') then 'bool_literal' when v = 'None' then 'none_literal' when regexp_matches(v, '^(?:[''"]|[bf][''"])') then 'string_literal' when {_is_number("regexp_replace(v, '^([^-]*)-', '\\1')")} then 'numeric_literal'
    when regexp_matches(v, '^[\[({{]') then 'collection' when contains(target, '(') then 'func_call' when regexp_matches(v, '^[A-Za-z_]\w*$') then 'variable' else 'complex_expr' end as difficulty,
    case when u in ('True', 'False') then 'bool_literal' when u = 'None' then 'none_literal' when regexp_matches(u, '^(?:[''"]|[bf][''"])') then 'string_literal' when {_is_number('u')} then 'numeric_literal'
    when regexp_matches(u, '^[\[({{]') then 'collection' when contains(u, '(') and contains(u, ')') then 'func_call' when regexp_matches(u, '^[A-Za-z_]\w*$') or contains(u, '.') then 'variable' else 'complex_expr' end as composition from z)"""


def _kind(x):
    return rf"case when {x} in ('True', 'False') then 'bool' when {x} = 'None' then 'none' when regexp_matches({x}, '^[''\"]') then 'str' when {x} like '[%' then 'list' when {x} like '{{%' then 'dict' when {x} like '(%' then 'tuple' when regexp_matches({x}, '^[+-]?\d+(?:_\d+)*$') then 'int' when {_is_number(x)} then 'float' else 'other' end"


SQL_FAILURES = f"""with {SQL_ANSWERS}, y as (select *, {sql_strip('target')} as e, {sql_strip('got')} as g from a where got <> target), z as (select *, {_kind('e')} as ek, {_kind('g')} as gk from y)
    select case when g = '' then 'empty_prediction' when g = e then 'whitespace_mismatch' when lower(target) = lower(got) then 'case_mismatch' when contains(got, target) then 'overgeneration' when contains(target, got) then 'undergeneration'
    when ek = gk and ek <> 'other' then 'wrong_value_right_type' else 'completely_wrong' end as mode, count(*) as n from z group by 1"""

_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _match(x):
    bare = rf"regexp_replace({sql_strip(x)}, '[:, \t]+\z', '')"
    return rf"trim(regexp_replace(replace(replace({bare}, ', ', ','), ' ,', ','), '{_BLANKS}', ' ', 'g'), ' ')"


SQL_EXACT = rf"""with {SQL_ANSWERS}, b as (select assertion_type, target, {sql_strip("replace(replace(replace(got, '<|fim_prefix|>', ''), '<|fim_suffix|>', ''), '<|fim_middle|>', '')")} as o from a),
    f as (select assertion_type, target, case when not contains(target, chr(10)) and contains(o, chr(10)) then string_split(o, chr(10))[1] else o end as o from b), h as (select assertion_type, {sql_strip("string_split(o, '#')[1]")} as o, {sql_strip("string_split(target, '#')[1]")} as r from f),
    i as (select *, case when not contains(r, ',') and contains(o, ',') then {sql_strip("string_split(o, ',')[1]")} else o end as k from h), j as (select *, len(regexp_split_to_array(r, '{_BLANKS}')) as nr, case when k = '' then 0 else len(regexp_split_to_array(k, '{_BLANKS}')) end as nk from i),
    m as (select assertion_type, r, case when r = '' then o when r <> '' and nr = 1 and nk > 1 then regexp_split_to_array(k, '{_BLANKS}')[1] else k end as c from j)
    select assertion_type, count(*) as n, cast(sum(({_match(sql_strip('c'))} = {_match('r')})::int) as bigint) as hits from m group by 1"""

SQL_CODE = r"""with {0} select qna_id, cast(len(regexp_extract_all(target, '[a-zA-Z_]\w*|0[xXoObB][\da-fA-F_]+|\d[\d_]*\.?\d*[eE]?[\d_]*|"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|[^\s]')) as int) as n from t where target is not null""".replace("{0}", SQL_T)


def _recurrent(s, d):
    rows = table(s, d, "commits").where(vectors.is_finite(F.col("diff_embedding"), 64)).select("repo_id", "commit_index", "diff_embedding").dropDuplicates(["repo_id", "commit_index"])
    return stateful.recurrent_walk(rows, "repo_id", "commit_index", "diff_embedding").groupBy("repo_id").agg(F.max_by("state", "commit_index").alias("h")).select("repo_id", F.round(vectors.norm(F.col("h")), 4).alias("norm"))


SQL_RECURRENT = """with r as (select repo_id, commit_index, any_value(diff_embedding) as v from commits where diff_embedding is not null and len(diff_embedding) = 64 and list_bool_and(list_transform(diff_embedding, lambda x: isfinite(x))) group by 1, 2),
    k as (select *, row_number() over (partition by repo_id order by commit_index desc) - 1 as back, row_number() over (partition by repo_id order by commit_index) as place from r),
    w as (select repo_id, i, sum(v[i]::double * pow(0.5::double, case when place = 1 then back else back + 1 end)) as x from k, range(1, 65) g(i) group by 1, 2)
    select repo_id, round(sqrt(sum(x * x)), 4) as norm from w group by 1"""


def _timeline_metrics(s, d):
    """An evaluation at every step of a walk: the step's vector against the state before it."""
    rows = table(s, d, "commits").where(vectors.is_finite(F.col("diff_embedding"), 64)).select("repo_id", "commit_index", "diff_embedding").dropDuplicates(["repo_id", "commit_index"])
    walked = stateful.evaluated_walk(rows, "repo_id", "commit_index", "diff_embedding")
    return walked.groupBy("repo_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("score"))


def _arranged(how):
    def run(s, d):
        files = table(s, d, "file_changes").where("path is not null").select("repo_id", "seq", "path").distinct()
        vec = table(s, d, "embeddings").select((F.col("vec_id") % 50).alias("k"), F.element_at("embedding", 1).alias("x")).groupBy("k").agg(F.round(F.max("x"), 5).alias("x"))
        met = ordering.arranged(files, ["repo_id"], how, "seq", "path", "9")
        return met.join(vec, F.col("seq") % 50 == F.col("k")).select("repo_id", "position", "seq", "path", "x")

    return run


def _sql_arranged(order):
    return f"""with f as (select distinct repo_id, seq, path from file_changes where path is not null), p as (select *, row_number() over (partition by repo_id order by {order}) - 1 as position from f), v as (select vec_id % 50 as k, round(max(embedding[1]), 5) as x from embeddings group by 1)
    select repo_id, position, seq, path, x from p join v on seq % 50 = k"""


PAIRS = {
    "s_sequences": (
        lambda s, d: ordering.sequences(commits(s, d), qna(s, d), "repo_id", ["commit_index", "commit_sha"], 5, 12, "4", cross_repo_split="train").select("repo_id", "position", "commit_sha", "n_questions"),
        f"""with {SQL_C}, {SQL_Q}, t as (select * from c where cross_repo_split = 'train'), g as (select repo_id from t group by 1 having count(*) >= 5 order by md5('4|' || repo_id), repo_id limit 12), k as (select repo_id, commit_index, count(*) as n from q group by 1, 2)
        select t.repo_id, row_number() over (partition by t.repo_id order by t.commit_index, commit_sha) - 1 as position, commit_sha, coalesce(k.n, 0) as n_questions from t join g using (repo_id) left join k on k.repo_id = t.repo_id and k.commit_index = t.commit_index""",
    ),
    "j_arranged_chronological": (_arranged("chronological"), _sql_arranged("seq, path")),
    "j_arranged_reverse": (_arranged("reverse"), _sql_arranged("seq desc, path")),
    "j_arranged_alphabetical": (_arranged("alphabetical"), _sql_arranged("path, seq")),
    "j_arranged_random": (_arranged("random"), _sql_arranged("md5('9|' || seq || '|' || path), path, seq")),
    "j_lists": (
        lambda s, d: joins.lists_per_key(commits(s, d).select("repo_id", "commit_sha"), qna(s, d), ["repo_id", "commit_sha"], "qna_id", "ids").select("commit_sha", F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")),
        f"with {SQL_C}, {SQL_Q}, g as (select repo_id, commit_sha, list_sort(list(qna_id)) as l from q group by 1, 2) select c.commit_sha, cast(coalesce(len(l), 0) as int) as n, coalesce(array_to_string(l, ','), '') as ids from c left join g using (repo_id, commit_sha)",
    ),
    "j_results_with_metadata": (
        lambda s, d: scores(s, d).groupBy("repo_id").agg(F.round(F.avg("em"), 6).alias("em"), F.count("*").alias("n_scored")).join(qna(s, d).groupBy("repo_id").agg(F.count_distinct("commit_sha").alias("n_commits"), F.max("commit_index").alias("last")), "repo_id"),
        f"with {SQL_Q}, {SQL_S}, a as (select repo_id, round(avg(em), 6) as em, count(*) as n_scored from s group by 1), b as (select repo_id, count(distinct commit_sha) as n_commits, max(commit_index) as last from q group by 1) select * from a join b using (repo_id)",
    ),
    "j_train_size": (
        lambda s, d: scores(s, d).where("cross_repo_split <> 'ood_test'").groupBy("repo_id").agg(F.round(F.avg("em"), 6).alias("em")).join(qna(s, d).groupBy("repo_id").agg(F.sum((F.col("in_repo_split") == "train").cast("long")).alias("train")).where("train > 0"), "repo_id"),
        f"with {SQL_Q}, {SQL_S}, a as (select repo_id, round(avg(em), 6) as em from s where cross_repo_split <> 'ood_test' group by 1), b as (select repo_id, count(*) filter (where in_repo_split = 'train') as train from q group by 1) select a.repo_id, em, train from a join b using (repo_id) where train > 0",
    ),
    "j_in_six": (lambda s, d: joins.in_all(_six(s, d), ["repo_id", "assertion_type"], "method", 6), f"with {SQL_Q}, {SQL_SIX} select repo_id, assertion_type from x group by 1, 2 having count(distinct method) = 6"),
    "j_wins_alone_of_six": (
        lambda s, d: joins.wins_alone(_six(s, d), ["repo_id", "assertion_type"], "method", "hit", ["m0", "m1"], ["m2", "m3"]),
        f"with {SQL_Q}, {SQL_SIX} select repo_id, assertion_type from x group by 1, 2 having max(hit) filter (where method = 'm0') = 1 and max(hit) filter (where method = 'm1') = 1 and max(hit) filter (where method = 'm2') = 0 and max(hit) filter (where method = 'm3') = 0",
    ),
    "j_pooled_by_snapshot": (
        _snapshot_files,
        "with f as (select distinct commit_sha, seq % 50 as vec_id from file_changes where path is not null and commit_sha is not null) select commit_sha, cast(i - 1 as int) as pos, round(avg(embedding[i]::double), 6) as x from f join embeddings using (vec_id), range(1, 65) r(i) group by 1, 2",
    ),
    "j_running_offset": (
        _running_offset,
        f"with {SQL_Q}, g as (select commit_sha, count(*) as k from q group by 1), o as (select commit_sha, k, coalesce(sum(k) over (order by commit_sha rows between unbounded preceding and 1 preceding), 0) as f from g), x as (select commit_sha, unnest(range(0, k)) as position, f from o) select commit_sha, position, cast(f + position as bigint) as offset, round(value, 6) as v from x left join events on event_id = f + position",
    ),
    "a_report": (
        lambda s, d: stats.column_report(table(s, d, "documents").select("n_chars", "lang", "source"), ["n_chars"], ["lang", "source"], 3).where("stat not in ('std', 'mean')").select("column", "stat", F.round("value", 4).alias("value")),
        """with v as (select n_chars::double as v from documents), t as (select 'n_chars' as c, unnest(['n', 'min', 'max', 'median', 'p25', 'p75']) as stat, unnest([count(v)::double, min(v), max(v), median(v), quantile_cont(v, 0.25), quantile_cont(v, 0.75)]) as value from v),
        l as (select 'lang' as c, lang as stat, count(*)::double as value from documents where lang is not null group by 2 order by 3 desc, 2 limit 3), s as (select 'source', source, count(*)::double as n from documents where source is not null group by 2 order by 3 desc, 2 limit 3)
        select c as column, stat, round(value, 4) as value from (select * from t union all select * from l union all select * from s)""",
    ),
    "a_steps": (
        lambda s, d: qna(s, d).groupBy("repo_id", "commit_index").agg(F.count("*").alias("n")).withColumn("so_far", F.sum("n").over(Window.partitionBy("repo_id").orderBy("commit_index"))),
        f"with {SQL_Q}, g as (select repo_id, commit_index, count(*) as n from q group by 1, 2) select *, cast(sum(n) over (partition by repo_id order by commit_index) as bigint) as so_far from g",
    ),
    "a_timeline": (_timeline, f"with {SQL_Q}, {SQL_S} select method, commit_index // 10 as bin, count(*) as n, round(avg(em), 6) as em, round(avg(es), 6) as es from s group by 1, 2"),
    "a_intervals": (lambda s, d: _interval_means(_intervals(s, d)), SQL_INTERVALS),
    "a_merged_intervals": (lambda s, d: _interval_means(_merged(s, d)), SQL_INTERVALS),
    "a_per_difficulty": (
        lambda s, d: texts(s, d).where("target is not null").select("qna_id", text.difficulty(F.col("target")).alias("difficulty")).join(scores(s, d), "qna_id").groupBy("difficulty").agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em")),
        f"with {SQL_T}, {SQL_CLASSES}, {SQL_Q}, {SQL_S} select difficulty, count(*) as n, round(avg(em), 6) as em from k join s using (qna_id) group by 1",
    ),
    "a_power_fit": (
        lambda s, d: scores(s, d).groupBy("repo_id", "cross_repo_split").agg(F.count("*").alias("n"), (F.avg("es") * 100).alias("em")).groupBy("cross_repo_split").agg(*(F.round(c, 4).alias(n) for c, n in zip(stats.power_fit("n", "em"), ("c", "alpha", "r2"), strict=True))),
        f"with {SQL_Q}, {SQL_S}, r as (select repo_id, cross_repo_split, count(*) as n, avg(es) * 100 as em from s group by 1, 2) select cross_repo_split, round(exp(regr_intercept(ln(100 - em), ln(n))), 4) as c, round(regr_slope(ln(100 - em), ln(n)), 4) as alpha, round(regr_r2(ln(100 - em), ln(n)), 4) as r2 from r where em < 100 group by 1",
    ),
    "a_kept_share": (
        _coverage_share,
        f"""with {SQL_Q}, b as (select * from q where lineno % 5 > 0), x as (select 'repo_id' as key, (select count(distinct repo_id) from q) as n, (select count(distinct repo_id) from b) as k union all select 'repo_id+commit_sha', (select count(distinct (repo_id, commit_sha)) from q), (select count(distinct (repo_id, commit_sha)) from b)
        union all select 'repo_id+commit_sha+test_file', (select count(distinct (repo_id, commit_sha, test_file)) from q), (select count(distinct (repo_id, commit_sha, test_file)) from b)) select key, n - k as dropped, round(k / n, 6) as kept from x""",
    ),
    "a_method_rollup": (
        lambda s, d: _per_method_repo(s, d).groupBy("method").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n"), *(F.round(c, 6).alias(n) for c, n in ((F.avg("em"), "mean"), (F.percentile("em", 0.5), "median"), (F.stddev_samp("em"), "sd"), (F.min("em"), "low"), (F.max("em"), "high")))),
        f"with {SQL_Q}, {SQL_S}, r as (select method, repo_id, avg(em) as em, count(*) as n from s group by 1, 2) select method, count(*) as n_repos, cast(sum(n) as bigint) as n, round(avg(em), 6) as mean, round(median(em), 6) as median, round(stddev_samp(em), 6) as sd, round(min(em), 6) as low, round(max(em), 6) as high from r group by 1",
    ),
    "a_extrapolated": (
        lambda s, d: qna(s, d).groupBy("repo_id").agg(F.count("*").alias("total"), F.sum((F.col("lineno") % 3 == 0).cast("long")).alias("seen"), F.sum(((F.col("lineno") % 3 == 0) & (F.col("assertion_type") == "assert")).cast("long")).alias("hits")).select("repo_id", stats.extrapolated("hits", "total", "seen").alias("n")),
        f"with {SQL_Q}, g as (select repo_id, count(*) as total, count(*) filter (where lineno % 3 = 0) as seen, count(*) filter (where lineno % 3 = 0 and assertion_type = 'assert') as hits from q group by 1) select repo_id, cast(case when seen > 0 then round(hits * total / seen) else 0 end as bigint) as n from g",
    ),
    "a_old_and_new": (_old_and_new, f"with {SQL_Q}, b as (select assertion_type, lineno % 2 as old, case when coalesce(col_offset, 0) % 2 = 0 then lineno % 2 else 0 end as new from q) select assertion_type, count(*) as n, round(avg(old), 6) as old, round(avg(new), 6) as new, round(avg(new) - avg(old), 6) as change from b group by 1"),
    "a_difficulty_mix": (
        lambda s, d: texts(s, d).where("target is not null").groupBy(text.difficulty(F.col("target")).alias("difficulty"), text.composition_class(F.col("target")).alias("composition")).agg(F.count("*").alias("n")),
        f"with {SQL_T}, {SQL_CLASSES} select difficulty, composition, count(*) as n from k group by 1, 2",
    ),
    "a_failure_modes": (lambda s, d: _answers(s, d).where(F.col("got") != F.col("target")).groupBy(text.failure_mode(F.col("target"), F.col("got")).alias("mode")).agg(F.count("*").alias("n")), SQL_FAILURES),
    "a_exact_match": (_exact_match, SQL_EXACT),
    "x_code_tokens": (lambda s, d: texts(s, d).where("target is not null").select("qna_id", F.size(text.code_tokens(F.col("target"))).alias("n")), SQL_CODE),
    "z_recurrent": (_recurrent, SQL_RECURRENT),
    "z_evaluated_walk": (_timeline_metrics, None),
    "w_cap_by_quality": (
        _quality_cap,
        f"with {SQL_T} select qna_id from t where target is not null and test_function is not null qualify row_number() over (partition by repo_id, test_function order by contains(target, chr(10))::int desc, length(target) desc, qna_id) <= 5",
    ),
    "t_budgeted": (
        lambda s, d: sampling.budgeted(qna(s, d).select("repo_id", "qna_id"), "repo_id", "qna_id", "s").select("qna_id"),
        f"with {SQL_Q}, n as (select qna_id, count(*) over (partition by repo_id) as n, row_number() over (partition by repo_id order by md5('s|' || qna_id), qna_id) as r from q) select qna_id from n where r <= case when n <= 100 then n when n <= 1000 then 200 when n <= 5000 then 150 else 50 end",
    ),
    "t_two_stage_sample": (
        lambda s, d: sampling.two_stage_sample(qna(s, d).select("repo_id", "commit_sha", "qna_id"), ["repo_id", "commit_sha"], "qna_id", 2, 150, "s").select("qna_id"),
        f"with {SQL_Q}, n as (select qna_id from q qualify row_number() over (partition by repo_id, commit_sha order by qna_id) <= 2) select qna_id from n order by md5('s|' || qna_id), qna_id limit 150",
    ),
    "x_assert_counts": (
        lambda s, d: table(s, d, "blobs").where("text is not null").select("blob_sha", text.n_asserts(F.col("text")).alias("n")),
        r"select blob_sha, cast(len(regexp_extract_all(text, '(?:^|[^\w.])assert[^\w]|self\.assert\w+\(|pytest\.raises\(')) as int) as n from blobs where text is not null",
    ),
    "x_block_scores": (
        lambda s, d: texts(s, d).where("test_function is not null").select("qna_id", text.block_score(F.array("test_function"), F.col("prefix")).alias("score")),
        rf"""with {SQL_T} select qna_id, case when list_contains(regexp_extract_all(prefix, '\b([a-zA-Z_]\w*)\s*\(', 1), test_function) then 1.0 when list_contains(regexp_extract_all(prefix, '\b([a-zA-Z_]\w*)\s*\.', 1), test_function) then 0.8
        when list_contains(regexp_extract_all(prefix, '\b([a-zA-Z_]\w*)\b', 1), test_function) then 0.5 else 0.1 end::double as score from t where test_function is not null""",
    ),
    "x_metric_struct": (_metric_struct, None),
    "d_created_after": (
        lambda s, d: table(s, d, "documents").where(F.to_date("created_at") > F.lit("2021-06-30").cast("date")).groupBy("repo_id").agg(F.count("*").alias("n")),
        "select repo_id, count(*) as n from documents where created_at::date > date '2021-06-30' group by 1",
    ),
    "m_sizes": (_sized, SQL_SIZED),
    "v_windows_of_eight": (_narrow_windows(8), "with t as (select doc_id, length(text) as n from documents where length(text) > 0), w as (select doc_id, n, unnest(range(0, greatest(0, ceil((n - 100) / 80.0)::int) + 1)) as i from t) select doc_id, cast(count(*) filter (where least(100, n - i * 80) >= 8) as int) as n from w group by 1"),
    "v_windows_of_any": (_narrow_windows(0), "with t as (select doc_id, length(text) as n from documents where length(text) > 0), k as (select doc_id, n, greatest(0, ceil((n - 100) / 80.0)::int) + 1 as k from t) select doc_id, cast(k as int) as n, cast(n - (k - 1) * 80 as int) as last from k"),
    "v_weighted_pool": (
        _weighted_pool,
        f"with {SQL_WEIGHTS}, p as (select g, i, sum(embedding[i]::double * weight) * 0.5 as mean, max(embedding[i])::double * 2 as most from e join w using (vec_id, g), range(1, 65) r(i) group by 1, 2) select g, cast(i - 1 as int) as pos, round(mean, 5) as x from p union all select g, cast(i + 63 as int), round(most, 5) from p",
    ),
    "v_distances": (
        lambda s, d: geometry.distances(table(s, d, "embeddings"), "vec_id", "embedding", table(s, d, "embeddings").where("vec_id % 20 = 0")).groupBy("a").agg(F.round(F.avg("distance"), 4).alias("mean_distance")),
        "with q as (select vec_id as a, embedding::double[] as v from embeddings where vec_id % 20 = 0), e as (select vec_id as b, embedding::double[] as w from embeddings) select a, round(avg(list_distance(v, w)), 4) as mean_distance from q, e where a <> b group by a",
    ),
    "v_column_scaled": (
        lambda s, d: geometry.column_scaled(table(s, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total")),
        "with m as (select i, min(embedding[i])::double as lo, max(embedding[i])::double as hi from embeddings, range(1, 65) r(i) group by 1) select vec_id, round(sum(case when hi > lo then (embedding[i]::double - lo) / (hi - lo) else 0 end), 3) as total from embeddings, m group by 1",
    ),
    "v_step_inputs": (
        lambda s, d: table(s, d, "commits").where(vectors.is_finite(F.col("diff_embedding"), 64) & vectors.is_finite(F.col("repo_state_embedding"), 64)).select("commit_sha", *(F.size(vectors.step_input(F.col("diff_embedding"), F.col("repo_state_embedding"), m)).alias(m) for m in ("diff", "repo_state", "concat"))).distinct(),
        "select distinct commit_sha, 64 as diff, 64 as repo_state, 128 as concat from commits where " + " and ".join(f"{c} is not null and len({c}) = 64 and list_bool_and(list_transform({c}, lambda x: isfinite(x)))" for c in ("diff_embedding", "repo_state_embedding")),
    ),
    "h_hashes": (
        lambda s, d: table(s, d, "qna_pairs").agg(F.count_distinct(text.hash64(F.col("prefix"), F.col("target"))).alias("n")),
        "select count(distinct (coalesce(prefix, chr(1)), coalesce(target, chr(1)))) as n from qna_pairs",
    ),
    "r_few_shot": (_few_shot, SQL_FEW),
    "r_window_index": (_window_index, SQL_INDEX),
    "r_import_context": (lambda s, d: context.import_context(_newest_files(s, d)).groupBy("repo_id").agg(F.count("*").alias("n")), None),
    "j_definitions": (lambda s, d: context.resolved_imports(_newest_files(s, d)).groupBy("repo_id").agg(F.count("*").alias("n"), F.count("definition").alias("defined")), None),
    "e_contextual": (_contextual, None),
    "e_condensed": (_condensed, None),
    "e_next_blocks": (lambda s, d: _table_function(s, d, extraction.next_blocks, "test string, line int, before string, block string").withColumn("tags", F.array_join(text.test_tags(F.col("before")), ",")).groupBy("tags").agg(F.count("*").alias("n")), None),
    "e_tasks": (lambda s, d: _table_function(s, d, extraction.tasks, "name string, head string, body string").groupBy("name").agg(F.count("*").alias("n"), F.max(F.length("body")).alias("longest")), None),
    "e_spliced": (
        _spliced,
        f"with {SQL_T} select qna_id, md5(prefix || 'answer') as source_md5 from t",
    ),
    "r_compressed": (_compressed, None),
    "f_test_content": (_test_content, None),
}

QUERIES = {k: v[0] for k, v in PAIRS.items()}
ORACLE = {k: v[1] for k, v in PAIRS.items() if v[1]}
