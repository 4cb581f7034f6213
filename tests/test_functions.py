from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.functions import scores, text, vectors
from braidwork.operators import extraction, retrieval, stats


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("o")).first().o


@pytest.mark.parametrize("value", ["", "  a ", "\t\n a ", "a", " x\n\n", " , x", "a\x0b"])
def test_strip_is_pythons(spark, value):
    assert one(spark, text.strip(F.col("x")), x=value) == value.strip()
    assert one(spark, text.collapse(F.col("x")), x=value) == " ".join(value.split())


@pytest.mark.parametrize(("target", "trivial"), [(None, True), ("", True), (" , x", True), (")", True), ("a)", True), ("abcd", False), ("\t\n  ", True), ("    ", True), ("abcdefg)", False)])
def test_trivial_targets(spark, target, trivial):
    assert one(spark, text.is_trivial_target(F.col("x")), x=target) is trivial


@pytest.mark.parametrize(
    ("target", "kind"),
    [("True)", "bool_literal"), ("None", "none_literal"), ("'a')", "string_literal"), ("-3.5", "numeric_literal"), ("1e-3)", "numeric_literal"), ("[1]", "collection"), ("foo()", "func_call"), ("foo", "variable"), ("a + b", "complex_expr"), ("1_0", "numeric_literal"), ("nan", "numeric_literal")],
)
def test_difficulty(spark, target, kind):
    assert one(spark, text.difficulty(F.col("x")), x=target) == kind
    assert one(spark, scores.difficulty_exact("x"), x=target) == kind


def test_filtered_diff_keeps_source_only(spark):
    part = lambda p: f"diff --git a/{p} b/{p}\n--- a/{p}\n+x\n"
    diff = "noise\n" + part("src/a.py") + part("tests/test_a.py") + part("web/a.js") + part("build/b.py") + part("README.md")
    assert one(spark, text.filtered_diff(F.col("x")), x=diff) == part("src/a.py") + part("README.md")
    assert one(spark, text.filtered_diff(F.col("x")), x=None) == ""


@pytest.mark.parametrize(("pred", "target", "out"), [("5, 6", "5", "5"), ("5\n6", "5", "5"), ("a b", "a", "a"), ("x # c", "x", "x"), ("<|fim_middle|>x", "x", "x"), ("a, b", "a, b", "a, b"), ("", "x", "")])
def test_cleaned_prediction(spark, pred, target, out):
    assert one(spark, text.cleaned_prediction(F.col("p"), F.col("t")), p=pred, t=target) == out


def test_exact_match_ignores_spacing(spark):
    assert one(spark, text.exact_match(F.col("p"), F.col("t")), p="a, b :", t=" a ,b\t") is True


def test_similarity_scores():
    assert scores.similarity("abc", "abd") == SequenceMatcher(None, "abc", "abd").ratio()
    assert scores.similarity(None, "a") is None
    assert scores.code_score("", "x") == 0.0 and scores.code_score("x ", "x") == 1.0
    assert 0 < scores.code_score("a.b(c)", "a.b(d)") < 1
    assert scores.token_bleu(["a"], ["a", "b"]) == pytest.approx(0.5 * math.exp((math.log(2 / 2) * 1 + 3 * math.log(1 / 2)) / 4))


@pytest.mark.parametrize(
    ("expected", "got", "kind"),
    [("x", "", "Empty/Truncated"), ("x", "y" * 101, "Hallucination"), ("abcdefghij", "abcdefghik", "Near-Miss"), ("alpha", "((", "Syntax Error"), ("foo(1)", "barbaz(1)", "Wrong Identifier"), ("f(1)", "f(92)", "Wrong Literal"), ("[1, 1]", "(1, 1, 1)", "Type Mismatch")],
)
def test_error_kinds(expected, got, kind):
    closeness = 0.0 if kind in ("Wrong Identifier", "Wrong Literal", "Type Mismatch") else None
    assert scores.error_kind(expected, got, closeness) == kind


def test_token_windows_follow_the_loop(spark):
    def loop(n, size, overlap, least):
        out = []
        for start in range(0, n, size - overlap):
            w = list(range(start, min(start + size, n)))
            if len(w) >= least:
                out.append(w)
            if start + size >= n:
                break
        return out

    for n in (0, 5, 15, 16, 40, 41, 55, 96, 97):
        ids = F.array(*map(F.lit, range(n))) if n else F.array().cast("array<int>")
        got = spark.range(1).select(vectors.token_windows(ids, 40, 8).alias("w")).first().w
        assert [list(w) for w in got] == loop(n, 40, 8, 16), n


def test_windows_of_long_documents(spark, tmp_path):
    from braidwork.plans import catalog

    lengths = [0, 15, 16, 100, 101, 1999, 2000, 5003, 40_000]
    spark.createDataFrame([(n, "x" * n) for n in lengths] + [(7, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for n in lengths:
        for i, start in enumerate(range(0, n, 80)):
            if min(100, n - start) >= 16:
                want.add((n, i, start + 1, min(start + 100, n)))
            if start + 100 >= n:
                break
    got = [tuple(r) for r in catalog.QUERIES["v_token_windows"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_pooling_and_finite(spark):
    df = spark.createDataFrame([("a", [1.0, 4.0]), ("a", [3.0, 2.0]), ("b", None)], "g string, v array<float>")
    assert {r.g: list(r.pooled) for r in vectors.pooled(df, "g", "v", "mean_max").collect()} == {"a": [2.0, 3.0, 3.0, 4.0]}
    bad = spark.createDataFrame([([1.0, float("nan")],), (None,), ([1.0],), ([1.0, 2.0],), ([1.0, None],), ([float("inf"), 1.0],)], "v array<float>")
    assert [r.o for r in bad.select(vectors.is_finite(F.col("v"), 2).alias("o")).collect()] == [False, False, False, True, False, False]


def test_distribution_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", None)], "g string, v double")
    got = {r.g: r for r in df.groupBy("g").agg(*stats.distribution(F.col("v"))).collect()}
    assert (got["a"].n, got["a"]["std"], got["a"].median) == (1, 0.0, 1.0)
    assert got["b"].n == 0 and got["b"].mean is None


def test_floor_percentile(spark):
    values = [5, 1, 3, 3, 9, 7]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v int")
    row = stats.floor_percentile(df, "g", "v", (0, 25, 50, 100)).first()
    want = [sorted(values)[min(int(len(values) * p / 100), len(values) - 1)] for p in (0, 25, 50, 100)]
    assert [row.p0, row.p25, row.p50, row.p100] == want


def test_closed_bins_emit_empty_ones(spark):
    df = spark.createDataFrame([("r", 0.0, 1.0, 2), ("s", 1.0, 0.0, 1), ("t", 9.0, 1.0, 1)], "repo string, x double, em double, n int")
    got = [(r.lo, r.n_rows, r.em) for r in stats.closed_bins(df, "x", [0.0, 0.5, 0.8, 1.0], ["em"], "n", "repo").orderBy("lo").collect()]
    assert got == [(0.0, 1, 1.0), (0.5, 0, None), (0.8, 1, 0.0)]


def test_bootstrap_interval(spark):
    df = spark.createDataFrame([("a", float(i % 2)) for i in range(400)] + [("b", 1.0), ("c", None)], "g string, v double")
    got = {r.g: r for r in stats.bootstrap_interval(df, "g", "v", 500).collect()}
    assert got["a"].mean == 0.5 and 0.4 < got["a"].low < 0.5 < got["a"].high < 0.6
    assert (got["b"].low, got["b"].high, got["b"].n) == (1.0, 1.0, 1)
    assert got["c"].flag == "empty" and got["c"].n == 0
    assert {r.g: r.low for r in stats.bootstrap_interval(df, "g", "v", 0).collect()}["a"] == 0.5


def test_cluster_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("m", f"r{i}", float(v), 3) for i, v in enumerate(rng.normal(0.5, 0.1, 300))], "m string, r string, v double, n int")
    row = stats.cluster_bootstrap(df, "m", "r", "v", "n", 400).first()
    assert row.low < row.mean < row.high and row.high - row.low < 0.05 and row.n_clusters == 300


def test_linear_fit_of_a_constant(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "x double, y double")
    row = df.agg(*stats.linear_fit("x", "y")).first()
    assert (row.slope, row.intercept) == (0.0, 2.0)


def test_bm25_matches_a_plain_loop(spark):
    docs = {1: "alpha beta beta", 2: "beta gamma", 3: "delta", 4: ""}
    queries = {7: "beta beta alpha nothing", 8: ""}
    d = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    q = spark.createDataFrame(list(queries.items()), "item_id int, text string")
    got = {(r.item_id, r.doc_id): r.score for r in retrieval.bm25_scores(d, q, "doc_id", "item_id").collect()}
    n, avg = len(docs), sum(len(t.split()) for t in docs.values()) / len(docs)
    for doc, words in ((k, v.split()) for k, v in docs.items()):
        score = 0.0
        for term in queries[7].split():
            df = sum(term in v.split() for v in docs.values())
            tf = words.count(term)
            if df and tf:
                score += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
        assert got.get((7, doc), 0.0) == pytest.approx(score)
    assert not any(k[0] == 8 for k in got)
    assert retrieval.bm25_scores(d.where("false"), q, "doc_id", "item_id").count() == 0


def test_packed_context_takes_full_short_or_nothing(spark):
    blocks = spark.createDataFrame([("g", 1, 1.0, 60, 20), ("g", 2, 0.8, 50, 30), ("g", 3, 0.5, 40, 40), ("g", 4, 0.1, 10, 5)], "g string, block_id int, score double, full_size int, short_size int")
    assert [(r.block_id, r.form) for r in retrieval.packed_context(blocks, "g", 100).orderBy("position").collect()] == [(1, "full"), (2, "short"), (4, "full")]


SOURCE = '''import pytest
from a.b import c as d

def helper(x):
    """Doc."""
    return x + 1

class TestThing:
    def test_one(self):
        assert helper(1) == 2
        self.assertEqual(helper(2),
                         3)
        self.assertTrue(helper(0))

def test_two():
    with pytest.raises(ValueError):
        helper("é")
    assert_close(1.0, 1.0)
    assert True
'''


def test_assertions_round_trip():
    found = extraction.assertions(SOURCE)
    assert {(k, t) for k, _, t, *_ in found} == {("assert", "2"), ("self.assertEqual", "3)"), ("self.assertTrue", "helper(0))"), ("pytest.raises", "ValueError)"), ("assert_*", "1.0)"), ("assert", "True")}
    for kind, prefix, target, *_ in found:
        assert SOURCE.startswith(prefix) and SOURCE[len(prefix) :].startswith(target.split()[0][:5]), kind
    assert {f for *_, f in found} == {"test_one", "test_two"}
    assert extraction.assertions("def (") == [] and extraction.assertions("") == [] and extraction.assertions(None) == []


def test_other_table_functions():
    assert [s for s, _ in extraction.chunks("a.py", SOURCE)] == ["helper", "TestThing", "test_two"]
    assert extraction.chunks("a.py", "def (")[0][0] == "<module>" and extraction.chunks("a.py", "  ") == []
    assert ("a.b", "c", 0) in extraction.imports(SOURCE) and ("a.b", "c", 0) in extraction.imports("from a.b import c\ndef (")
    assert extraction.tasks(SOURCE)[0][0] == "helper" and extraction.tasks(SOURCE)[0][2].strip() == "return x + 1"
    assert extraction.compressed(SOURCE).startswith("def helper(x):")
    assert all(before + line in SOURCE for _, _, before, line in extraction.next_blocks(SOURCE))
    assert extraction.spliced("a = 1\nb = 2\n", 2, 4, "7") == "a = 1\nb = 7\n"
    sha = "a" * 40
    assert extraction.blame_lines(f"{sha} 1 2 1\nauthor x\n\tline") == [(2, sha)]
    assert extraction.numstat_lines(f"{sha}\n3\t1\tx.py\n-\t-\tb.bin") == [(sha, 3, 1, "x.py"), (sha, 0, 0, "b.bin")]


def test_principal_axes_match_numpy(spark):
    from braidwork.operators import geometry

    x = np.random.default_rng(3).normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = geometry.principal_axes(df, "id", "v").toPandas().pivot(index="id", columns="axis", values="position").to_numpy()
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(np.sqrt((got**2).sum(axis=0)), s[:2])
    with pytest.raises(ValueError):
        geometry.block_similarity(spark.range(10_001).select("id", F.array(F.lit(1.0)).alias("v")), "id", "v", spark.range(10_001))


def test_diversity_of_all_rows(spark):
    from braidwork.operators import geometry

    x = np.random.default_rng(8).normal(size=(50, 6)) + 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, *rows[:9], (99, None)], "id int, v array<double>")
    u = x - x.mean(axis=0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = geometry.whole_diversity(df, "id", "v").first()
    assert got.n_pairs == 50 * 49 and abs(got.mean_cosine - ((u @ u.T).sum() - 50) / (50 * 49)) < 1e-12
    assert tuple(geometry.whole_diversity(df.where("false"), "id", "v").first()) == (None, 0)


def test_similarity_of_large_stated_sets(spark, monkeypatch):
    from braidwork.operators import geometry

    monkeypatch.setattr(geometry, "AT_ONCE", 16)
    x = np.random.default_rng(9).normal(size=(40, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.a, r.b): r.cosine for r in geometry.similarity(df, "id", "v", df.where("id < 30")).collect()}
    assert set(got) == {(a, b) for a in range(30) for b in range(40) if a != b}
    assert all(abs(c - u[a] @ u[b]) < 1e-9 for (a, b), c in got.items())
