from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.functions import text, vectors
from braidwork.operators import context, geometry, joins, ordering, retrieval, skew, stats
from braidwork.sources import history, readers, sinks
from braidwork.streaming import stateful


def test_positions_of_a_hot_group_and_of_nulls(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, id long").withColumn("_n", F.lit("clash"))
    got = {r.id: r.position for r in ordering.positions(df, ["g"], ["o", "id"]).collect()}
    want = {}
    for g in ("hot", "a", "b", None):
        want |= {r[2]: k for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]))}
    assert got == want
    before = {r.id: r.previous for r in ordering.neighbours(df, ["g"], ["o", "id"], "id").collect()}
    by_place = {(g, want[i]): i for g, _, i in rows}
    assert before == {i: by_place[g, want[i] - 1] for g, _, i in rows if want[i]}
    assert ordering.positions(df.where("false"), ["g"], ["o"]).count() == 0


def test_running_offsets(spark):
    rng = random.Random(2)
    sizes = [(f"k{i:04d}", rng.randint(1, 4)) for i in range(300)]
    groups = spark.createDataFrame(sizes, "k string, n int").repartition(7)
    total = sum(n for _, n in sizes)
    values = spark.createDataFrame([(i, float(i)) for i in range(total - 5)], "at long, v double")
    got = {(r.k, r.position): r.v for r in joins.by_running_offset(groups, values, "k", "n", "v", "at").collect()}
    want, at = {}, 0
    for k, n in sorted(sizes):
        for i in range(n):
            want[k, i] = float(at) if at < total - 5 else None
            at += 1
    assert got == want


def test_chains_of_any_length(spark):
    links = [(f"c{i}", f"c{i + 1}") for i in range(65)] + [("x", "y"), ("y", "x"), (None, "c0"), ("z", None), ("c3", "c4")]
    df = spark.createDataFrame(links, "a string, b string")
    goal = spark.createDataFrame([("c65",), (None,)], "t string")
    assert {r.a for r in joins.chain_hits(df, "a", "b", goal).collect()} == {f"c{i}" for i in range(65)}
    assert joins.chain_hits(df.where("false"), "a", "b", goal).count() == 0


def test_key_summary_with_nulls_and_redelivery(spark):
    rows = [("r", f"s{i}", i % 4) for i in range(400)] + [(None, "n1", 3), ("q", "n2", None), ("r", None, 9)]
    df = spark.createDataFrame(rows + rows[:50], "repo_id string, commit_sha string, n_new_assertions int").withColumn("_k", F.lit("clash"))
    got = {r.repo_id: (r.n_commits, r.sum_value, r.median_value) for r in skew.balanced_key_summary(df).collect()}
    assert got == {"r": (400, 600, 1.5), None: (1, 3, 3.0), "q": (1, None, None)}
    assert [r.repo_id for r in skew.heavy_keys(df).collect()] == ["r"]
    plan = skew.balanced_key_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert skew.balanced_key_summary(df.where("false")).count() == 0 and skew.heavy_keys(df.where("false")).count() == 0


def test_intervals_of_many_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(2.0, 1.0, 4000)
    df = spark.createDataFrame([("g", float(v), float(v) / 2) for v in x] + [(None, 1.0, 1.0)], "g string, a double, b double")
    got = {r.metric: r for r in stats.bootstrap_intervals(df, "g", ["a", "b"], 400).collect()}
    half = 1.96 * x.std() / np.sqrt(len(x))
    for name, scale in (("a", 1.0), ("b", 0.5)):
        assert abs(got[name].mean - x.mean() * scale) < 1e-9 and got[name].n == 4000
        assert abs((got[name].high - got[name].low) / 2 - half * scale) < 0.2 * half * scale
    shards = [df.where(F.col("a") < 2), df.where(F.col("a") >= 2)]
    merged = {r.metric: r for r in stats.merged_intervals(shards, "g", ["a"], 400).collect()}
    assert abs(merged["a"].low - got["a"].low) < 1e-9 and abs(merged["a"].high - got["a"].high) < 1e-9


def test_power_fit_recovers_its_law(spark):
    df = spark.createDataFrame([(float(n), 100 - 40.0 * n**-0.2) for n in (1, 5, 10, 60, 200)] + [(0.0, 5.0), (3.0, 100.0)], "n double, em double")
    row = df.agg(*stats.power_fit("n", "em")).first()
    assert abs(row.c - 40) < 1e-6 and abs(row.alpha + 0.2) < 1e-9 and abs(row.r2 - 1) < 1e-9


def test_outliers_and_mixed_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 5)))] + [(99, [50.0] * 5), (100, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r.id: r.outlier for r in geometry.principal_axes(df, "id", "v").where("axis = 0").collect()}
    assert len(got) == 61 and max(got, key=got.get) == 99
    assert geometry.principal_axes(df.where("false"), "id", "v").count() == 0
    with pytest.raises(ValueError, match="length"):
        geometry.principal_axes(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<float>"), "id", "v")


def test_clamp_step_input_and_scores(spark):
    row = spark.createDataFrame([(9.0, [1.0], [2.0], "call(x) obj.y z")], "x double, a array<float>, b array<float>, p string").select(
        vectors.clamp(F.col("x"), 1.0, 5.0).alias("c"), vectors.step_input(F.col("a"), F.col("b"), "concat").alias("s"),
        *(text.block_score(F.array(F.lit(n)), F.col("p")).alias(n) for n in ("call", "obj", "z", "none")), text.n_asserts(F.lit("assert x\nself.assertEqual(a, b)\nwith pytest.raises(E): pass\nreassert")).alias("n"),
    ).first()
    assert (row.c, list(row.s), row["call"], row.obj, row.z, row["none"], row.n) == (5.0, [1.0, 2.0], 1.0, 0.8, 0.5, 0.1, 3)


def test_prompts(spark):
    q = spark.createDataFrame([(1, "p("), (2, "r(")], "q int, prefix string")
    ex = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "q int, rank int, e string")
    got = {r.q: r.prompt for r in retrieval.few_shot_prompts(q, ex, "q", "prefix", "e", "rank").collect()}
    assert got == {1: "# Examples of assertion completions:\n\na\n\n# ---\n\nb\n\n# ---\n\n# Now complete the following assertion:\np(", 2: "r("}


SOURCE = '''import os
from pkg.core import make

LIMIT = 3


@pytest.fixture
def thing():
    return make()


def helper(x):
    return x + 1


def test_other():
    assert helper(1) == 2


class TestIt(Base):
    size = 4

    def setUp(self):
        self.x = 1

    def test_it(self):
        y = helper(self.x)
        assert y == 2
'''


def test_structured_prefix():
    line = SOURCE.split("\n").index("        assert y == 2") + 1
    got = context.structured_prefix(SOURCE, line, 20, "test_it")
    for part in ("import os", "LIMIT = 3", "class TestIt(Base):", "size = 4", "self.x = 1", "def helper(x):", "def thing():", "y = helper(self.x)"):
        assert part in got, part
    assert "test_other" not in got and got.endswith("        assert y ==\n")
    assert context.structured_prefix(SOURCE, line, 20, "test_it", 2).count("\n") == 2
    assert context.structured_prefix("def broken(", 1, 0, "t") is None and context.structured_prefix("x = 1", 9, 0, "t") is None
    assert context.last_lines_prefix(SOURCE, line, 20, 2) == "        y = helper(self.x)\n        assert y == "
    found = context.contextual_assertions(SOURCE)
    assert [f[3] for f in found] == ["2", "2"] and context.contextual_assertions(None) == []


def test_condensed_sources_and_test_content():
    got = context.condensed_source(SOURCE, ["helper", "setUp"])
    assert "import os" in got and "def helper(x):" in got and "class TestIt(Base):" in got and "def test_other" not in got and "return x + 1" not in got
    assert context.condensed_source(SOURCE, None, 3).endswith("# ... (truncated)") and context.condensed_source(None) == ""
    assert [context.is_test_content(s) for s in (SOURCE, "import pytest", "x = 1", None, "from unittest import (", "def testing(): pass")] == [True, True, False, False, True, True]


def test_imports_are_resolved_to_definitions(spark):
    files = [
        ("r", "src/pkg/core.py", "def make():\n    return 1\n\nSIZE = 4\n"), ("r", "src/pkg/__init__.py", "from src.pkg.core import make\n"), ("r", "src/pkg/sub.py", "x = 1\n"), ("r", "tests/test_a.py", "from pkg.core import SIZE, missing\nfrom pkg import make, sub\nimport os\n"),
        ("r", "src/pkg/rel.py", "from .core import make\n"), ("other", "tests/test_b.py", "from pkg.core import make\n"), (None, "x.py", "def make(): pass"), ("r", "broken.py", None),
    ]
    df = spark.createDataFrame(files, "repo_id string, path string, text string")
    got = {(r.path, r.name): (r.file, r.definition) for r in context.resolved_imports(df).collect()}
    assert got["tests/test_a.py", "SIZE"] == ("src/pkg/core.py", "SIZE = 4") and got["tests/test_a.py", "make"][0] == "src/pkg/core.py"
    assert got["tests/test_a.py", "sub"] == ("src/pkg/sub.py", None) and got["src/pkg/rel.py", "make"][0] == "src/pkg/core.py"
    assert ("tests/test_a.py", "missing") not in got and ("tests/test_b.py", "make") not in got
    taken = context.import_context(df, 30).where("path = 'tests/test_a.py'").orderBy("position").collect()
    assert [r.name for r in taken][0] == "SIZE" and all(r.form == "full" for r in taken)
    assert context.resolved_imports(df.where("false")).count() == 0


def test_history_exports(spark, tmp_path):
    log = "\x1e" + "a" * 40 + "\x1f" + "b" * 40 + " " + "c" * 40 + "\x1f2024-01-01T00:00:00+00:00\n\nM\tx.py\nR090\told name.py\tnew name.py\n\n\x1e" + "b" * 40 + "\x1f\x1f2023-01-01T00:00:00+00:00\n\nA\tx.py\n"
    (tmp_path / "log.txt").write_text(log)
    got = [(r.commit_sha[0], (r.parent_sha or "")[:1], r.status, r.path, r.old_path) for r in history.read_log(spark, str(tmp_path / "log.txt")).orderBy("commit_sha", "position").collect()]
    assert got == [("a", "b", "M", "x.py", None), ("a", "b", "R090", "new name.py", "old name.py"), ("b", "", "A", "x.py", None)]
    (tmp_path / "tree.txt").write_text("100644 blob " + "d" * 40 + "     120\tsrc/a b.py\n040000 tree " + "e" * 40 + "       -\tsrc\n100644 blob " + "f" * 40 + " 9999999\tbig.py\n")
    assert [tuple(r) for r in history.read_tree(spark, str(tmp_path / "tree.txt"), 1000).collect()] == [("100644", "d" * 40, 120, "src/a b.py")]
    dump = b"%s blob 5\nab\ncd\n%s missing\n%s tree 2\nxy\n%s blob 0\n\n" % tuple(c * 40 for c in (b"1", b"2", b"3", b"4"))
    assert history.blobs_of(dump) == [("1" * 40, "ab\ncd"), ("4" * 40, "")]


def test_sqlite_upsert_and_lazy_repositories(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")], "k string, n int, t string")
    where = f"file:{tmp_path}/db"
    history.write_sqlite(df, where, "rows", ["k"], 3)
    history.write_sqlite(df.where("k = 'b'").withColumn("n", F.lit(20)), where, "rows", ["k"], 3)
    paths = readers._paths(spark, f"{where}/*.sqlite")
    got = history.read_sqlite(spark, paths, "select k, n, t from rows where n > 1 order by k", "k string, n int, t string")
    assert {tuple(r) for r in got.collect()} == {("b", 20, "x"), ("c", 3, "y")}
    parts = {name: rows.count() for name, rows in readers.repositories(df.unionByName(df.where("k = 'a'")), "k")}
    assert parts == {"a": 2, "b": 1, "c": 1}


def test_batches_that_are_written_again_replace_themselves(spark, tmp_path):
    write = sinks.append_batch(str(tmp_path / "out"))
    for number, rows in ((0, [1, 2]), (1, [3]), (1, [3, 4])):
        write(spark.createDataFrame([(r,) for r in rows], "x int"), number)
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]


def test_half_precision_vectors(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    half = pa.array([[np.float16(0.5), np.float16(-2)], None, [], [np.float16(1)]], pa.list_(pa.float16()))
    pq.write_table(pa.table({"id": pa.array([1, 2, 3, 4], pa.int64()), "v": half}), tmp_path / "h.parquet", row_group_size=2)
    got = {r.id: None if r.v is None else list(r.v) for r in readers.read_half_vectors(spark, [str(tmp_path / "h.parquet")], ["id"], "v").collect()}
    assert got == {1: [0.5, -2.0], 2: None, 3: [], 4: [1.0]}


def test_every_step_is_evaluated(spark):
    rows = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [1.0, 0.0]), ("g", 3, None), ("g", 4, [0.0, 2.0]), ("h", 1, [1.0, 1.0])], "g string, o int, v array<float>")
    got = {(r.g, r.o): round(r.score, 6) for r in stateful.evaluated_walk(rows, "g", "o", "v").collect()}
    assert got == {("g", 2): 1.0, ("g", 4): 0.0}


def test_ties_in_dense_search_are_kept(spark):
    base = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0]), (101, [1.0])], "b long, v array<float>").coalesce(1)
    got = [r.b for r in retrieval.dense_top_k(base, base.where("b = 39").withColumnRenamed("b", "q"), "b", "q", "v", 3).orderBy("rank").collect()]
    assert got == [0, 1, 2]


def test_best_by_bm25_are_exact(spark):
    rng = random.Random(6)
    rare = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(["the", "of", "a"]) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(900, None), (901, "")]
    asked = [(1, "the t3 of t9 t9 a"), (2, "the of"), (3, "unknown"), (4, ""), (5, "t1 the t1"), (6, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").withColumn("s", F.lit(1)), spark.createDataFrame(asked, "item_id int, text string")
    got = {(r.item_id, r.rank): (r.doc_id, round(r.score, 6)) for r in retrieval.bm25_top_k(d, q, "doc_id", "item_id", 7).collect()}
    every = {}
    for r in retrieval.bm25_scores(d, q, "doc_id", "item_id").collect():
        every.setdefault(r.item_id, []).append((-round(r.score, 6), r.doc_id))
    want = {(i, k): (doc, -s) for i, rows in every.items() for k, (s, doc) in enumerate(sorted(rows)[:7])}
    assert got == want and len(want) == 21
    assert retrieval.bm25_top_k(d.where("false"), q, "doc_id", "item_id", 7).count() == 0


def test_small_scans_are_spread_and_others_left(spark, tmp_path):
    from braidwork.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    wide = spread(one)
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and wide.distinct().count() == 100
    many = spark.range(0, 100, 1, 9)
    assert spread(many) is many
    shuffled = one.groupBy("id").count()
    assert spread(shuffled) is shuffled


@pytest.mark.parametrize("name", ["x_metric_struct", "z_evaluated_walk", "e_contextual", "e_condensed", "e_next_blocks", "f_test_content", "r_compressed"])
def test_queries_without_sql_give_rows(spark, name):
    from braidwork.plans import catalog

    rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and name not in catalog.ORACLE
