from __future__ import annotations

import json

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from braidwork import schema
from braidwork.plans import catalog
from braidwork.session import checkpoint_root, cut_lineage, table
from braidwork.sources import readers, sinks
from braidwork.streaming import stateful

DATA = "/root/testdata/sf0.001"


def test_layouts_in_either_order(spark, tmp_path):
    one = spark.createDataFrame([("r", 1)], "repo_id string, commit_index int")
    for name in ("commits/part", "qna/part", "shards/r.commits", "shards/r.qna", "shards/lone.commits"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        pq.write_table(pa.Table.from_pylist([{"repo_id": "r", "commit_index": 1}]), f"{tmp_path}/{name}.parquet")
    assert readers.resolve_layout(spark, str(tmp_path))[0] == "shards"
    assert readers.resolve_layout(spark, str(tmp_path), ("concat", "hf", "shards"))[0] == "hf"
    assert len(readers.resolve_layout(spark, str(tmp_path))[1]) == 1
    commits, qna = readers.load_tables(spark, str(tmp_path))
    assert commits.count() == one.count() and qna.first().task == "assert_rhs"
    with pytest.raises(FileNotFoundError):
        readers.resolve_layout(spark, str(tmp_path / "qna"))


def test_filters_reach_the_scan(spark):
    df = readers.scan(table(spark, DATA, "commits"), ["repo_id", "absent", "commit_sha"], in_repo_split="train", cross_repo_split=["train", "cr_val"], commit_sha=None)
    assert df.columns == ["repo_id", "commit_sha"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(cross_repo_split" in plan and "production_code_diff" not in plan
    with pytest.raises(TypeError):
        schema.equality_filter(x={})


def test_defaults_fill_absent_and_null(spark):
    df = spark.createDataFrame([("r", None)], "repo_id string, test_function string")
    row = schema.with_defaults(df, {"test_function": "", "anchor_index": -1}).first()
    assert (row.test_function, row.anchor_index) == ("", -1)


def test_split_files_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("r1", 0, "p", "t", "assert", "variable", 3), ("r1", 1, "p2", "t2", "assert", "variable", 3), ("r2", 0, "p", ", bad", "assert", "x", 1)], "repo_id string, position int, prefix string, target string, assertion_type string, difficulty string, context_lines int")
    sinks.write_split_files(pairs, str(tmp_path / "split"))
    got = readers.read_split_file(spark, str(tmp_path / "split"))
    assert sorted((r.repo_id, r.position, r.target) for r in got.collect()) == [("r1", 0, "t"), ("r1", 1, "t2")]
    assert readers.read_split_file(spark, str(tmp_path / "split"), with_embedding=True).count() == 0


def test_text_formats_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r", "s", 1, "train", "a", -1, 0)], schema.MANIFEST)
    sinks.write_manifest(rows, str(tmp_path / "m"))
    assert readers.read_manifest(spark, str(tmp_path / "m")).collect() == rows.collect()
    for _ in range(2):
        sinks.append_lines(spark.createDataFrame([("o/n", 5)], "full_name string, stars int"), str(tmp_path / "j"))
    assert readers.read_mined(spark, str(tmp_path / "j")).where("stars = 5").count() == 2
    (tmp_path / "ids.txt").write_text("# head\n\n a/b \nc/d\n")
    assert [r.repo_id for r in readers.read_id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a/b", "c/d"]
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1


def test_partitions_are_replaced_alone(spark, tmp_path):
    both = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.write_tables(both, str(tmp_path / "t"), ["k"])
    sinks.replace_partitions(spark.createDataFrame([("b", 9)], "k string, v int").select("v", "k"), str(tmp_path / "t"), ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 9)}


def test_registry_and_provenance(spark, tmp_path):
    log = spark.createDataFrame([("f", 1, "old"), ("f", 3, "new"), ("g", 2, "only")], "fingerprint string, seq int, v string")
    assert [r.v for r in sinks.registry_view(log).collect()] == ["new", "only"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x")
    (tmp_path / "src/b.bin").write_text("y" * 50)
    files = readers.read_files(spark, str(tmp_path / "src"), [".py"], 10)
    assert sinks.provenance(files).first().sha256 == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_shard_results(spark, tmp_path):
    body = {"finalized": True, "shard_i": 0, "num_shards": 1, "per_commit": [{"repo_id": "r", "commit_sha": "s", "n_qnas": 2, "exact_match": 0.5}], "raw_samples": {"exact_match": [1.0, 0.0], "edit_similarity": [0.9], "code_bleu": [0.1, 0.2]}}
    (tmp_path / "s.json").write_text(json.dumps(body))
    per_commit, raw = readers.read_shard_results(spark, str(tmp_path / "s.json"))
    assert per_commit.first().n_qnas == 2
    assert [(r.position, r.exact_match, r.edit_similarity) for r in raw.orderBy("position").collect()] == [(0, 1.0, 0.9), (1, 0.0, None)]


def test_half_precision_vectors(spark, tmp_path):
    rows = pa.table({"repo_id": pa.array(["a", "b"], pa.large_string()), "v": pa.array([[np.float16(0.5), np.float16(2)], None], pa.list_(pa.float16()))})
    pq.write_table(rows, tmp_path / "h.parquet")
    got = readers.read_half_vectors(spark, [str(tmp_path / "h.parquet")], ["repo_id"], "v")
    assert {r.repo_id: r.v for r in got.collect()} == {"a": [0.5, 2.0], "b": None}


CHANGES = [("r", 1, "A", "a", None, [1, 2]), ("r", 2, "R100", "b", "a", [1, 2]), ("r", 3, "M", "b", "", [1, 2, 3]), ("r", 4, "D", "b", None, None), ("r", 5, "A", "b", None, [1]), ("q", 1, "A", "a", None, [])]
DDL = "repo_id string, seq int, status string, path string, old_path string, keys array<long>"
WANT = {("r", 1, "a", 2), ("r", 3, "b", 1), ("r", 5, "b", 1)}


def test_new_assertions_follow_renames_and_deletions(spark):
    df = spark.createDataFrame(CHANGES, DDL)
    assert {tuple(r) for r in stateful.new_assertions(df).collect()} == WANT
    assert stateful.new_assertions(df.where("false")).count() == 0


def test_new_assertions_on_a_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf", reason="the state server needs it")
    for n, part in enumerate((CHANGES[:3], CHANGES[3:])):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b*"))
    query = stateful.stream_new_assertions(stream).writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.sql("select * from fresh").collect()} == WANT


def test_recurrent_walk(spark):
    rows = spark.createDataFrame([("g", 2, [3.0]), ("g", 1, [1.0]), ("g", 3, None), ("h", 1, None)], "g string, o int, v array<float>")
    got = {(r.g, r.o): r.state for r in stateful.recurrent_walk(rows, "g", "o", "v").collect()}
    assert got == {("g", 1): [1.0], ("g", 2): [2.0], ("g", 3): [2.0], ("h", 1): None}


def test_lineage_is_cut_in_the_shared_folder(spark):
    assert checkpoint_root(spark).startswith("file:") and "shared" in checkpoint_root(spark)
    assert cut_lineage(spark.range(5)).count() == 5


@pytest.mark.parametrize("name", ["w_split_anchor_decay", "p5_found", "p5_repo_summary", "j_asof_forward", "a_cap_grid", "f_filtered_diff", "r_bm25"])
def test_some_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("commits", "qna_pairs", "snapshots", "events", "documents", "heldout_items"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    shown = lambda rows: sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert shown(catalog.QUERIES[name](spark, DATA).select(*columns).collect()) == shown(want.fetchall())


def test_every_query_has_distinct_names_and_runs_lazily(spark):
    assert len(catalog.QUERIES) > 120
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    df = catalog.QUERIES["a_value_counts"](spark, DATA)
    assert df.where(F.col("n") < 0).count() == 0
