"""Readers: layouts, nested JSON, TSV, JSONL, id lists, half-precision vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork import schema

LAYOUTS = ("concat", "shards", "hf")


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a pattern, sorted, on whatever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def resolve_layout(spark: SparkSession, root: str, order: Sequence[str] = LAYOUTS) -> tuple[str, list[str], list[str]]:
    """(layout, commit paths, question paths) of the first layout that is complete under root.

    concat: commits.parquet and qna_pairs.parquet; shards: shards/<repo>.commits.parquet with
    <repo>.qna.parquet, paired by stem; hf: commits/*.parquet and qna/*.parquet.
    """
    for layout in order:
        if layout == "concat":
            commits, qna = (_paths(spark, f"{root}/{n}.parquet") for n in ("commits", "qna_pairs"))
        elif layout == "shards":
            by_stem = [{p.rsplit("/", 1)[1].removesuffix(f".{kind}.parquet"): p for p in _paths(spark, f"{root}/shards/*.{kind}.parquet")} for kind in ("commits", "qna")]
            commits, qna = ([side[s] for s in sorted(by_stem[0].keys() & by_stem[1].keys())] for side in by_stem)
        elif layout == "hf":
            commits, qna = (_paths(spark, f"{root}/{n}/*.parquet") for n in ("commits", "qna"))
        else:
            raise ValueError(f"unknown layout {layout}")
        if commits and qna:
            return layout, commits, qna
    raise FileNotFoundError(f"no complete layout of {', '.join(order)} under {root}")


def load_tables(spark: SparkSession, root: str, order: Sequence[str] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """Both tables, files with fewer columns included."""
    _, commits, qna = resolve_layout(spark, root, order)
    read = lambda paths: spark.read.option("mergeSchema", True).parquet(*paths)
    return read(commits), schema.with_defaults(read(qna), {"assertion_event_id": "", "task": "assert_rhs"})


def scan(df: DataFrame, columns: Sequence[str] | None = None, **conditions: object) -> DataFrame:
    """Projection and filters, both left to the scan."""
    out = df.where(schema.equality_filter(**conditions))
    return schema.known_columns(out, list(columns)) if columns else out


def read_split_file(spark: SparkSession, path: str, with_embedding: bool = False, a_line_each: bool = False) -> DataFrame:
    """One row per valid pair of a nested split file; with_embedding keeps only repositories that have one.

    A file is one document, or, with a_line_each, has one on every line, as `write_split_files` writes it.
    """
    rows = spark.read.schema(schema.SPLIT_FILE).option("multiLine", not a_line_each).json(path).select(F.explode("repositories").alias("repo_id", "r"))
    if with_embedding:
        rows = rows.where(F.size("r.embedding") > 0)
    pairs = rows.select("repo_id", *(["r.embedding"] if with_embedding else []), F.posexplode("r.qna_pairs").alias("position", "p")).select("*", "p.*").drop("p")
    from braidwork.functions.text import is_valid_pair

    return pairs.where(is_valid_pair(F.col("prefix"), F.col("target")))


def ordered_bench(pairs: DataFrame, per_repo: int, repos: int | None = None) -> DataFrame:
    """The first pairs of each repository by commit and id, a (prefix, target) once, of the first repositories by name.

    Text is compared by its hash and fetched for the chosen pairs only; the best few of a repository
    are kept by every task before they are shuffled.
    """
    narrow = pairs.select("repo_id", "commit_index", "qna_id", F.sha2("prefix", 256).alias("_p"), F.sha2(F.coalesce("target", F.lit("")), 256).alias("_t"))
    first = narrow.groupBy("repo_id", "_p", "_t").agg(F.min(F.struct("commit_index", "qna_id")).alias("k")).select("repo_id", "k.*")
    if repos is not None:
        first = first.join(first.select("repo_id").distinct().orderBy("repo_id").limit(repos), "repo_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy("commit_index", "qna_id"))
    kept = first.withColumn("rank", rank).where(F.col("rank") <= per_repo).select("qna_id", "rank")
    return pairs.dropDuplicates(["qna_id"]).join(kept, "qna_id")


def read_bench(spark: SparkSession, path: str, per_repo: int, repos: int | None = None, a_line_each: bool = False) -> DataFrame:
    """The first valid pairs of each repository of a nested split file, of the first repositories by name."""
    rows = read_split_file(spark, path, a_line_each=a_line_each)
    if repos is not None:
        rows = rows.join(rows.select("repo_id").distinct().orderBy("repo_id").limit(repos), "repo_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy("position"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_repo)


def repositories(df: DataFrame, key: str = "repo_id") -> Iterator[tuple[str, DataFrame]]:
    """Each repository with its rows, which are read when they are used and not before; names come one by one."""
    for row in df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).toLocalIterator():
        yield row[0], df.where(F.col(key) == row[0])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S25"""
    return spark.read.csv(path, sep="\t", header=True, schema=schema.MANIFEST)


def read_mined(spark: SparkSession, path: str) -> DataFrame:
    """S24, S32"""
    return spark.read.schema(schema.MINED).json(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines and those that begin with # are left out."""
    line = F.btrim("value", F.lit(" \t\r\n"))
    return spark.read.text(path).select(line.alias("repo_id")).where((F.col("repo_id") != "") & ~F.col("repo_id").startswith("#"))


def read_shard_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Per-commit rows and raw samples of all result files; samples keep their position in their file."""
    files = spark.read.schema(schema.SHARD_FILE).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    per_commit = files.select("file", "shard_i", F.explode("per_commit").alias("c")).select("file", "shard_i", "c.*")
    raw = files.select("file", F.posexplode(F.arrays_zip("raw_samples.exact_match", "raw_samples.edit_similarity", "raw_samples.code_bleu")).alias("position", "z")).select("file", "position", "z.*")
    return per_commit, raw


def read_files(spark: SparkSession, root: str, endings: Sequence[str], most_bytes: int) -> DataFrame:
    """(path, length, content) of files with one of the endings, no longer than most_bytes, outside skipped folders."""
    from braidwork.functions.text import in_skipped_folder, path_ending

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where((F.col("length") <= most_bytes) & path_ending(F.col("path")).isin(*endings) & ~in_skipped_folder(F.col("path"))).select("path", "length", "content")


def read_half_vectors(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], vector: str) -> DataFrame:
    """Half-precision vectors, which Spark's reader refuses: Arrow reads each row group and widens it.

    Row groups, not files, are the unit of work, so a large file is spread over tasks.
    """
    import pyarrow.parquet as pq

    units = [(p, g) for p in paths for g in range(pq.ParquetFile(p).num_row_groups)]
    first = pq.read_schema(paths[0])
    kinds = {pa.string(): "string", pa.large_string(): "string", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}
    ddl = ", ".join(f"{c} {kinds[first.field(c).type]}" for c in columns) + f", {vector} array<float>"

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, group in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                for part in pq.ParquetFile(path).read_row_group(group, columns=[*columns, vector]).to_batches():
                    half = part.column(vector)
                    lengths = np.asarray(half.value_lengths().fill_null(0)) if not pa.types.is_fixed_size_list(half.type) else np.where(np.asarray(half.is_valid()), half.type.list_size, 0)
                    numbers = half.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), mask=np.append(~np.asarray(half.is_valid()), False))
                    wide = pa.ListArray.from_arrays(offsets, pa.array(numbers))
                    texts = [part.column(c).cast(pa.string()) if pa.types.is_large_string(part.column(c).type) else part.column(c) for c in columns]
                    yield pa.RecordBatch.from_arrays([*texts, wide], names=[*columns, vector])

    return spark.createDataFrame(units, "path string, row_group int").repartition(max(1, len(units))).mapInArrow(widen, ddl)
