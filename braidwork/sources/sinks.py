"""Writers: partitioned Parquet, JSON, TSV, CSV, registries and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_tables(df: DataFrame, path: str, by: Sequence[str] = ("cross_repo_split",), codec: str = "zstd", mode: str = "overwrite") -> None:
    """K1-K3: Parquet by partition; the committer makes it all or nothing."""
    df.write.mode(mode).option("compression", codec).partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """K4: only partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """K5"""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def split_file(pairs: DataFrame, at_once: int = 1000) -> DataFrame:
    """K6: JSON documents as read back by the split reader, each with up to `at_once` pairs of one repository, by position."""
    pair = F.struct("prefix", "target", "assertion_type", "difficulty", "context_lines")
    lists = pairs.groupBy("repo_id", F.floor(F.col("position") / at_once)).agg(F.array_sort(F.collect_list(F.struct("position", pair.alias("p")))).alias("l"))
    body = F.struct(F.lit(None).cast("array<double>").alias("embedding"), F.col("l.p").alias("qna_pairs"))
    return lists.select(F.to_json(F.struct(F.create_map("repo_id", body).alias("repositories"))).alias("value"))


def write_split_files(pairs: DataFrame, path: str) -> None:
    split_file(pairs).write.mode("overwrite").text(path)


def append_lines(df: DataFrame, path: str) -> None:
    """K7"""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K8"""
    df.write.mode("overwrite").csv(path, header=True)


def registry_view(log: DataFrame, key: str = "fingerprint", order: str = "seq") -> DataFrame:
    """Of an append-only log the last entry of each key, newest first."""
    last = log.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")
    return last.orderBy(F.desc(order))


def provenance(files: DataFrame) -> DataFrame:
    """(path, sha256) of binary files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def concat_shards(spark: SparkSession, paths: Sequence[str], path: str, files: int) -> None:
    """K2: several tables of one shape as one, in a given number of files."""
    spark.read.option("mergeSchema", True).parquet(*paths).repartition(files).write.mode("overwrite").parquet(path)


def upserted(base: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """K4: base with the rows of changes put in, or in place of rows of equal key; changes hold a key once."""
    return base.join(changes.select(*key), list(key), "left_anti").unionByName(changes)


def append_batch(path: str):
    """For foreachBatch; a batch that is written again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        replace_partitions(batch.withColumn("batch", F.lit(number)), path, ["batch"])

    return write
