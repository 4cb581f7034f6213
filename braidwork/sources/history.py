"""Version history from exported text: log, tree and blob dumps, and tables in SQLite files.

Exports are made where the repositories are; the cluster reads text. The log is exported with
`--first-parent -M --name-status --format=%x1e%H%x1f%P%x1f%cI`, the tree with `ls-tree -r -l`, blobs
with `cat-file --batch`.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, FIELD = "\x1e", "\x1f"
# Fixed value: the object id that stands for no object.
NO_OBJECT = "0" * 40


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit_sha, parent_sha, ts, position, status, path, old_path), a row per file of each commit.

    Records end at a separator, so that Spark splits large files between tasks. Only the first parent
    is kept; a commit without files gives no row; old_path is null but for renames and copies.
    """
    record = spark.read.option("lineSep", RECORD).text(path).where(F.col("value").contains(FIELD))
    lines = F.split("value", "\n")
    head = F.split(F.element_at(lines, 1), FIELD)
    files = record.select(F.element_at(head, 1).alias("commit_sha"), F.nullif(F.element_at(F.split(F.element_at(head, 2), " "), 1), F.lit("")).alias("parent_sha"), F.btrim(F.element_at(head, 3)).alias("ts"), F.filter(F.slice(lines, 2, 1 << 30), lambda x: x.contains("\t")).alias("files"))
    rows = files.select("commit_sha", "parent_sha", "ts", F.posexplode("files").alias("position", "line"))
    part = F.split("line", "\t")
    return rows.select("commit_sha", "parent_sha", "ts", "position", F.element_at(part, 1).alias("status"), F.element_at(part, -1).alias("path"), F.when(F.size(part) > 2, F.element_at(part, 2)).alias("old_path"))


def log_lines(changes: DataFrame) -> DataFrame:
    """One record a row of (commit_sha, parent_sha, ts, status, path, old_path), as `read_log` reads it; a commit may come in several."""
    file = F.concat_ws("\t", "status", "old_path", "path")
    return changes.select(F.concat(F.concat_ws(FIELD, "commit_sha", F.coalesce("parent_sha", F.lit("")), "ts"), F.lit("\n\n"), file, F.lit("\n")).alias("value"))


def write_log(changes: DataFrame, path: str) -> None:
    log_lines(changes).write.option("lineSep", RECORD).text(path)


def read_tree(spark: SparkSession, path: str, most_bytes: int | None = None, ending: str | None = None) -> DataFrame:
    """(mode, blob_sha, size, path) of the blobs a tree lists, optionally those up to a size and with an ending."""
    line = F.regexp_extract_all("value", F.lit(r"^(\d+) blob ([0-9a-f]{40}) +(\d+)\t(.*)$"), F.lit(0))
    part = lambda k: F.regexp_extract("value", r"^(\d+) blob ([0-9a-f]{40}) +(\d+)\t(.*)$", k)
    rows = spark.read.text(path).where(F.size(line) > 0).select(part(1).alias("mode"), part(2).alias("blob_sha"), part(3).cast("long").alias("size"), part(4).alias("path"))
    rows = rows.where(F.col("size") <= most_bytes) if most_bytes is not None else rows
    return rows.where(F.col("path").endswith(ending)) if ending else rows


def tree_lines(files: DataFrame) -> Column:
    return F.concat(F.lit("100644 blob "), files["blob_sha"], F.lit(" "), F.lpad(files["size"].cast("string"), 7, " "), F.lit("\t"), files["path"])


def blobs_of(dump: bytes) -> list[tuple[str, str]]:
    """(blob_sha, text) of a dump of `cat-file --batch`: headers tell how many bytes follow; what is missing or no blob is left out."""
    out, at = [], 0
    while at < len(dump):
        end = dump.find(b"\n", at)
        head = dump[at : end if end >= 0 else len(dump)].split(b" ")
        if len(head) != 3 or not head[2].isdigit():
            at = end + 1 if end >= 0 else len(dump)
            continue
        size = int(head[2])
        if head[1] == b"blob":
            out.append((head[0].decode(), dump[end + 1 : end + 1 + size].decode("utf-8", "replace")))
        at = end + 1 + size + 1
    return out


def read_blob_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(blob_sha, text) of dump files; a file is a unit of work, so export many of moderate size."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dump in frame.content:
                yield pd.DataFrame(blobs_of(bytes(dump)), columns=["blob_sha", "text"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInPandas(parse, "blob_sha string, text string")


def _mounted(folder: str) -> str:
    """The path of a folder that executors open as files: a mounted share."""
    path = folder.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{folder} is no mounted folder")
    return path


def write_blob_dumps(blobs: DataFrame, folder: str) -> int:
    """Dump (blob_sha, text), a file a task, into a folder that all executors share; returns the number of files."""
    local = _mounted(folder)

    def dump(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        os.makedirs(local, exist_ok=True)
        name = f"{local}/{TaskContext.get().partitionId():06d}.dump"
        with open(name, "wb") as out:  # a task that runs again writes its file anew
            for frame in frames:
                for sha, text in zip(frame.blob_sha, frame.text, strict=True):
                    body = text.encode()
                    out.write(b"%s blob %d\n%s\n" % (sha.encode(), len(body), body))
        yield pd.DataFrame({"name": [name]})

    return blobs.where("blob_sha is not null and text is not null").select("blob_sha", "text").mapInPandas(dump, "name string").count()


def write_sqlite(df: DataFrame, folder: str, table: str, key: Sequence[str], files: int = 8) -> None:
    """K4: insert rows or replace those of equal key, in one SQLite file per hash of the key, in a folder that all executors share.

    A key always belongs to the same file and a file to one task, so no two tasks write to one; each
    task is one transaction. Of rows with one key in df, any may stay.
    """
    local = _mounted(folder)
    names = df.columns

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(local, exist_ok=True)
        open_files: dict[int, sqlite3.Connection] = {}
        for frame in frames:
            for number, part in frame.groupby("_file"):
                if number not in open_files:
                    open_files[number] = sqlite3.connect(f"{local}/{number:04d}.sqlite")
                    open_files[number].execute(f"create table if not exists {table} ({', '.join(names)}, primary key ({', '.join(key)}))")
                rows = part.drop(columns="_file").astype(object)
                open_files[number].executemany(f"insert or replace into {table} values ({', '.join('?' * len(names))})", rows.where(rows.notna(), None).itertuples(index=False))
        for connection in open_files.values():
            connection.commit()
            connection.close()
        yield pd.DataFrame({"n": [len(open_files)]})

    spread = df.withColumn("_file", F.pmod(F.xxhash64(*key), F.lit(files)).cast("int")).repartition(files, "_file")
    spread.mapInPandas(put, "n int").write.format("noop").mode("overwrite").save()


def read_sqlite(spark: SparkSession, paths: Sequence[str], query: str, ddl: str) -> DataFrame:
    """What a query gives in each of several SQLite files; a file is a unit of work and rows are fetched in batches."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame.path:
                connection = sqlite3.connect(f"file:{_mounted(path)}?mode=ro", uri=True)
                cursor = connection.execute(query)
                while rows := cursor.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names)
                connection.close()

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path").mapInPandas(fetch, ddl)
