"""Session factory, table loading and lineage cutting."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("braidwork")
    spark = builder.config(map=settings).getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_braidwork_shipped", False):
        return
    here = Path(__file__).resolve().parent
    base = os.path.join(tempfile.mkdtemp(prefix="braidwork-"), "braidwork")
    context.addPyFile(shutil.make_archive(base, "zip", here.parent, here.name))
    context._braidwork_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where that is unset, a local session gets one of our own, and a cluster an error: a folder of one machine would lose data there."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "braidwork-checkpoints"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, where it outlives its executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer partitions than there are cores; for work in Python that follows.

    A file of a few megabytes is one task otherwise. Rows are the same either way; inputs with more
    partitions, and those that were shuffled already, stay as they are.
    """
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, column pruning included. The table goes when the application ends, or by `drop_stored`."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    context = spark.sparkContext
    context._braidwork_stored = [*getattr(context, "_braidwork_stored", []), path]
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that `stored` wrote in this context; call it when no result that reads them is still wanted."""
    context = spark.sparkContext
    paths = getattr(context, "_braidwork_stored", [])
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    context._braidwork_stored = []
    return len(paths)
