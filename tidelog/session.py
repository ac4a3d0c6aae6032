"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Size of a partition when this library chooses how many there are; beyond so many of them they grow.
PARTITION_BYTES = 64 * 1024 * 1024
MANY_PARTITIONS, LARGE_PARTITION_BYTES = 20_000, 512 * 1024 * 1024
# What Spark gives for tables whose size it cannot tell is beyond this.
UNKNOWN_BYTES = 1 << 62
# At most this many rows of a metadata table are broadcast; above it the join shuffles.
BROADCAST_ROWS = 200_000


def local_session(cpus: int | str = 8, app: str = "tidelog") -> SparkSession:
    """A session for one machine; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus).replace("*", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.maxConcurrentOutputFileWriters", "16")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; where unset, a new local one in local mode.

    On a cluster each executor has a disk of its own, so there a folder must be named.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidelog-")
        context.setCheckpointDir(folder)
    return folder


def new_dir(spark: SparkSession, name: str) -> str:
    """Path of a folder of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read back.

    A table rather than ``checkpoint()``: compressed, and a later step reads
    only the columns it needs.
    """
    path = new_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame) -> int:
    """A partition count that grows with the bytes of the tables that ``df`` scans.

    Small data gets one partition per core, or the configured shuffle partitions if fewer.
    """
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = min(configured, spark.sparkContext.defaultParallelism)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(s for s in sizes if s < UNKNOWN_BYTES)
    usual = -(-size // PARTITION_BYTES)
    return max(least, min(usual, max(MANY_PARTITIONS, -(-size // LARGE_PARTITION_BYTES))))
