"""Small text files and folders on whatever file system Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _locate(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """``(name, modification time in ms)`` of the entries of a folder."""
    target, fs = _locate(spark, path)
    if not fs.exists(target):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(target)]


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _locate(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def try_read_text(spark: SparkSession, path: str) -> str | None:
    return read_text(spark, path) if exists(spark, path) else None


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _locate(spark, path)
    return fs.exists(target)


def find(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern with ``*``."""
    target, fs = _locate(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(target) or [])


def write_text(spark: SparkSession, path: str, text: str, over: bool = False) -> None:
    """Write under another name, then rename: readers see all of it or nothing.

    ``over`` replaces a note that nobody relies on: for a moment there may be none.
    """
    target, fs = _locate(spark, path)
    draft, _ = _locate(spark, path + ".draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    if over:
        fs.delete(target, False)
    if fs.exists(target) or not fs.rename(draft, target):
        raise RuntimeError(f"another writer created {path}")


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _locate(spark, path)
    fs.delete(target, True)
