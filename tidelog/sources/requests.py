"""Ingest requests: JSON texts of the form ``{"logs": [...]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Where a request was read, in reading order; unique together with the row in the split.
SPLIT = ["file_time", "file_path", "file_block"]


def read_requests(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    whole_files: bool = False,
    **limits: object,
) -> DataFrame:
    """One request per text line, or per file with ``whole_files``.

    ``limits`` are file source options: ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger`` bound a micro-batch. A request is never split over
    two batches; what does not fit waits in the source.
    """
    reader = spark.readStream if streaming else spark.read
    lines = reader.options(**limits).text(path, wholetext=whole_files)
    return lines.filter(F.trim("value") != "").select(
        F.col("value").alias("body"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block"),
    )


def with_logs(requests: DataFrame, name: str, body: str = "body") -> DataFrame:
    """The ``logs`` array in place of the body; NULL where it does not parse, has none or an empty one.

    Each entry is a VARIANT of its own, so a request may be of any size; of repeated
    keys the last one counts (a setting of the session, made here). The array is a
    column before it is looked at, so that the body is parsed once.
    """
    requests.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    kept = [column for column in requests.columns if column != body]
    parsed = requests.select(*kept, F.from_json(body, "logs array<variant>")["logs"].alias(name))
    return parsed.withColumn(name, F.when(F.size(name) > 0, F.col(name)))


def request_entries(requests: DataFrame) -> DataFrame:
    """One row per log entry with its array index; a bad request keeps one row.

    A bad request (see :func:`with_logs`) gives a row whose ``index`` is NULL.
    The ``body`` column goes, the rest stays.
    """
    kept = [name for name in requests.columns if name != "body"]
    return with_logs(requests, "_logs").select(*kept, F.posexplode_outer("_logs").alias("index", "entry"))


def explode_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entries, bad_requests)``."""
    rows = request_entries(requests)
    return (
        rows.filter(F.col("index").isNotNull()),
        rows.filter(F.col("index").isNull()).drop("index", "entry"),
    )
