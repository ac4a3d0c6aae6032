"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import shared_dir

# At most this many rows of a small side are broadcast; above it the join shuffles.
BROADCAST_ROWS = 50_000
# Rows of an Arrow batch handled at once, so that long texts do not pile up.
SLICE_ROWS = 1000
# At most about this many bytes of text; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session: they need not have it installed."""
    context = spark.sparkContext
    if any(os.path.basename(path) == "tidelog.zip" for path in context.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="tidelog-"), "tidelog.zip")
    with zipfile.ZipFile(path, "w") as file:
        for folder, _, names in os.walk(os.path.join(root, "tidelog")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    file.write(full, os.path.relpath(full, root))
    context.addPyFile(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


# Shuffle files of a query go when it has ended, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """``df`` computed once and written to the shared folder: later steps read the
    columns they need, and a lost executor costs only its running tasks. What stood
    at ``path`` is replaced. The shuffle files made on the way are removed."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has few rows, else as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``SLICE_ROWS`` rows and, but for single rows, ``SLICE_BYTES`` of text."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start] - sizes[start]
            end = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            end = min(end, start + SLICE_ROWS, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def release() -> None:
    """Gives the memory a task is done with back to the system; its worker is used again by others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_batch(df: DataFrame, schema: str | T.StructType, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``work`` on every slice of rows; it gives the output columns by name. Input columns
    of any type may be handed on if ``schema`` is a struct."""
    ship(df.sparkSession)
    if isinstance(schema, str):
        parts = [part.split() for part in schema.split(", ")]
    else:
        parts = [[field.name, field.dataType.simpleString().replace("bigint", "long")] for field in schema]
    names = [part[0] for part in parts]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [_arrow_type(part[1], types) for part in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in slices(batches):
                found = work(batch)
                columns = [x if isinstance(x := found[name], pa.Array) and (kind is None or x.type == kind) else pa.array(x, kind) for name, kind in zip(names, kinds, strict=True)]
                del found
                yield pa.record_batch(columns, names=names)
        finally:
            batch = columns = None
            release()

    return df.mapInArrow(run, schema)


def _arrow_type(kind: str, types: dict[str, pa.DataType]) -> pa.DataType | None:
    """The Arrow type of a column made here; None for types that are only handed on."""
    if kind.startswith("array<"):
        return pa.list_(types[kind[6:-1]]) if kind[6:-1] in types else None
    return types.get(kind)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fold(column: str, by: int) -> Column:
    """Remainder that deals rows into folds: CRC-32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by
