"""Helpers shared by the training-data operators: tables, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.plans.shared import checkpoint, table, written

__all__ = ["bounded", "checkpoint", "crc_mod", "drop", "id_type", "lean", "release", "small_batches", "table", "trim", "written"]

#: Rows that a broadcast side may have: at 16 bytes a row, 16 MB.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of an Arrow batch.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves that it is small, else df as it is (Spark then shuffles).

    Give it a checkpointed frame of narrow rows, as it is counted.
    """
    return F.broadcast(df) if df.count() <= rows else df


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes of an Arrow batch, as whole texts may be long.

    The bounds are the same for every operator, so that a frame that runs later finds those that it was made with. A row
    that exceeds the bytes makes a batch of its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_type(docs: DataFrame, id_col: str) -> str:
    """The type of the id column; operators hand ids on as they are."""
    return docs.select(id_col).schema[0].dataType.simpleString()


def crc_mod(doc_id: str | Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo by; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % by


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing needs any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file[: file.index("/tables/") + 40])
            root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give free memory of this process back to the system; a C library that can't do this keeps it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def lean(run: Callable) -> Callable:
    """A function for mapInArrow after whose tasks the worker, which waits for the next one, holds no free memory."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed
