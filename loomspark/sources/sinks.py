"""Writers: tables that are swapped in whole, append-only histories, and payloads as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of a replaced table's present version; null if there is none."""
    names = [r.value for r in spark.read.text(f"{path}/{POINTER}").collect()] if _fs(spark, f"{path}/{POINTER}")[0].exists(_fs(spark, f"{path}/{POINTER}")[1]) else []
    return f"{path}/{names[0]}" if names else None


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table written by replace_table; null if there is none yet."""
    at = current(spark, path)
    return spark.read.parquet(at) if at else None


def replace_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """Write a version of its own beside the others, then swing the pointer, one small file replaced in one step.

    Readers see the old rows or the new ones, whenever the writer stops; the last ``keep`` versions stay for those that
    are still being read.
    """
    spark = df.sparkSession
    fs, root = _fs(spark, path)
    held = sorted((f.getModificationTime(), f.getPath().getName()) for f in (fs.listStatus(root) if fs.exists(root) else []) if f.getPath().getName().startswith("v-"))
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    jvm = spark.sparkContext._jvm
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}.{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), options)
    for _, old in held[: max(0, len(held) + 1 - keep)]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)


def write_text(rows: DataFrame, path: str, column: str = "line", order: str = "line_no") -> None:
    """A report's lines in order, as one text file; reports are as long as a person reads."""
    rows.orderBy(order).select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_history(entries: DataFrame, path: str) -> None:
    """Add events to a history that is only ever appended to; readStream can follow it."""
    entries.write.mode("append").parquet(path)


def payload(df: DataFrame, name: str = "payload") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
