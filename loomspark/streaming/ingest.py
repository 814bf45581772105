"""Streams: windows over events, acquisition state kept by key, and a history followed as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.operators.evaluate import latest
from loomspark.sources.sinks import read_table, replace_table

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def windowed(rows: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in tumbling windows; events later than ``late`` are left out of a stream."""
    grouped = rows.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("since"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events no further apart than gap."""
    grouped = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "n")


def once(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeats that arrive within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def keep_state(rows: DataFrame, path: str, checkpoint: str, key: str, at: str, tie: str) -> StreamingQuery:
    """Follow a stream and keep the last row of each key in a table, which each batch replaces whole.

    A batch that is run again after a failure gives the same table.
    """

    def put(batch: DataFrame, _: int) -> None:
        known = read_table(batch.sparkSession, path)
        replace_table(latest(batch if known is None else known.unionByName(batch), key, at, tie), path)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
