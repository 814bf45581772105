"""Session helpers of the operators and queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary one of this machine if the master is local (tests); on a cluster it raises, as other
    machines would not see the files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomspark-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back, which cuts its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "rows", by: str | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back; by: a column to partition by.

    Unlike a checkpoint it keeps no partitioning: a join of it gets its own exchange, which adaptive execution can split.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}/{name}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list, name: str = "i") -> DataFrame:
    """rows with their place (from 0) in an order, by a range exchange: places in a partition, then one offset for each."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = checkpoint(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row a partition; the running sum over them is as small as their number.
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, place).drop("_m", "_part", "_before")
