"""Row numbers over a whole table without a single task that holds it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.names import unused


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Only a local session may go without one; it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set, and executors share no other folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, order: list, name: str = "rn", start: int = 1) -> DataFrame:
    """Consecutive numbers in the given order: range partitions, each lifted by the counts of those before it.

    Rows that tie on the whole order are split over partitions by a number of their own, so that they don't fill one task; among them the numbers
    are in any order. Nulls come first.
    """
    at, part, tie, n, first, lift = unused([*df.columns, name], "at", "part", "tie", "n", "first", "lift")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    rows = tied.repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    rows = materialise(rows.withColumns({at: F.monotonically_increasing_id(), part: F.spark_partition_id()}))
    sizes = rows.groupBy(part).agg(F.count("*").alias(n), F.min(at).alias(first))
    before = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifts = sizes.select(part, (before - F.col(first) + start).alias(lift))  # one row per partition
    return rows.join(F.broadcast(lifts), part).select(*df.columns, (F.col(at) + F.col(lift)).cast("bigint").alias(name))
