"""A step over a stream of prompts that can be stopped anywhere and started again.

Each micro-batch writes its completions to a folder of its own number. A batch that was broken off is run again by Spark with the same prompts and number, and replaces
what it had left; a key that an earlier batch has completed, or that comes twice, isn't asked again. So each key has one completion, whatever restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.relational import keep_first


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches, with their number; an empty frame before the first one."""
    folder, whole = spark._jvm.org.apache.hadoop.fs.Path(path), f"{schema}, batch bigint"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def completions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What has been completed so far."""
    return _written(spark, path, schema).drop("batch")


def resume(prompts: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, schema: str, key: str = "uid") -> StreamingQuery:
    """Run `step` over all prompts that are there and not done, and write what it gives (of `schema`, which has the key).

    prompts: a streaming frame. Prompts without a key are left out, as nothing could tell that they are done. A new checkpoint counts its batches from the
    first number that `path` doesn't have yet.
    """
    spark = prompts.sparkSession
    first = f"{checkpoint}/first-batch"

    def begin() -> int:
        at = spark._jvm.org.apache.hadoop.fs.Path(first)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(at):
            number = (_written(spark, path, schema).agg(F.max("batch")).first()[0] + 1) if not _written(spark, path, schema).isEmpty() else 0
            spark.createDataFrame([(str(number),)], "value string").coalesce(1).write.mode("overwrite").text(first)
        return int(spark.read.text(first).first()[0])

    base = begin()

    def batch(rows: DataFrame, number: int) -> None:
        # The batch's own folder, of a run that was broken off, doesn't count as done.
        done = _written(rows.sparkSession, path, schema).where(F.col("batch") < base + number).select(key).distinct()
        once = keep_first(rows.where(F.col(key).isNotNull()), [key], [F.col(c) for c in rows.columns])
        step(once.join(done, key, "left_anti").select(*rows.columns)).write.mode("overwrite").parquet(f"{path}/batch={base + number}")

    return prompts.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
