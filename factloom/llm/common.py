"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space in every contract of this subpackage, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Only a local session may go without one; it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set, and executors share no other folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow table in the reliable, shared checkpoint folder and drop its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is hot if more than this share of all rows have it; so there are fewer hot keys than its inverse.
HOT_SHARE = 0.001


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of `rows` with a materialised table of one row a key, where `n` counts the rows of `rows` with that key.

    Hot keys, of which there are under 1 / HOT_SHARE, go to the rows by a broadcast, so that no task has to hold one's rows;
    all others by a shuffle. `rows` is read twice if there are any. `n` isn't in the result.
    """
    most = (table.agg(F.sum(n)).first()[0] or 0) * HOT_SHARE
    hot = table.where(F.col(n) > F.lit(most))
    if hot.isEmpty():
        return rows.join(table.drop(n), key)
    cold = table.where(F.col(n) <= F.lit(most)).drop(n)
    by_broadcast = rows.join(F.broadcast(hot.drop(n)), key)
    return by_broadcast.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def without_space(text: Column) -> Column:
    """Delete every character of SPACE; plain byte searches are much cheaper here than a regular expression."""
    for c in "\x20\x09\x0a\x0b\x0c\x0d":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def bound(value: Column, use) -> Column:
    """use(value) with the value held by a lambda's variable: an expression inside another lambda is computed at every turn of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_totals(lengths: Column, block: int = 256) -> Column:
    """array<bigint> -> the sums of all elements before each element, in time linear in the array.

    Sums run inside blocks of a fixed size and then over the blocks' totals, since appending to one long
    array copies it each time.
    """
    nothing = F.array().cast("array<bigint>")

    def within(lengths: Column) -> Column:
        last = F.floor((F.size(lengths) - 1) / F.lit(block)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda b: F.aggregate(
                F.slice(lengths, b * block + 1, block),
                F.array(F.lit(0).cast("bigint")),
                lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
            ),
        )

    def before(blocks: Column) -> Column:
        return F.aggregate(
            blocks,
            F.array(F.lit(0).cast("bigint")),
            lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(b, -1))),
        )

    def placed(blocks: Column) -> Column:
        lifted = F.zip_with(blocks, before(blocks), lambda b, o: F.when(b.isNotNull(), F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: x + o)))
        return F.flatten(F.filter(lifted, lambda b: b.isNotNull()))

    return bound(lengths, lambda own: F.when(F.size(own) > 0, bound(within(own), placed)).otherwise(nothing))
