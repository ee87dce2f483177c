"""Exact dedup by skew-safe combining.

Texts are equal when identical after deleting white space (`[\\x20\\x09-\\x0D]`); null counts as empty. Three
stages, each of which groups by the digest *and the whole normalised text*:

1. locally: the partial aggregation of each input task leaves one row per text and task;
2. salted: those rows meet by (digest, salt, text), where the salt is the task's number modulo `salts`, so
   that a text that makes up a third of all rows is merged by `salts` tasks, from one row per input task;
3. globally: one winner per salt meets by (digest, text).

The winner is the row with the most code points in its original text, then the smallest doc_id (a null doc_id
is last). Decisions go back to narrow rows by the digest. That is sound because stage 3 counts the different
texts per digest and the query fails, rather than merge them, if two texts share one; a collision of SHA-256
isn't known. Groups of over a thousandth of all rows, of which there are under a thousand, go back by a broadcast, so that no
task has to hold the rows of one; all others by a shuffle. Both sides are narrow tables, checkpointed.

Defined results: of repeated rows (same doc_id, same text), exactly one is kept; they are told apart by numbers that the checkpointed
rows carry, whose minimum is taken with map-side combining. Very long texts are compared whole. An empty table gives no rows. Other columns
are ignored by `exact_dedup` and returned as they are by `drop_copies`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import unused
from factloom.llm.common import cut, join_hot, text_or_empty, without_space

SALTS = 16
_HALF, _SPAN = 1 << 63, 1 << 65
_dec = lambda x: F.lit(str(x)).cast("decimal(20,0)")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """Larger is better: most code points, then the smallest id, then none. A decimal, so that hash aggregation can hold it."""
    id_ = F.coalesce(_dec(_HALF) - doc_id.cast("decimal(20,0)"), _dec(0))
    return (n_chars.cast("decimal(11,0)") * _dec(_SPAN) + id_).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    part = rank % _dec(_SPAN)
    return F.when(part > 0, _dec(_HALF) - part).cast("bigint")


def decide(docs: DataFrame, digest=None, salts: int = SALTS) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256 and n_code_points.

    digest: Column -> Column, for tests of what happens when digests collide.
    """
    digest = digest or (lambda norm: F.sha2(norm.cast("binary"), 256))
    norm = without_space(text_or_empty())
    base = docs.select(F.col("doc_id"), F.length(text_or_empty()).alias("n_chars"), norm.alias("norm"))
    base = base.withColumn("digest", digest(F.col("norm")))
    merge = [F.max("best").alias("best"), F.sum("n").alias("n")]
    salted = (
        base.select(
            "digest", "norm", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
            _rank(F.col("n_chars"), F.col("doc_id")).alias("best"), F.lit(1).cast("bigint").alias("n"),
        )
        .groupBy("digest", "salt", "norm")
        .agg(*merge)
    )
    whole = salted.groupBy("digest", "norm").agg(*merge)
    by_digest = whole.groupBy(F.col("digest").alias("__digest")).agg(
        F.max("best").alias("__best"), F.sum("n").alias("group_size"), F.count("*").alias("__texts")
    )
    by_digest = cut(
        by_digest.select(
            "__digest", "__best",
            F.when(F.col("__texts") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("two different texts share a digest")).cast("bigint"))
            .alias("group_size"),
        )
    )
    rows = cut(base.select("doc_id", "n_chars", "digest").withColumn("__row", F.monotonically_increasing_id()))
    rank = _rank(F.col("n_chars"), F.col("doc_id"))
    # Repeated rows share the best rank: the first of them is kept. Numbers are part of the checkpoint, so they don't change.
    first = rows.groupBy(F.col("digest").alias("__digest")).agg(F.max_by(F.col("__row"), F.struct(rank, -F.col("__row"))).alias("__first"))
    decided = cut(by_digest.join(first, "__digest").withColumnRenamed("__digest", "digest").withColumn("__n", F.col("group_size")))
    out = join_hot(rows, decided, "digest", "__n")
    return out.select(
        "doc_id",
        _id_of(F.col("__best")).alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("__row") == F.col("__first")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.col("n_chars").cast("bigint").alias("n_code_points"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The thin result: doc_id, keep_id, group_size, kept, text_sha256."""
    return decide(docs).drop("n_code_points")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their columns. Of repeated rows one stays."""
    id_name, sha, size = keys = unused(docs.columns, "id", "sha", "len")
    # A stand-in for a null id is enough here: rows that share it also share a text, and one of them stays.
    id_ = F.coalesce(F.col("doc_id"), F.lit(-_HALF))
    winners = decide(docs).where("kept").select(id_.alias(id_name), F.col("text_sha256").alias(sha), F.col("n_code_points").alias(size))
    rows = docs.withColumns({
        id_name: id_, sha: F.sha2(without_space(text_or_empty()).cast("binary"), 256), size: F.length(text_or_empty()).cast("bigint"),
    })
    # Repeated rows meet in every task before they are shuffled.
    order = F.struct(F.col("text").isNull().alias("none"), "text")
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return one.join(winners, keys, "left_semi").select("row.*")
