"""Jump consistent hashing: a stable key and the shard count decide a row's shard, without a ring table.

A null id hashes as 0, so that such rows have one shard; a null text has no bytes. Repeated rows get the same
shard and different slots. Very long texts only count by their bytes and checksum; an empty table gives no rows; other columns are ignored, whatever
their names. Any number of shards from 1 up works; growing from n to n+1 moves rows only into
shard n.

Slots number the rows of each shard from 0 without gaps, in order of id, checksum and size. No task ever
holds a shard: narrow rows are range-partitioned by (shard, id, ...), numbered inside their partition, and
lifted by the counts of the partitions before, of which there are at most partitions + shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, partitions, text_or_empty

# Fixed values of the published algorithm (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757
MODULUS = 1 << 64
SHIFT = 1 << 33
SPAN = float(1 << 31)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a bigint key. 64-bit wrap-around is done in decimal(38), which holds every product exactly."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    k0 = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    k0 = F.when(k0 < 0, k0 + F.lit(str(MODULUS)).cast("decimal(20,0)")).otherwise(k0).cast("decimal(20,0)")
    many, modulus, shift = (F.lit(str(x)).cast("decimal(20,0)") for x in (MULTIPLIER, MODULUS, SHIFT))
    start = F.struct(k0.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(state, _):
        k = ((state["k"] * many + F.lit(1)) % modulus).cast("decimal(20,0)")
        high = F.floor(k / shift).cast("double")
        jumped = F.struct(
            k.alias("k"),
            state["j"].alias("b"),
            F.floor((state["j"] + 1).cast("double") * (F.lit(SPAN) / (high + 1))).cast("bigint").alias("j"),
        )
        return F.when(state["j"] < shards, jumped).otherwise(state)

    # Each jump goes at least one shard further, so `shards` steps are always enough; past the end they change nothing.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def numbered(df: DataFrame, group: str, order: list[str], slot: str) -> DataFrame:
    """Gapless numbers from 0 within `group`, in `order`. `df` should be narrow: it is materialised once."""
    spark = df.sparkSession
    keys = [group, *order]
    # The last key only splits long runs of equal rows over partitions.
    ranged = (
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *keys, "__tie")
        .sortWithinPartitions(*keys, "__tie")
        .drop("__tie")
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.spark_partition_id())
    )
    rows = cut(ranged)
    runs = rows.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(
        "__part", F.col(group).alias("__group"), "__first", "__before"
    )
    joined = rows.join(F.broadcast(runs), (rows["__part"] == runs["__part"]) & rows[group].eqNullSafe(runs["__group"]))
    return joined.select(
        *[rows[c] for c in df.columns], (F.col("__before") + F.col("__at") - F.col("__first")).cast("bigint").alias(slot)
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    utf8 = text_or_empty().cast("binary")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()).cast("bigint") + 1).alias("size"),
        F.crc32(utf8).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    out = numbered(narrow, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def oracle(shards: int = 8) -> str:
    """DuckDB SQL for shard_documents: the CRC's table and the jumps are made by list functions over wide integers."""

    def jump(n: int) -> str:
        step = f"""lambda s, _: CASE WHEN s.j < {n} THEN {{
                'k': ((s.k * {MULTIPLIER}::HUGEINT + 1) % {MODULUS}::HUGEINT)::HUGEINT, 'b': s.j,
                'j': floor((s.j + 1)::DOUBLE * ({SPAN}::DOUBLE / ((((s.k * {MULTIPLIER}::HUGEINT + 1) % {MODULUS}::HUGEINT) // {SHIFT}) + 1)::DOUBLE))::BIGINT}} ELSE s END"""
        return f"""list_reduce([{{'k': key, 'b': -1::BIGINT, 'j': 0::BIGINT}}] || [{{'k': 0::HUGEINT, 'b': 0::BIGINT, 'j': 0::BIGINT}} for _ in range({n})], {step}).b::INTEGER"""

    return f"""
        WITH crc AS (
            SELECT list(list_reduce([i::BIGINT] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tbl
            FROM range(256) t(i)
        ), d AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes,
                   CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + {MODULUS}::HUGEINT ELSE coalesce(doc_id, 0)::HUGEINT END AS key
            FROM documents
        ), e AS (
            SELECT doc_id, size::BIGINT AS size, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32,
                   'key' AS law, {jump(shards)} AS shard, {jump(shards + 1)} AS grown_shard
            FROM d, crc
        )
        SELECT doc_id, size, text_crc32, law, shard,
               (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard FROM e"""
