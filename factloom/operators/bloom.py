"""A Bloom filter made and asked by Spark's own bitmap functions.

A set of keys too large to broadcast still rules out most rows of the other side before they are shuffled: the filter has a few bits a key, is made by one
aggregation that combines in tasks, and is bounded whatever the number of keys. It reaches the scan as a scalar subquery, so rows are tested where they
are read. A filter never rules out a key of the set; rows that pass by chance fall out in the exact join that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, by Spark's functions.
BITMAP_BITS = 8 * 4096
#: The filter's size ends here (16 MB); more keys than a tenth of that make it less sharp, not larger.
MOST_BITS = 1 << 27
HASHES = 4


def filter_bits(n_keys: int) -> int:
    """About ten bits a key, as a power of two."""
    return min(MOST_BITS, max(BITMAP_BITS, 1 << (10 * max(n_keys, 1) - 1).bit_length()))


def _places(key: Column, bits: int) -> list[Column]:
    # From 1, as the bitmaps' buckets are counted from 1 for these.
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) + 1 for i in range(HASHES)]


def bloom_filter(keys: DataFrame, key: str, bits: int) -> Column:
    """The filter of a column as a scalar subquery: array<binary>, a bitmap for each run of BITMAP_BITS places."""
    places = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    made = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    buckets = keys.sparkSession.range(1, bits // BITMAP_BITS + 1).select(F.col("id").alias("bucket"))
    whole = buckets.join(made, "bucket", "left").select("bucket", F.coalesce("bitmap", F.lit(bytearray(BITMAP_BITS // 8))).alias("bitmap"))
    listed = whole.agg(F.sort_array(F.collect_list(F.struct("bucket", "bitmap"))).alias("b"))
    return listed.select(F.transform("b", lambda x: x["bitmap"]).alias("b")).scalar()


def may_be_in(key: Column, bloom: Column, bits: int) -> Column:
    """False only if the key isn't in the filter's set; false for null."""
    test = key.isNotNull()
    for p in _places(key, bits):
        bit = F.bitmap_bit_position(p)
        byte = F.substring(F.get(bloom, F.bitmap_bucket_number(p).cast("int") - 1), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        held = F.conv(F.hex(byte), 16, 10).cast("int")
        test = test & (F.call_function("getbit", held, (bit % 8).cast("int")) == 1)
    return test
