"""Dedup, joins, filters, set operations and reshaping, with the semantics that the pipeline needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.names import unused
from factloom.operators.bloom import bloom_filter, filter_bits, may_be_in

#: A side may be broadcast below this many rows of narrow keys; above it, the join shuffles.
MOST_BROADCAST_ROWS = 1_000_000
MOST_BROADCAST_BYTES = 64 << 20
MOST_TEMPLATES = 1_000
MOST_TEMPLATE_BYTES = 32 << 20


def keep_first(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key. An aggregation, so that copies meet map-side and a hot key doesn't fill a task."""
    named = {f"__k{i}": (F.col(k) if isinstance(k, str) else k) for i, k in enumerate(keys)}
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.select(row.alias("row"), F.struct(*order).alias("ord"), *[c.alias(n) for n, c in named.items()])
    return first.groupBy(*named).agg(F.min_by("row", "ord").alias("row")).select("row.*")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    named = df.select(F.struct(*df.columns).alias("row"), F.struct(*order).alias("ord"), *keys)
    return named.groupBy(*keys).agg(F.max_by("row", "ord").alias("row")).select("row.*")


def _small(df: DataFrame) -> bool:
    """Whether a narrow side may be broadcast: by rows and by bytes, of which no more than the bound are looked at."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    n, size = df.limit(MOST_BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(width.cast("bigint"))).first()
    return n <= MOST_BROADCAST_ROWS and (size or 0) <= MOST_BROADCAST_BYTES


def semi_join_by_hash(df: DataFrame, text: str, hashes: DataFrame, hash_column: str) -> DataFrame:
    """Rows whose text's MD5 is in a key set.

    A set within the bounds is broadcast. Beyond them, a Bloom filter of the set is asked in the scan, and only rows that pass it are shuffled to the exact join.
    """
    own, other = unused(df.columns, "h", "key")
    keys = hashes.select(F.col(hash_column).cast("string").alias(other)).where(F.col(other).isNotNull()).distinct()
    digest = F.md5(F.col(text).cast("binary"))
    if _small(keys):
        return df.join(F.broadcast(keys), digest == F.col(other), "left_semi")
    bits = filter_bits(keys.count())
    passed = df.withColumn(own, digest)
    passed = passed.where(may_be_in(F.col(own), bloom_filter(keys, other, bits), bits))
    return passed.join(keys, F.col(own) == F.col(other), "left_semi").drop(own)


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: rows whose key isn't among the completed."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Left join with the first note of each key (by all its columns, so that the choice is stable)."""
    return df.join(keep_first(notes, [key], [F.col(c) for c in notes.columns]), key, "left")


def natural_left_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Left join on all shared columns, where null matches null."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("no shared column")
    right = b.select(*[F.col(c).alias(f"__{c}" if c in shared else c) for c in b.columns])
    on = reduce(lambda x, y: x & y, [a[c].eqNullSafe(right[f"__{c}"]) for c in shared])
    return a.join(right, on, "left").drop(*[f"__{c}" for c in shared])


def natural_join_renamed(a: DataFrame, b: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left join on renamed columns, null-safe, dropping the right keys."""
    right = b.select(*[F.col(c).alias(f"__{c}" if c in on.values() else c) for c in b.columns])
    test = reduce(lambda x, y: x & y, [a[k].eqNullSafe(right[f"__{v}"]) for k, v in on.items()])
    return a.join(right, test, "left").drop(*[f"__{v}" for v in on.values()])


def cross_templates(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Every document with every template: the templates are a handful of files, and the documents aren't shuffled.

    More than MOST_TEMPLATES templates, or templates of more than MOST_TEMPLATE_BYTES, raise ValueError before any is sent.
    """
    few = templates.limit(MOST_TEMPLATES + 1)
    size = F.sum(F.length(F.to_json(F.struct(*templates.columns))))
    n, length = few.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    if n > MOST_TEMPLATES or length > MOST_TEMPLATE_BYTES:
        raise ValueError("too many templates to broadcast")
    return docs.crossJoin(F.broadcast(templates))


def missing_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of ids that only one side has."""
    left, right = (d.select(key).where(F.col(key).isNotNull()).distinct().withColumn(n, F.lit(True)) for d, n in ((a, "in_a"), (b, "in_b")))
    both = left.join(right, key, "full_outer").where("in_a IS NULL OR in_b IS NULL")
    return both.select(key, F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("side"))


def exclude(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """Drop rows in which any column has one of its listed values; nulls stay."""
    hit = reduce(lambda x, y: x | y, [F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in values.items()])
    return df.where(~hit)


def any_of(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """Keep rows in which any column has one of its listed values; an empty filter keeps all."""
    if not values:
        return df
    return df.where(reduce(lambda x, y: x | y, [F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in values.items()]))


def in_groups_larger_than(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows whose key occurs more than n times. Counts meet map-side; the rows then join them."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > n).drop("__n")
    return df.join(sizes, keys, "left_semi")


def paired_files(files: DataFrame, key: str, path: str) -> DataFrame:
    """Keys with exactly two files."""
    return files.groupBy(key).agg(F.countDistinct(path).alias("n_files")).where("n_files = 2").select(key)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b doesn't have."""
    return a.subtract(b)


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def long_form(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "variable", "value")


def wide_form(df: DataFrame, keys: list[str], name: str, names: list[str], values: list[str]) -> DataFrame:
    """Columns value_name; the list of names is always given, so no job has to find it."""
    found = df.groupBy(*keys).pivot(name, names).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])
    single = len(values) == 1
    return found.withColumnsRenamed({(n if single else f"{n}_{v}"): f"{v}_{n}" for n in names for v in values})


def text_fallback(df: DataFrame, into: str = "note_text", other: str = "TEXT") -> DataFrame:
    return df.withColumn(into, F.col(other)).drop(other) if other in df.columns else df


def null_census(df: DataFrame) -> DataFrame:
    """(column_name, n_null) of every column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_null")


def order_in_partitions(df: DataFrame, column: str, partitions: int) -> DataFrame:
    """Range partitions in order, sorted inside: what batching by length needs, without a final sort."""
    return df.repartitionByRange(partitions, column).sortWithinPartitions(column)


def majority(df: DataFrame, unit: str, label: str, order: str) -> DataFrame:
    """The most frequent label of each unit; of equals, the one that was seen first."""
    counts = df.groupBy(unit, label).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = counts.groupBy(unit).agg(F.min_by(label, F.struct(-F.col("n"), F.col("seen"), F.col(label))).alias(label))
    return best


def window_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))
