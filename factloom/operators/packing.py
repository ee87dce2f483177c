"""Prompts packed into batches by size.

Prompts are taken shortest first, and a batch is closed when the next prompt would bring it over the limit. Read row by row, each decision depends on all before
it. But sorted prompts come in classes of equal size, and inside a class packing is plain division: the open batch takes as many prompts as fit, all further
batches hold the same number, and the last one stays open. So the state only has to be carried from class to class. There are at most limit + 2 classes (larger
prompts are one class, each with a batch of its own), whatever the number of rows: their counts are summed up by Spark, the carry runs over that short list, and each row's batch
follows from its class and its place in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import unused
from factloom.operators.numbering import number_rows

#: The carry's list, and the broadcast of its result, have at most this many rows.
MOST_CLASSES = 4_000_000


@dataclass
class SizeClass:
    """Prompts of one size: `size` tokens, `n` of them. Filled in by carry()."""

    size: int
    n: int
    before: int = 0  # prompts of smaller sizes
    batch: int = 0  # the batch that was open
    joined: int = 0  # prompts that still fit into it
    each: int = 1  # prompts in each of the class's own batches
    last: int = 0  # the batch that is open after the class


def carry(classes: list[SizeClass], most: int) -> dict[int, int]:
    """Fill in classes, which are in order of size; returns the longest prompt of each batch that several classes can share."""
    held = batch = before = 0
    longest: dict[int, int] = {}
    for c in classes:
        c.before, c.batch = before, batch
        c.each = max(1, most // c.size) if c.size else c.n
        # A batch without tokens takes even a prompt that is over the limit.
        room = c.each if not held else max(0, most - held) // c.size
        c.joined = min(c.n, room)
        left = c.n - c.joined
        if c.joined:
            longest[batch] = c.size
        if left:
            own = (left + c.each - 1) // c.each
            batch += own
            held = (left - (own - 1) * c.each) * c.size
            longest[batch] = c.size
        else:
            held += c.joined * c.size
        c.last = batch
        before += c.n
    return longest


def dynamic_batches(df: DataFrame, tokens: str, keys: list[str], most: int, cap: int = 4096) -> DataFrame:
    """`df` with batch (from 0, in order of size) and max_new_tokens (1.3 times the batch's longest prompt, at most `cap`).

    Tokens in a batch don't exceed `most`, but for a single prompt that is longer. Equal sizes are in order of `keys`, so batches are reproducible when keys
    are unique. A null or negative number of tokens counts as 0. An empty table gives no rows.
    """
    if not 0 < most <= MOST_CLASSES:
        raise ValueError(f"the limit must be from 1 to {MOST_CLASSES}")
    size, kind, at = unused(df.columns, "size", "kind", "at")
    sized = df.withColumn(size, F.greatest(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)), F.lit(0)))
    rows = number_rows(sized, [size, *keys], at, 0).withColumn(kind, F.least(F.col(size), F.lit(most + 1)))
    told = rows.groupBy(kind).agg(F.count("*").alias("n"), F.min(size).alias("least")).orderBy(kind).collect()
    classes = [SizeClass(r["least"], r["n"]) for r in told]
    longest = carry(classes, most)
    plan = [(r[kind], c.before, c.batch, c.joined, c.each, longest.get(c.batch, 0), c.last, longest.get(c.last, 0)) for r, c in zip(told, classes)]
    names = unused([*rows.columns], "before", "batch", "joined", "each", "first_longest", "last", "last_longest")
    table = df.sparkSession.createDataFrame(plan, ", ".join(f"{c} bigint" for c in (kind, *names)))
    before, batch, joined, each, first_longest, last, last_longest = map(F.col, names)
    place = F.col(at) - before
    number = F.when(place < joined, batch).otherwise(batch + 1 + F.call_function("div", place - joined, each)).cast("bigint")
    own = F.when(F.col(size) > most, F.col(size)).when(number == batch, first_longest).when(number == last, last_longest).otherwise(F.col(size))
    out = rows.join(F.broadcast(table), kind)
    return out.select(*df.columns, number.alias("batch"), F.least(F.lit(cap), F.floor(own * F.lit(1.3))).cast("int").alias("max_new_tokens"))
