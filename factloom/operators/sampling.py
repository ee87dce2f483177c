"""Reproducible samples by hash rank: the same rows at any partitioning, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.names import unused
from factloom.functions.text import token_estimate
from factloom.operators.numbering import number_rows


#: Ranks that are looked at one by one, once histograms have narrowed the cut down to as many rows.
MOST_RANKS = 10_000


def hash_rank(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def token_band(df: DataFrame, text: str, least: float, most: float, name: str = "est_token_count", count=token_estimate) -> DataFrame:
    """Rows with least < tokens < most, both strict, with their count."""
    return df.withColumn(name, count(F.col(text))).where((F.col(name) > least) & (F.col(name) < most))


def stratified_sample(df: DataFrame, strata: list[str], n: int, seed: int = 123456, key: str = "doc_id") -> DataFrame:
    """At most n rows of each stratum. Each task keeps its own best n before the shuffle (window group limit)."""
    (rn,) = unused(df.columns, "rn")
    order = Window.partitionBy(*strata).orderBy(hash_rank(seed, key), F.col(key))
    return df.withColumn(rn, F.row_number().over(order)).where(F.col(rn) <= n).drop(rn)


def rank_cut(ranks: DataFrame, n: int | None, fraction: float | None) -> tuple[str, int, int]:
    """The rank that cuts off the n smallest (n, or the floor of a fraction of all): it, the rows below it, and how many of those at it are still needed.

    `ranks` has one column, `rank`, of hexadecimal digits. A histogram of the first four digits, which tasks combine, finds the digits of the cut and the rows
    before it; the next four digits are looked at among rows with these only, and so on until few rows share them. So nothing is sorted, and the driver sees
    65,536 counts at most.
    """
    prefix, below, same, depth = "", 0, None, 4
    while True:
        held = ranks.where(F.col("rank").startswith(prefix)) if prefix else ranks
        if same is not None and (same <= MOST_RANKS or depth > 32):
            # Of equal ranks (equal keys) one row a rank is enough.
            for r in held.groupBy("rank").count().orderBy("rank").collect():
                if below + r["count"] >= n:
                    return r["rank"], below, n - below
                below += r["count"]
        counts = held.groupBy(F.substring("rank", 1, depth).alias("p")).count().collect()
        if n is None or fraction is not None:
            n, fraction = int(fraction * sum(c["count"] for c in counts)), None
        elif same is None and sum(c["count"] for c in counts) < n:
            raise ValueError("the sample is larger than the table")
        if n == 0:
            return "", 0, 0
        for c in sorted(counts):
            if below + c["count"] >= n:
                prefix, same = c["p"], c["count"]
                break
            below += c["count"]
        depth += 4


def global_sample(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """n rows, or the floor of a fraction of all rows: those with the smallest hash ranks. Errors as for any sample: too many, a bad fraction, neither.

    Rows of one key share a rank; where the cut falls among them, any of them are taken.
    """
    if n is None and fraction is None:
        raise ValueError("a sample needs n or a fraction")
    if fraction is not None and not 0 < fraction <= 1:
        raise ValueError("a fraction lies in (0, 1]")
    rank, rn = unused(df.columns, "rank", "rn")
    cut, below, more = rank_cut(df.select(hash_rank(seed, key).alias("rank")), n, fraction)
    ranked = df.withColumn(rank, hash_rank(seed, key))
    if ranked.where(F.col(rank) == cut).select(rank).count() == more:
        return ranked.where(F.col(rank) <= cut).drop(rank)
    at_cut = number_rows(ranked.where(F.col(rank) == cut), [key], rn).where(F.col(rn) <= more)
    return ranked.where(F.col(rank) < cut).unionByName(at_cut.drop(rn)).drop(rank)


def cap_rows(df: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first n rows in order; none or 0 keeps all."""
    return df.orderBy(order).limit(n) if n else df


def sample_with_replacement(df: DataFrame, group: list[str], n: int, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """n draws from each group: draw i takes the row at a hashed place of the group's hash order.

    Rows are numbered over the whole table, group by group, so that no task has to hold a group; only the draws are joined.
    """
    rank, place, first, size = unused([*df.columns, "draw"], "rank", "n", "first", "size")
    numbered = number_rows(df.withColumn(rank, hash_rank(seed, key)), [*group, rank, key], place, 0).drop(rank)
    sizes = numbered.groupBy(*group).agg(F.min(place).alias(first), F.count("*").alias(size))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), *[F.col(g).cast("string") for g in group]).cast("binary")), 1, 8)
    draws = draws.select("draw", (F.col(first) + F.conv(digits, 16, 10).cast("bigint") % F.col(size)).alias(place))
    return draws.join(numbered, place).drop(place)


def disjoint_strata(df: DataFrame, strata: list[tuple[str, Column]], key: str = "doc_id") -> DataFrame:
    """Strata in order; one that shares a row with an earlier claimed stratum is left out whole. Adds `stratum`."""
    kept: list[tuple[str, Column]] = []
    for name, test in strata:
        test = F.coalesce(test, F.lit(False))
        clash = F.lit(False)
        for _, other in kept:
            clash = clash | other
        if not kept or df.where(test & clash).isEmpty():
            kept.append((name, test))
    case = F.lit(None).cast("string")
    for name, test in reversed(kept):
        case = F.when(test, name).otherwise(case)
    return df.withColumn("stratum", case).where(F.col("stratum").isNotNull())
