"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from factloom.llm import simhash


def brute_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_roots(fps):
    """Component number by fingerprint, from all pairs in blocks."""
    fps = np.unique(np.array(fps, np.uint64))
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            parent[find(int(j))] = find(i)
    return {int(f): find(i) for i, f in enumerate(fps)}


def brute(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    root = brute_roots([f for _, f in prints])
    least = {}
    for d, f in prints:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    return sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in prints), key=str)


def run(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(80000))
    run(spark, [
        (3, None), (1, ""), (2, " \t\n"), (4, "One"), (5, "one two THREE"), (6, "one two three"), (7, "É é"), (7, "É é"), (None, "one"), (None, None),
        (8, "a b c d"), (9, "A\x0bb\x0cc d"), (10, long), (11, long + " end"), (12, "a b c d e"),
    ])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sample_tables(spark, sf_dir):
    run(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])


def shifted(rng, n, centres, flips):
    base = rng.integers(0, 2**64, centres, np.uint64)
    out = base[rng.integers(0, centres, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.concatenate([out, rng.integers(0, 2**64, n, np.uint64)])


def roots_of(spark, fps, most=1 << 15, rows=None):
    df = spark.createDataFrame([(int(x),) for x in np.unique(fps).view(np.int64)], "fp long").repartition(3)
    edges = simhash.links(df, rows or df.count(), most)
    unsigned = lambda x: int(np.int64(x).view(np.uint64))
    got = {unsigned(r.node): unsigned(r.root) for r in simhash.components(edges).collect()}
    return {f: got.get(f, f) for f in map(int, np.unique(fps))}


def same_partition(a, b):
    pairs = {(a[f], b[f]) for f in a}
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_links_are_exact(spark):
    rng = np.random.default_rng(1)
    for flips, centres in ((2, 30), (4, 200), (7, 4)):
        fps = shifted(rng, 1500, centres, flips)
        want = brute_roots(fps)
        assert same_partition(roots_of(spark, fps), want)


def test_large_buckets_and_more_blocks_lose_nothing(spark):
    rng = np.random.default_rng(2)
    fps = shifted(rng, 1200, 2, 5)
    want = brute_roots(fps)
    assert same_partition(roots_of(spark, fps, most=100), want)
    assert same_partition(roots_of(spark, fps, rows=1 << 32), want)
    assert len(simhash.key_blocks(10)) == 5 and len(simhash.key_blocks(1 << 32)) > 5


def test_gray_rank_sorts_gray_codes():
    i = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(i ^ (i >> np.uint64(1))) == i).all()


def test_long_chain_components(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_pipeline_stage_keeps_one_of_each(spark):
    rows = [(5, "alpha beta gamma delta", "s"), (3, "Alpha beta gamma delta", "s"), (3, "Alpha beta gamma delta", "s"), (9, "quite another text here now", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [3, 9, None]


def test_helper_names_of_the_caller_and_long_texts(spark):
    long = "one two three four five six seven eight nine ten " * 30_000
    rows = [(1, "a b c d e f", "U1", "M1"), (2, "a b c d e f", "U2", "M2"), (3, long, "U3", "M3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, __mark string")
    assert sorted(map(tuple, simhash.drop_near_copies(df).collect())) == [rows[0], rows[2]]
