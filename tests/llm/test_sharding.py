"""Jump consistent hashing against a direct implementation."""

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from factloom.llm.sharding import jump_shard, shard_documents


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_known_and_brute(spark):
    keys = [0, 1, 2, 10863919174838991, 2016238256797177309, -1, -(2**63), 2**63 - 1, *range(50, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 7, 8, 9, 100):
        got = df.select("k", jump_shard(F.col("k"), n).alias("s")).collect()
        assert [r.s for r in got] == [jump(r.k, n) for r in got]


def check(rows, got, n=8):
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert r.shard == jump(r.doc_id or 0, n) and r.grown_shard in (r.shard, n) and r.grown_shard == jump(r.doc_id or 0, n + 1)
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_sample_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    check(rows, got)
    text = dict(rows)
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    by = sorted(got, key=lambda r: (r.shard, r.slot))
    assert by == sorted(got, key=lambda r: (r.shard, r.doc_id))


def test_nulls_repeats_empty(spark):
    rows = [(None, None), (None, "é"), (5, ""), (5, ""), (6, None), *[(7, "same")] * 500]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()
    check(rows, got)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 6} == {(1, 0)}
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_native(spark, sf_dir):
    plan = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_long_texts_and_clashing_names(spark):
    rows = [(i, "é" * (400_000 if i == 3 else i), i * 10, "mine", "t") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, __part string, slot string")
    got = shard_documents(df).collect()
    check([r[:2] for r in rows], got)
    assert {r.size for r in got if r.doc_id == 3} == {800_001}
