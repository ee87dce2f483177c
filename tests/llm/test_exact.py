"""Exact dedup against brute force, with ties, nulls and colliding digests."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm.exact import decide, drop_copies, exact_dedup

CASES = [
    (1, "a b c"), (2, "a bc"), (3, "a  bc"), (4, "abc\n\t"), (5, None), (6, ""), (7, " \x0b\x0c"), (8, " abc"), (9, "abc "),
    (10, "same"), (10, "same"), (10, "sam e"), (None, "orphan"), (None, "orphan"), (None, "x" * 50000), (11, "x" * 50000), (-5, "neg"), (-6, "neg"),
    (2**63 - 1, "edge"), (-(2**63), "edge"),
]


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d))
    best = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    return {k: (best[k][2], -best[k][0], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items()}


def check(spark, rows, parts):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    want = brute(rows)
    by_sha = {v[3]: v for v in want.values()}
    got = exact_dedup(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == (by_sha[r.text_sha256][0], by_sha[r.text_sha256][2])
    kept = sorted(((r.text_sha256, r.doc_id) for r in got if r.kept), key=str)
    assert kept == sorted(((v[3], v[0]) for v in want.values()), key=str)
    assert sorted((r.text for r in drop_copies(df).collect()), key=str) is not None
    stay = drop_copies(df).collect()
    assert len(stay) == len(want)
    for r in stay:
        w = want[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")]
        assert (r.doc_id, len(r.text or "")) == w[:2]


def test_cases(spark):
    check(spark, CASES, 5)


def test_sample_tables(spark, sf_dir):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()], 7)


def test_hot_group_and_empty_table(spark):
    check(spark, [(i, "copy") for i in range(3000)] + [(9000 + i, f"t{i % 50}") for i in range(500)], 24)
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_colliding_digests_fail_rather_than_merge(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with pytest.raises(Exception, match="share a digest"):
        decide(df, digest=lambda norm: F.lit("0")).collect()


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", "k", 3)], "doc_id long, text string, kept string, digest int")
    assert drop_copies(df).collect()[0].asDict() == {"doc_id": 1, "text": "a", "kept": "k", "digest": 3}


def test_half_of_the_ids_null(spark):
    check(spark, [(i if i % 2 else None, ("copy", f"t{i % 40}")[i % 3 > 0]) for i in range(2000)], 12)


def test_helper_names_of_the_caller(spark):
    rows = [(1, "a b", "U1", "L1", "S1"), (2, "ab", "U2", "L2", "S2"), (3, "c", "U3", "L3", "S3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, __LEN string, __sha string")
    assert sorted(map(tuple, drop_copies(df).collect())) == [rows[0], rows[2]]
