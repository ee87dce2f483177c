"""Streams that are stopped and started again, and semi joins by a Bloom filter."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import bloom
from factloom.operators import relational as rel
from factloom.streaming.resume import completions, resume

SCHEMA = "uid bigint, answer string, asked string"


def started(spark, tmp_path, step, checkpoint="cp"):
    prompts = spark.readStream.schema("uid bigint, prompt string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return resume(prompts, step, str(tmp_path / "out"), str(tmp_path / checkpoint), SCHEMA)


def test_stop_and_restart(spark, tmp_path):
    """The step breaks in the middle of the second batch, after some of its rows have been written by tasks; nothing is lost or doubled."""
    out = str(tmp_path / "out")
    for k in range(3):  # batches share keys with the ones before, and repeat some
        rows = [(i, f"p{i}") for i in range(k * 40, k * 40 + 60)] + [(k * 40, f"p{k * 40}"), (None, "x")]
        spark.createDataFrame(rows, "uid bigint, prompt string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    answer = F.concat(F.lit("a"), "uid")

    def breaks(rows):
        fails = F.when(F.col("uid") == 97, F.raise_error(F.lit("service is gone"))).otherwise(answer)
        return rows.repartition(4).select("uid", fails.alias("answer"), F.lit("first").alias("asked"))

    with pytest.raises(Exception):
        started(spark, tmp_path, breaks).awaitTermination()
    before = {r.uid for r in completions(spark, out, SCHEMA).collect()}
    assert before and 97 not in before
    started(spark, tmp_path, lambda rows: rows.select("uid", answer.alias("answer"), F.lit("second").alias("asked"))).awaitTermination()
    got = completions(spark, out, SCHEMA).collect()
    assert sorted(r.uid for r in got) == list(range(140)) and all(r.answer == f"a{r.uid}" for r in got)
    assert {r.uid for r in got if r.asked == "first"} == before
    # New prompts later, by the same checkpoint and by a lost one: only they are asked.
    spark.createDataFrame([(5, "p5"), (500, "p500")], "uid bigint, prompt string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    third = lambda rows: rows.select("uid", answer.alias("answer"), F.lit("third").alias("asked"))
    for checkpoint in ("cp", "another"):
        started(spark, tmp_path, third, checkpoint).awaitTermination()
        got = completions(spark, out, SCHEMA).collect()
        assert sorted(r.uid for r in got) == [*range(140), 500] and [r.uid for r in got if r.asked == "third"] == [500]


def test_bloom_filter_rules_out_and_loses_nothing(spark):
    keys = spark.range(0, 20_000, 2).select(F.concat(F.lit("k"), "id").alias("k"))
    keys = keys.unionAll(spark.createDataFrame([(None,)], "k string"))
    bits = bloom.filter_bits(10_000)
    rows = spark.range(40_000).select("id", F.concat(F.lit("k"), "id").alias("h")).unionAll(spark.createDataFrame([(None, None)], "id long, h string"))
    passed = {r.id for r in rows.where(bloom.may_be_in(F.col("h"), bloom.bloom_filter(keys, "k", bits), bits)).collect()}
    assert set(range(0, 20_000, 2)) <= passed and len(passed) < 10_000 + 1_500 and None not in passed
    assert bloom.filter_bits(0) == bloom.BITMAP_BITS and bloom.filter_bits(10**9) == bloom.MOST_BITS


def test_semi_join_beyond_a_broadcast(spark, monkeypatch):
    docs = spark.range(5000).select(F.concat(F.lit("text "), F.col("id") % 3000).alias("t"), F.lit("x").alias("__h"), F.lit("y").alias("__key"))
    keys = docs.where(F.col("t").endswith("7")).select(F.md5(F.col("t").cast("binary")).alias("d"))
    want = sorted(map(tuple, rel.semi_join_by_hash(docs, "t", keys, "d").collect()))
    monkeypatch.setattr(rel, "MOST_BROADCAST_BYTES", 10)
    got = rel.semi_join_by_hash(docs, "t", keys, "d")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == want and len(want) == 500
    # Rows are tested below the exchange of the join.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan.lower() or "get_bit" in plan.lower()
    assert rel.semi_join_by_hash(docs, "t", keys.limit(0), "d").collect() == []
