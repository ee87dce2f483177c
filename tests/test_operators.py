"""Operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import annotate as an
from factloom.operators import inference as inf
from factloom.operators import relational as rel
from factloom.operators import sampling as sm
from factloom.operators.numbering import number_rows


def test_numbering(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5)
    got = sorted((r.k, r.id, r.rn) for r in number_rows(df, ["k", "id"]).collect())
    assert [g[2] for g in got] == list(range(1, 1001))


def test_dedup_and_filters(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "w")], "i int, k string, v string")
    assert {r.i for r in rel.keep_first(df, ["k"], [F.col("i")]).collect()} == {1, 3}
    assert {r.i for r in rel.keep_last(df, ["k"], [F.col("i")]).collect()} == {2, 4}
    assert {r.i for r in rel.exclude(df, {"k": ["a"]}).collect()} == {3, 4} and rel.any_of(df, {}).count() == 4
    assert rel.text_fallback(spark.createDataFrame([("t",)], "TEXT string")).columns == ["note_text"]


def test_joins(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, k string")
    b = spark.createDataFrame([(None, 5), ("y", 6)], "k string, v int")
    assert {(r.i, r.v) for r in rel.natural_left_join(a, b).collect()} == {(1, 5), (2, None)}
    with pytest.raises(ValueError):
        rel.natural_left_join(a.select("i"), b)
    notes = spark.createDataFrame([(1, "b"), (1, "a")], "i int, t string")
    assert {(r.i, r.t) for r in rel.lookup(a.select("i"), notes, "i").collect()} == {(1, "a"), (2, None)}
    assert {tuple(r) for r in rel.missing_ids(a, spark.createDataFrame([(2,), (3,)], "i int"), "i").collect()} == {(1, "a"), (3, "b")}


def test_samples(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id").withColumn("g", F.col("doc_id") % 3)
    assert sm.stratified_sample(df, ["g"], 5).count() == 15
    assert sorted(map(tuple, sm.global_sample(df, 10).collect())) == sorted(map(tuple, sm.global_sample(df.repartition(9), 10).collect()))
    assert sm.global_sample(df, fraction=0.155).count() == 15 and sm.cap_rows(df, 0, "doc_id").count() == 100 and sm.cap_rows(df, 3, "doc_id").count() == 3
    for bad in ({"n": 101}, {"fraction": 0.0}, {"fraction": 1.5}, {}):
        with pytest.raises(ValueError):
            sm.global_sample(df, **bad)
    drawn = sm.sample_with_replacement(df, ["g"], 50)
    assert drawn.count() == 150 and drawn.select("draw", "g").distinct().count() == 150


def test_assignment(spark):
    rows = [(i, i >= 7) for i in range(10)]
    df = spark.createDataFrame(rows, "i int, r boolean")
    got = {r.i: r.annotator for r in an.assign(df, "r", "i", ["n1"], ["a1", "a2"]).collect()}
    assert len(got) == 10 and all(got[i].startswith("a") for i in (7, 8, 9)) and sum(v == "n1" for v in got.values()) == 4
    with pytest.raises(Exception, match="too few unrestricted"):
        an.assign(df.where("r"), "r", "i", ["n1"], ["a1"]).collect()
    everyone = an.with_shared_rows(df, 2, ["n1", "a1", "a2"], "r", "i", ["n1"])
    assert everyone.count() == 2 * 3 + 8


def test_majority_first_seen(spark):
    df = spark.createDataFrame([("u", 0, 1), ("u", 1, 0), ("v", 0, 0), ("v", 1, 1), ("v", 2, 1)], "u string, o int, y int")
    assert {(r.u, r.y) for r in rel.majority(df, "u", "y", "o").collect()} == {("u", 1), ("v", 1)}


def test_token_bucket():
    now = [0.0]
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    b = inf.TokenBucket(60, 600, lambda: now[0], sleep)
    for _ in range(10):
        b.take(100)
    assert now[0] == pytest.approx(40, abs=0.1)


def test_ask_retries():
    left = [inf.RateLimited("slow"), ValueError("bad")]

    def provider(p):
        if left:
            raise left.pop(0)
        return p.upper()

    bucket = inf.TokenBucket(1e9, 1e9)
    assert inf.ask("x", provider, bucket, inf.Calls(), sleep=lambda s: None) == ("X", ["rate limit: slow", "bad"], 3)
    answer, errors, n = inf.ask("x", lambda p: 1 / 0, bucket, inf.Calls(attempts=2), sleep=lambda s: None)
    assert answer is None and n == 2 and len(errors) == 2


def test_inference_and_batches(spark):
    df = spark.createDataFrame([(f"u{i}", "p" * (i % 5 + 1)) for i in range(20)], "uid string, prompt string")
    got = inf.infer(df, inf.stub_provider, inf.Calls(1e9, 1e9, partitions=3)).collect()
    assert len(got) == 20 and {r.status for r in got} == {"ok"}
    assert inf.request_parameters("o1-x", 0.2, 0.5, 9) == {"model": "o1-x", "max_completion_tokens": 9, "temperature": 1, "top_p": 1}


def test_samples_by_histograms(spark, monkeypatch):
    """Samples of any size are the first rows by rank, also where the cut falls among rows of one key."""
    rows = [(i // 3, i, "u") for i in range(900)] + [(None, 1000, "u"), (None, 1001, "u")]
    df = spark.createDataFrame(rows, "doc_id int, nth int, __rank string").repartition(7)
    ranked = sorted((r["h"], r["doc_id"]) for r in df.select("doc_id", sm.hash_rank(42, "doc_id").alias("h")).collect())
    for most in (10_000, 5):
        monkeypatch.setattr(sm, "MOST_RANKS", most)
        for n in (1, 2, 3, 100, 901, 902):
            got = sm.global_sample(df, n)
            assert got.columns == df.columns and len({r.nth for r in got.collect()}) == n
            assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(d) for _, d in ranked[:n])
            assert {r["__rank"] for r in got.collect()} == {"u"}
    assert sm.global_sample(df, fraction=0.001).count() == 0
    with pytest.raises(ValueError):
        sm.global_sample(df, 903)


def test_facts_keep_form_feeds(spark):
    from factloom.functions.text import split_facts

    df = spark.createDataFrame([("1. one\fmore of one\n2. two\nmore of two",), ("before\n* a\n* b",), ("x\ny",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(split_facts(F.col("t"))).collect()]
    assert got == [["one\fmore of one", "two\nmore of two"], ["before", "a", "b"], ["x", "y"], None, []]


def test_an_answer_is_parsed_once(spark, sf_dir):
    from factloom.plans import all_queries

    for name in ("doc_prf", "parse_verdicts"):
        plan = all_queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json") <= 3, plan.count("parse_json")  # the answer, or else its braces
