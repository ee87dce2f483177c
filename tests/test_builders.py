"""Composite flows and the smaller helpers."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.nlp import sentences as ns
from factloom.operators import annotate as an
from factloom.operators import builders as bd
from factloom.operators import metrics as mt
from factloom.operators import pairs as pr
from factloom.operators import relational as rel
from factloom.sources import readers as rd
from factloom.sources import writers as wr


def test_combine_notes(spark):
    a = spark.createDataFrame([(1, "a b c", "n", "d")], "doc_id int, TEXT string, note_type string, dataset_name string")
    b = spark.createDataFrame([(2, "x", 9.0, "n", "e")], "doc_id int, note_text string, est_token_count double, note_type string, dataset_name string")
    assert [tuple(r) for r in bd.combine_notes([a, b]).orderBy("doc_id").collect()] == [(1, "a b c", 4.0, "n", "d"), (2, "x", 9.0, "n", "e")]


def test_sample_corpus_claims_each_row_once(spark):
    rows = [(i, f"word {i % 20} " * 60, i % 2) for i in range(80)]
    notes = spark.createDataFrame(rows, "doc_id int, note_text string, g int")
    strata = [bd.Stratum("one", "t", F.col("g") == 0, dedup=True), bd.Stratum("all", "t", F.lit(True))]
    got = bd.sample_corpus(notes, strata, 30).collect()
    assert len({r.doc_id for r in got}) == len(got)
    assert sum(r.dataset_name == "one" for r in got) == 10 and sum(r.dataset_name == "all" for r in got) == 30


def test_result_tables(spark):
    rows = [("d|s|1|p", "m", 1, "Yes.", 0), ("d|s|1|p", "m", 1, "no", 1), ("d|s|2|p", "m", None, "Yes.", 2), ("x|d|n|p|4|recall", "m", 1, "maybe", 3)]
    df = spark.createDataFrame(rows, "custom_id string, model string, label int, model_output string, ord int")
    good, rejects = bd.nli_table(df, [F.col("ord")])
    assert {(r.custom_id, r.entailment_pred) for r in good.collect()} == {("d|s|1|p", 0), ("x|d|n|p|4|recall", 0)} and rejects.count() == 1
    table = {r.ord: r for r in bd.verdict_table(df).collect()}
    assert table[3]["index"] == 4 and table[3].not_parseable and table[0].entailment_pred == 1


def test_pairs_and_records(spark):
    notes = spark.createDataFrame([(1, "The note. It ends.")], "doc_id int, note_text string")
    decomp = spark.createDataFrame([("u", 1, "fact a//fact b")], "uid string, doc_id int, fact_decomp string")
    sentences = F.split(F.lit("The note.|It ends.|Really."), r"\|")
    pairs = pr.all_pairs(decomp, tx.split_delimited(F.col("fact_decomp")), sentences)
    assert pairs.count() == 2 + 3
    filled = pr.with_premises(pairs, notes, decomp, "P {premise} H {hypothesis}").collect()
    assert {r.prompt for r in filled if r.entailment_type == "precision"} == {"P The note. It ends. H fact a", "P The note. It ends. H fact b"}
    assert all(r.premise == "fact a//fact b" for r in filled if r.entailment_type == "recall")
    told = json.loads(bd.pair_records(pr.with_premises(pairs, notes, decomp, "{premise}{hypothesis}"), "m").first().value)
    assert set(told) == {"metadata", "messages"} and told["metadata"]["model_name"] == "m"
    m = spark.range(1).select(pr.chat_messages(F.lit("hi"), "be brief")).first()[0]
    assert [(x.role, x.content) for x in m] == [("system", "be brief"), ("user", "hi")]


def test_small_relational_helpers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, k string")
    assert rel.cross_templates(df, spark.createDataFrame([("t",), ("u",)], "name string")).count() == 6
    ordered = rel.order_in_partitions(df, "i", 2).withColumn("p", F.spark_partition_id()).collect()
    assert sorted(ordered, key=lambda r: (r.p, r.i)) == sorted(ordered, key=lambda r: r.i)
    assert {r.n for r in rel.window_count(df, ["k"], "n").collect()} == {1}
    assert [tuple(r) for r in rel.null_census(df).orderBy("column_name").collect()] == [("i", 0), ("k", 1)]
    wide = rel.wide_form(spark.createDataFrame([("x", "p", 1), ("x", "r", 2)], "id string, t string, v int"), ["id"], "t", ["p", "r"], ["v"])
    assert [tuple(r) for r in wide.select("id", "v_p", "v_r").collect()] == [("x", 1, 2)]
    shown = mt.histogram(spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double"), "v").collect()
    assert [(r.bin, r.n, r.share) for r in shown] == [(0, 2, 1.0)]


def test_annotation_sample(spark):
    df = spark.createDataFrame([(f"u{i}", "ab"[i % 2]) for i in range(50)], "uid string, model_name string")
    got = an.annotation_sample(df, ["a"], 10).collect()
    assert len(got) == 10 and {r.model_name for r in got} == {"a"}


def test_flat_completions_and_templates(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text(json.dumps({"choices": [{"message": {"content": "c"}}], "model": "m", "prompt": "p"}))
    assert tuple(rd.read_flat_completions(spark, str(tmp_path / "f.jsonl")).select("content", "model", "prompt").first()) == ("c", "m", "p")
    wr.write_templates(spark, {"one": "A {text}\nB"}, str(tmp_path / "t"))
    assert [tuple(r) for r in rd.read_templates(spark, str(tmp_path / "t")).collect()] == [("one", "A {text}\nB")]
    wr.write_jsonl(spark.range(2), str(tmp_path / "j"))
    wr.write_jsonl(spark.range(3), str(tmp_path / "j"), mode="append")
    assert rd.read_jsonl(spark, str(tmp_path / "j"), "id long").count() == 5


def test_registered_splitters(spark):
    ns.register(spark)
    df = spark.createDataFrame([("He is well. She left.",), (None,)], "t string")
    got = [r[0] for r in df.selectExpr("note_sentences_full(t)").collect()]
    assert len(got[0]) == 2 and got[1] == []
    with pytest.raises(ValueError):
        ns.annotate(df, "t", "none")
