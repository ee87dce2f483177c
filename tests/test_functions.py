"""Truth tables of scalar functions and metrics."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.ids import compose, parse_custom_id
from factloom.functions.tokens import chat_tokens, cost_estimate
from factloom.functions.verdict import map_unparseable, with_verdict
from factloom.operators import metrics as mt
from factloom.sources.readers import path_metadata

VERDICTS = [
    ('{"entailment_prediction": 1}', "1", False, 1), ('text {"entailment_prediction": 0} text', "0", False, 0), ('{"entailment_prediction": "1"}', "1", True, 0),
    ("{'entailment_prediction': 0}", "1", False, 1), ('{"entailment_prediction": true}', "true", False, 1), ('{"entailment_prediction": 1.0}', None, False, 1),
    ('{"entailment_prediction": null}', None, True, 0), ('{"entailment_prediction": 2}', "2", True, 0), ("Answer: 0", "0", False, 0), ("score 7", "7", True, 0),
    ("not entailment", "1", False, 1), ("neutral", "0", False, 0), ("Yes.", "1", False, 1), ("unknown", "0", False, 0), ("maybe", None, True, 0), ("", None, True, 0), (None, None, True, 0),
    ('{"a": {"entailment_prediction": 1}}', "1", False, 1), ("[1, 2", "2", True, 0), ('{"x": 3} yes', "1", False, 1),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VERDICTS)], "i int, answer string")
    got = with_verdict(df, "answer").orderBy("i").collect()
    for g, (answer, raw, bad, pred) in zip(got, VERDICTS):
        assert (g.not_parseable, g.prediction) == (bad, pred), answer
        if raw is not None:
            assert g.raw == raw, answer


def test_map_unparseable(spark):
    df = spark.createDataFrame([(1, False), (0, True)], "p int, u boolean")
    told = lambda to: [r[0] for r in df.select(map_unparseable(F.col("p"), F.col("u"), to)).collect()]
    assert (told(-1), told(0), told(1)) == ([1, None], [1, 0], [1, 1])
    with pytest.raises(ValueError):
        told(2)


def test_custom_ids(spark):
    rows = [("a|b|3|p",), ("d|ds|nt|p|5|recall",), ("a|b|c|d|e",), ("a|b|x|p",), (None,), ("d|ds|nt|p|five|recall",)]
    df = spark.createDataFrame(rows, "c string")
    got = df.select(*[c.alias(n) for n, c in parse_custom_id(F.col("c")).items()]).collect()
    assert (got[0].dataset, got[0].split, got[0].uid, got[0].prompt, got[0].doc_id) == ("a", "b", 3, "p", None)
    assert (got[1].doc_id, got[1].note_type, got[1]["index"], got[1].entailment_type, got[1].uid) == ("d", "nt", 5, "recall", None)
    assert all(all(v is None for v in r) for r in got[2:])
    assert spark.range(1).select(compose(F.lit("a"), F.lit(None).cast("string"))).first()[0] is None


FACTS = [
    ("## Atomic Facts:\n1. Fact one.\n2. Fact two.\n   - Subfact A.\n   - Subfact B.\n3. Fact three.", ["Fact one.", "Fact two.\n- Subfact A.\n- Subfact B.", "Fact three."]),
    ("## Facts:\n* one\n* two\n* three", ["one", "two", "three"]), ("one\ntwo\n\nthree", ["one", "two", "three"]), ("", []), (":\n1. a\n2. :", ["a"]), (" * only ", ["only"]),
]


def test_split_facts(spark):
    df = spark.createDataFrame([(i, f[0]) for i, f in enumerate(FACTS)], "i int, t string")
    got = [r.f for r in df.select("i", tx.split_facts(F.col("t")).alias("f")).orderBy("i").collect()]
    assert got == [f[1] for f in FACTS]
    plain = [r.f for r in df.select("i", tx.split_facts_plain(F.col("t")).alias("f")).orderBy("i").collect()]
    assert plain[1] == ["* one", "two", "three"] and plain[2] == ["one\ntwo\n\nthree"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.split_delimited(F.lit(" a \n b//c//"))) == ["a   b", "c", ""] and one(tx.split_delimited(F.lit(""))) == [""]
    assert one(tx.fill_template("P: {premise} H: {hypothesis} {{x}}", premise=F.lit("has {hypothesis}"), hypothesis=F.lit("h"))) == "P: has {hypothesis} H: h {x}"
    assert one(tx.token_estimate(F.lit(" a b\n c "))) == 4.0 and one(tx.word_count(F.lit("   "))) == 0
    assert one(tx.extracted(F.lit("abc"), "(x)")) is None and one(tx.safe_name(F.lit("a/b"))) == "a_b"
    assert tx.text_column(["id", "note_text_x"]) == "note_text_x" and tx.endpoint("https://h.example/v1/chat/completions") == "chat/completions"
    for bad in (lambda: tx.text_column(["a"]), lambda: tx.fill_template("{a}"), lambda: tx.endpoint("ftp://x")):
        with pytest.raises(ValueError):
            bad()


PROPORTIONS = [([1, 1, 1, 1], None, 1.0), ([0, 0, 0, 0], None, 0.0), ([1, 0, 1, 0], None, 0.5), ([1, 1, 1], [2, 2, 2], 1.0), ([0, 0, 0], [3, 3, 3], 0.0), ([1, 0, 1, 0], [1, 2, 1, 2], 1 / 3), ([1, 1, 0, 1], [3, 1, 4, 2], 0.6), ([], None, 0.0), ([], [], 0.0)]


@pytest.mark.parametrize("preds, weights, want", PROPORTIONS)
def test_proportion(spark, preds, weights, want):
    df = spark.createDataFrame(list(zip(preds, weights or [1] * len(preds))), "p int, w int")
    assert df.agg(mt.proportion(F.col("p"), F.col("w") if weights is not None else None)).first()[0] == pytest.approx(want, rel=1e-9)


def test_weight_of_zero_fails(spark):
    with pytest.raises(Exception, match="weight is 0"):
        spark.createDataFrame([(1, 1.0), (1, 0.5)], "p int, w double").agg(mt.proportion(F.col("p"), F.col("w"))).collect()


def test_document_scores(spark):
    rows = [("a", "precision", 1), ("a", "recall", 0), ("b", "precision", 0), ("b", "recall", 0), ("c", "precision", 1), ("d", "precision", None), ("e", "precision", 1), ("e", "recall", 1), ("e", "recall", 0)]
    got = {r.d: r for r in mt.document_scores(spark.createDataFrame(rows, "d string, entailment_type string, entailment_pred int"), ["d"]).collect()}
    assert set(got) == {"a", "b", "c", "e"} and got["a"].fact_f1 == got["b"].fact_f1 == 0.0
    assert got["c"].fact_f1 is None and got["c"].n_sents is None and got["e"].fact_f1 == pytest.approx(2 / 3, abs=1e-8)


def test_costs(spark):
    prompts = spark.createDataFrame([(100,), (200,)], "t int")
    r = cost_estimate(prompts, "t", "medium", max_tokens=10).first()
    assert r.tokens_per_request == 10 + 150 + 2 * 100 / 4 and r.worst_cost == pytest.approx(0.3 * 0.003 + 0.02 * 0.015)
    with pytest.raises(ValueError):
        cost_estimate(prompts, "t", "none")
    with pytest.raises(Exception, match="above the limit"):
        cost_estimate(prompts, "t", "medium", most=1e-9).collect()
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("a b c").alias("content")))
    assert spark.range(1).select(chat_tokens(m, tx.word_count, 1, 15)).first()[0] == 4 + 1 + 3 + 2 + 15


def test_path_metadata(spark):
    df = spark.createDataFrame([("/r/m1/ds/pdac/x_PROMPT2_ICL_precision.json",), ("x.json",)], "p string")
    got = df.select(*[c.alias(n) for n, c in path_metadata(F.col("p")).items()]).collect()
    assert tuple(got[0])[:6] == ("m1", "ds", "progress_note", "pdac", "PROMPT2_ICL", "precision") and got[1].llm is None and got[1].prompt is None
