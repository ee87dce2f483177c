"""Facts come from the whole text, however long it is."""

import pytest

from factloom.plans import all_queries


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    text = "A short fact. " * 25000 + "The very last fact"
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_last_fact_of_a_long_text(spark, long_dir):
    rows = all_queries()["precision_pairs"](spark, long_dir)
    assert rows.count() == 25001
    assert [r["index"] for r in rows.where("hypothesis = 'The very last fact'").collect()] == [25000]
    assert {r.hypothesis for r in all_queries()["precision_hypotheses"](spark, long_dir).collect()} == {"A short fact", "The very last fact"}


def test_premise_of_a_long_text(spark, long_dir):
    from factloom.plans.base import _decompositions

    facts = _decompositions(spark, long_dir).head().facts
    assert len(facts) == 25001 and facts[-1] == "The very last fact"
