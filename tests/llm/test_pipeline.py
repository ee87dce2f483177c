"""The whole pipeline against a brute-force version that uses no Spark."""

import re

import corpus_pipeline
from factloom.llm import langid
from factloom.llm.mixing import Mix
from factloom.llm.pieces import MergeDropout, codec
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash import brute_print, brute_roots


def test_run_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    model = langid.learn(docs)
    rows = [r for r in rows if not model.predict(r[1])[2]]
    best = {}
    for r in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        best[k] = min(best.get(k, r), r, key=lambda x: (-len(x[1]), x[0]))
    rows = list(best.values())
    prints = {r[0]: brute_print(r[1]) for r in rows}
    root = brute_roots(list(prints.values()))
    first = {}
    for r in rows:
        k = root[prints[r[0]]]
        first[k] = min(first.get(k, r), r)
    rows = list(first.values())
    drawn = brute_mix(rows, Mix())
    rows = [r for r in rows if drawn[r[0]][5]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == {r[0] for r in rows} and 20 < len(got)
    c = codec(MergeDropout())
    for r in rows:
        assert list(got[r[0]].ids) == list(c.encode(r[1], r[0])) and got[r[0]].lossless


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_odd_rows_pass(spark, sf_dir):
    rows = [(None, None, None, None, None, "x"), (1, "", None, None, 0, "x"), (2, "hello there world", "en", "a", 17, "x"), (2, "hello there world", "en", "a", 17, "y"), (3, "z", None, "b", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string")
    for d in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, d, sf_dir).collect()


def test_very_long_texts_and_other_columns_pass_through(spark, sf_dir):
    """Every stage takes a text of a million characters, and columns named like helpers of the stages."""
    base = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang", "source").limit(60).collect()]
    rows = [(*r, "a", "b") for r in base] + [(10**6, " ".join(r[1] for r in base) * (10**6 // sum(len(r[1]) for r in base) + 1), "en", "src0", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __id string, __n string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "__id", "__n"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = docs.collect()
    assert kept and {(r["__id"], r["__n"]) for r in kept} == {("a", "b")}
    long = spark.createDataFrame(rows[-1:], docs.schema)
    (out,) = corpus_pipeline.STAGES[-1][1](spark, long, sf_dir).collect()
    assert out.lossless and out.n_ids > 100_000
