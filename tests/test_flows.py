"""Batch jobs, streamed answers, grids of runs, token counts by a vocabulary, term files and archives of any size."""

import base64
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.functions import tokens as tk
from factloom.nlp.sentences import annotate
from factloom.nlp.tokenizer import Lexicon, cut_word, tokenize
from factloom.operators import inference as inf
from factloom.operators import sampling as sm
from factloom.sources import readers as rd
from factloom.sources import writers as wr


def test_chunks(spark):
    rows = [(1, 1, "b", False), (1, 0, "a", None), (2, 0, None, True), (2, 1, "c", False), (3, 0, None, False)]
    got = inf.join_chunks(spark.createDataFrame(rows, "k int, i int, t string, held boolean"), "k", "i", "t", "held").collect()
    assert sorted(map(tuple, got)) == [(1, "ab", "ok"), (2, "SAFETY_HAZARDc", "blocked"), (3, "GENERATION_FAILED", "failed")]


def test_jobs_that_fail_or_run_on(spark, tmp_path):
    service = inf.BatchService(lambda request, rows: f"{rows[0][0] % 3}-{request}-{len(rows)}", lambda j: ["done", "failed", "running"][int(j[0])], lambda j: [(int(j[-1]), "x")])
    prompts = spark.range(9).select(F.col("id").alias("uid"), F.lit("p").alias("prompt")).coalesce(1)
    inf.submit_batches(prompts, service, str(tmp_path / "jobs"), size=4)
    jobs = spark.read.parquet(str(tmp_path / "jobs"))
    assert sorted(r.n for r in jobs.collect()) == [1, 4, 4]
    got = inf.collect_batches(jobs, service, "bigint", polls=2, pause=0.0).collect()
    assert sorted((r.job[0], r.key, r.status) for r in got) == [("0", 4, "ok"), ("1", None, "failed"), ("2", None, "running")]


def test_grid_runs_only_what_is_missing(spark, tmp_path):
    ran = []
    step = lambda c: ran.append(c) or spark.range(1)
    axes = {"model": ["a", "b"], "prompt": ["p"]}
    assert inf.run_grid(spark, axes, step, str(tmp_path / "g")).count() == 2
    assert inf.run_grid(spark, {**axes, "prompt": ["p", "q"]}, step, str(tmp_path / "g")).count() == 4 and len(ran) == 4


def test_bpe_counts(spark, tmp_path):
    ranks = tmp_path / "own.tiktoken"
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b" ab", b"abab"]
    ranks.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    df = spark.createDataFrame([(0, "ab ab"), (1, "ababé"), (2, ""), (3, None)], "doc_id int, note_text string")
    got = df.select("doc_id", tk.bpe_counter(str(ranks))(F.col("note_text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {0: 2, 1: 3, 2: 0, 3: None}
    assert [r.doc_id for r in sm.token_band(df, "note_text", 0, 3, count=tk.bpe_counter(str(ranks))).collect()] == [0]


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="needs public vocabularies")
def test_bpe_counts_agree_with_another_library(spark, sf_dir):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", tk.bpe_counter("/opt/tokenizers/byte_bpe_50k.tiktoken")(F.col("text")).alias("n")).collect()
    want = other.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert [r.n or 0 for r in rows] == [len(w.ids) for w in want]


def test_terms(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("Cardiol.\n\n q.x.y \nCardiol.\n")
    terms = rd.read_terms(spark, str(tmp_path / "terms.txt"))
    assert terms == {"Cardiol.", "q.x.y"}
    with pytest.raises(ValueError):
        rd.read_terms(spark, str(tmp_path / "terms.txt"), most=1)
    assert cut_word("Cardiol.") == ("Cardiol", ".") and cut_word("Cardiol.", Lexicon(terms)) == ("Cardiol.",)
    df = spark.createDataFrame([(1, "Seen by Cardiol. She left.")], "id int, note_text string")
    assert len(annotate(df, "note_text").first().sentences) - len(annotate(df, "note_text", lexicon=Lexicon(terms)).first().sentences) in (0, 1)


def test_terms_that_stay_whole(spark, tmp_path):
    """Dotted and slashed letters by rule; all others as a file of terms."""
    for word in "b.i.d. A.A.F.P. B.D.Sc. r/r/w s/p w/".split():
        assert [t for t, _ in tokenize(f"on {word} she")] == ["on", word, "she"]
    terms = "Apr. Dec. Inpt. Cx. q.4h. q.4-6h p.o.q.d d/c'd E.coli A.Fib y.o a. +/- mEq. No.1 &gt; PH.D. x-ray".split()
    (tmp_path / "terms.txt").write_text("\n".join(terms))
    lexicon = Lexicon(rd.read_terms(spark, str(tmp_path / "terms.txt")))
    for word in terms:
        assert [t for t, _ in tokenize(f"on {word} she", lexicon)] == ["on", word, "she"]


def test_large_zips(spark, tmp_path):
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w") as z:
            for i in range(5):
                z.writestr(f"p100/p10{i}/s5{a}{i}0.txt", f"Note {a} {i} é")
            z.writestr("readme.md", "no")
    small, large = (sorted((r.member, r.note_text) for r in f(spark, str(tmp_path / "*.zip")).collect()) for f in (rd.read_zipped_texts, rd.read_large_zips))
    assert small == large and len(large) == 10


def test_csv_keeps_blanks_and_repartitions_gzip(spark, tmp_path):
    df = spark.createDataFrame([(1, "  text \n"), (2, None), (3, "a\r\nb\\"), (4, '""')], "id int, note_text string")
    wr.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, rd.read_csv(spark, str(tmp_path / "c"), "id int, note_text string").collect())) == sorted(map(tuple, df.collect()))
    df.where("id = 4").write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "z"))
    assert rd.read_csv(spark, str(tmp_path / "z"), "id int, note_text string", partitions=3).rdd.getNumPartitions() == 3
