"""Re-Pair files against the library's ids, and decoding in any place."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import grammar as g

TEXTS = [
    None, "", " ", "The Cat's naïve ÉCOLE, isn't it? 3.14 x2", "it's they've I'm we'll he'd O'Neil's", "<|endoftext|> <|startoftext|>", "a b c\x1cd\x85e",
    "Amélie İstanbul ẞ ﬁ Σίσυφος ΌΣ", "日本語 テキスト", "😀 x", "same same " * 4000, "a" * 5000, "é ́x", "#2 ## 2", "ªº µ ²³¼", "tab\tline\r\n\x0b\x0cend", "x\x00y\x7f z",
]


def brute(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(g.TOKENIZER)
    whole.encode_special_tokens = True
    return [(d, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + k, t) for k, t in enumerate(TEXTS)]
    return rows, brute(sorted(rows))


@pytest.mark.parametrize("conf", [g.IdFiles(), g.IdFiles(shard_ids=5000, least=3, least_gain=0.001, slots=10)], ids=["production", "small"])
def test_whole_table(spark, corpus, conf, tmp_path):
    rows, want = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    g.write_ids(docs, str(tmp_path / "ids"), conf)
    found = sorted(g.read_documents(spark, str(tmp_path / "ids"), with_ids=True).collect())
    start = 0
    for r, (doc_id, ids) in zip(found, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    every = [i for _, ids in want for i in ids]
    for first, last in ((0, 1), (17, 40_000), (len(every) - 3, len(every) + 9), (5, 5)):
        told = sorted(g.read_range(spark, str(tmp_path / "ids"), first, last).collect())
        assert [i for r in told for i in r.ids] == every[first:last]


def test_query(spark, corpus):
    rows, want = corpus
    found = sorted(g.written_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert [(r.doc_id, r.n_tokens) for r in found] == [(d, len(i)) for d, i in want]


def test_grammar_is_compact_and_exact():
    rng = random.Random(5)
    phrases = [[rng.randrange(1000) for _ in range(rng.randrange(2, 9))] for _ in range(60)]
    docs = [[i for _ in range(rng.randrange(1, 40)) for i in rng.choice(phrases)] + [7] * rng.randrange(0, 9) + [2] for _ in range(400)]
    ids, counts = np.array([i for d in docs for i in d], np.uint16), np.array([len(d) for d in docs])
    conf = g.IdFiles(least=4, least_gain=0.001)
    s, rules = g.compress(ids, counts, conf, 1000)
    assert len(s) + 2 * len(rules) < len(ids) / 3
    lengths = g.expansion_lengths(rules, 1000)
    shard = g.Shard({"terminals": 1000, "symbols": s.tobytes(), "rules": rules.tobytes(), "lengths": lengths.tobytes()})
    for _ in range(300):
        a = rng.randrange(len(ids))
        b = rng.randrange(a, len(ids) + 1)
        assert (shard.ids(a, b) == ids[a:b]).all()
    # No rule spans two documents: every document's end is a symbol's end.
    assert set(np.cumsum(counts).tolist()) <= set(shard.ends.tolist())
    assert all(max(r) < 1000 + k for k, r in enumerate(rules.tolist()))


def test_run_of_one_id():
    ids = np.full(4097, 9, np.uint16)
    s, rules = g.compress(ids, np.array([4097]), g.IdFiles(least=2), 10)
    shard = g.Shard({"terminals": 10, "symbols": s.tobytes(), "rules": rules.tobytes(), "lengths": g.expansion_lengths(rules, 10).tobytes()})
    assert len(s) < 40 and (shard.ids(0, 4097) == 9).all()


def test_nulls_ties_and_repeats(spark):
    rows = [(None, "b"), (None, "a a"), (5, "x y z"), (5, "x y z"), (5, "w"), (6, None)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, part string, h int")
    found = sorted(g.written_documents(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, 5, 5, 5, 6] and [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found[:-1]]).tolist()
    assert sorted(r.n_tokens for r in found) == sorted(len(i) for _, i in brute(rows))
    again = sorted(g.written_documents(docs.repartition(4)).collect(), key=lambda r: r.start)
    assert again == found
    assert g.written_documents(docs.where(F.lit(False))).collect() == []
