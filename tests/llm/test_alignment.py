"""The event sweep against a brute force that walks two lists of tokens from the libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import alignment as al

TEXTS = [
    "a  b\n  c", " lead", "trail ", "\n", " ", "▁ x", "a▁b c", "x\x1c y", "é" * 50, "ab cab" * 2000, "<s> <|endoftext|> </s> <unk> <0x41>",
    "日本語 テキスト", "😀😀 a😀", "", None, "ipsips" * 900, "  x", "a　 b", "tab\t\tand\r\nline", "word " * 3000,
]
SMALL = al.Alignment(run_tokens=7, sweep_tokens=50, counted_pairs=500, broadcast_pairs=300)
ALL = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def groups_of(text, both, encode_a, encode_b):
    if not text:
        return []
    a, b = encode_a(" " + text), encode_b(text)
    whole = (" " + text).encode()
    if b"".join(both.a[x] for x in a) != whole or b"".join(both.b[x] for x in b) != whole:
        return []
    found, ga, gb, at, bt = [], [], [], 0, 0
    a, b = a[::-1], b[::-1]
    while a or b:
        if at <= bt:
            ga.append(a.pop())
            at += len(both.a[ga[-1]])
        else:
            gb.append(b.pop())
            bt += len(both.b[gb[-1]])
        if at == bt:
            found.append((ga, gb))
            ga, gb = [], []
    return found


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    both, whole = al.Sides(al.Alignment()), Tokenizer.from_file(al.BYTE_BPE)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=al.PIECES)
    docs = [(d, groups_of(t, both, lambda x: whole.encode(x, add_special_tokens=False).ids, pieces.encode)) for d, t in rows]
    counts, best = Counter(), Counter()
    for _, found in docs:
        counts.update({(x, y) for ga, gb in found for x in ga for y in gb})
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for d, found in docs:
        told = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in found)
        links = Counter((x, y) for ga, gb in found for x in ga for y in gb)
        out.append((
            d, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), links.total(), sum(n for p, n in links.items() if counts[p] == best[p[0]]),
            sum(n * counts[p] for p, n in links.items()), hashlib.sha256(told.encode()).hexdigest() if told else "",
        ))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**7 + i, t) for i, t in enumerate(TEXTS)] + [(None, "the the the")] * 3
    return rows, brute(rows)


@pytest.mark.parametrize("conf", [al.Alignment(), SMALL], ids=["production", "small"])
def test_against_brute_force(spark, corpus, conf):
    rows, want = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(al.aligned_documents(docs, conf).select(*ALL).collect()) == ordered(want)


def test_groups_and_links(spark):
    docs = spark.createDataFrame([(1, "Tokenizers disagree, sometimes."), (2, None)], "doc_id long, text string")
    told = {r.doc_id: r.groups for r in al.document_groups(docs).collect()}
    assert told[2] == ""
    for conf in (al.Alignment(), SMALL):
        links = Counter()
        for r in al.document_links(docs, conf).collect():
            links[r.a, r.b] += r.n
        want = Counter()
        for group in told[1].split(";"):
            a, b = (x.split(",") for x in group.split("|"))
            want.update((int(x), int(y)) for x in a for y in b)
        assert links == want
    (row,) = al.aligned_documents(docs.where("doc_id = 1")).collect()
    assert row.groups_sha256 == hashlib.sha256(told[1].encode()).hexdigest()


def test_large_group():
    """A group without common ends inside: pairs are made from the distinct ids, in slices."""
    conf = al.Alignment(sweep_tokens=1000)
    machine = al.Sweep(conf)
    lengths = al.tables(conf).length
    a = np.flatnonzero(lengths[0] == 3)[:2].astype(np.uint16)
    b = np.flatnonzero(lengths[1] == 3)[:2].astype(np.uint16)
    short_a, short_b = np.flatnonzero(lengths[0] == 1)[:1].astype(np.uint16), np.flatnonzero(lengths[1] == 1)[:1].astype(np.uint16)
    side_a = np.concatenate([short_a, np.tile(a, 300)])
    side_b = np.concatenate([np.tile(b, 300), short_b])
    rows = []
    for k in range(0, 601, 100):
        rows += machine.feed(5, 9, 0, side_a[k : k + 100])
        rows += machine.feed(5, 9, 1, side_b[k : k + 100])
    rows += machine.sweep(whole=True)
    assert rows[-1][:6] == (5, 9, 601, 601, 1, 601 * 601) and sum(r[8] for r in rows) == 9 and all(r[7] for r in rows)


def test_engine_of_a_is_exact():
    """Ids by rank equal those of the file's own library, around every code point of the basic plane that can matter."""
    from tokenizers import Tokenizer

    both, whole = al.Sides(al.Alignment()), Tokenizer.from_file(al.BYTE_BPE)
    whole.encode_special_tokens = True
    texts = [f"a{chr(c)}1{chr(c)}! {chr(c)}  {chr(c)}b" for c in range(0, 0x10000, 7) if not 0xD800 <= c < 0xE000]
    for t, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert both.encode_a(t) == e.ids, t


def test_other_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "x y", 7, "s")], "doc_id long, text string, row long, side string")
    assert al.aligned_documents(docs).count() == 1
    assert al.aligned_documents(docs.limit(0)).collect() == []
