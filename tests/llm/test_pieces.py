"""Merge-dropout: exact round trips, parity with the library without dropout, and seeded variety."""

import hashlib

import numpy as np
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import pieces
from factloom.llm.pieces import Codec, MergeDropout

PLAIN = Codec(MergeDropout(dropout=0.0))
VARIED = Codec(MergeDropout(dropout=0.3))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)


def test_without_dropout_equals_the_library(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  two  spaces ", "tab\tand\nnewline", "漢字 и кириллица 😀", "don't (stop)... #x=1;", "a" * 500, "É" * 50 + "1.2,3"]
    for t in texts:
        assert list(PLAIN.encode(t)) == LIBRARY.encode(t), t[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",))), st.integers(-(2**63), 2**63 - 1))
def test_round_trip(text, key):
    ids = VARIED.encode(text, key)
    assert (VARIED.decode(ids) if text else "") == text


def test_literal_marks_and_long_words():
    for t in ["▁", "a▁b ▁ c▁▁", "x" * 5000, " ▁", "<s></s><unk><0x41>"]:
        assert VARIED.decode(VARIED.encode(t, 3)) == t


def test_seeded_and_varied():
    text = " ".join(["nation", "international", "entertaining"] * 40)
    a, b = VARIED.encode(text, 1), VARIED.encode(text, 2)
    assert a == VARIED.encode(text, 1) == Codec(MergeDropout(dropout=0.3)).encode(text, 1) and a != b
    assert a != Codec(MergeDropout(dropout=0.3, seed=5)).encode(text, 1)
    assert len(a) > len(PLAIN.encode(text))
    assert len({VARIED.word(" international", v) for v in range(8)}) > 1


def test_small_cache_gives_the_same(spark):
    small = Codec(MergeDropout(dropout=0.3, cache_words=3))
    text = "several different words, which come again: several different words"
    assert [small.encode(text, k) for k in range(5)] == [VARIED.encode(text, k) for k in range(5)]


def test_frames(spark, sf_dir):
    rows = [(1, "one two", "k"), (2, None, None), (3, "", None), (None, "one two", None), (1, "one two", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ids string")
    out = pieces.decode(pieces.encode(df)).collect()
    assert out[0].n_ids == "k" and [r.decoded for r in out] == [r[1] for r in rows] and out[0].ids == out[4].ids
    both = pieces.encode(df, outputs=("ids", "n_ids", "lossless"), keep_text=False).collect()
    assert both[0].n_ids == len(both[0].ids) and [r.lossless for r in both] == [True, None, True, True, True]
    assert out[1].ids is None and out[2].ids == []
    assert pieces.encoded_digest(df.limit(0)).collect() == []
    told = pieces.encoded_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert told.where(~F.col("lossless")).count() == 0 and told.count() == 200


M = 2**64 - 1
VOCABULARY = {LIBRARY.id_to_piece(i): i for i in range(LIBRARY.get_piece_size()) if not (LIBRARY.is_byte(i) or LIBRARY.is_control(i) or LIBRARY.is_unknown(i) or LIBRARY.is_unused(i))}
BYTES = {int(LIBRARY.id_to_piece(i)[3:5], 16): i for i in range(LIBRARY.get_piece_size()) if LIBRARY.is_byte(i)}


def brute_skips(place, dropout):
    """32 decisions: each 16 bits of a mixed hash pick one of 256 patterns of eight, by their probabilities."""
    x = (place ^ place >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    x ^= x >> 31
    out = []
    for lane in range(4):
        draw, upto = (x >> 16 * lane & 0xFFFF) + 0.5, 0.0
        for m in range(256):
            upto += dropout ** m.bit_count() * (1 - dropout) ** (8 - m.bit_count()) * 65536
            if draw <= upto or m == 255:
                out += [m >> b & 1 for b in range(8)]
                break
    return out


def brute_word(word, place, dropout):
    """The agenda as a plain list, searched anew for its best entry at every turn."""
    symbols = {i: c for i, c in enumerate(word.replace(" ", "▁"))}  # by place of their first character
    score = lambda a, b: LIBRARY.get_score(VOCABULARY[a + b]) if a in VOCABULARY and b in VOCABULARY and a + b in VOCABULARY else None

    def right(i):
        return i + len(symbols[i]) if i + len(symbols[i]) in symbols else None

    def entry(i):
        return None if i is None or right(i) is None or (x := score(symbols[i], symbols[right(i)])) is None else (-x, i)

    agenda = [e for i in symbols if (e := entry(i))]
    turn, skips = 0, brute_skips(place, dropout)
    while agenda:
        best = min(agenda)
        agenda.remove(best)
        i = best[1]
        if i not in symbols or entry(i) != best:
            continue
        if turn and turn % 32 == 0:
            skips = brute_skips(xxhash.xxh64_intdigest(turn.to_bytes(8, "little"), place), dropout)
        turn += 1
        if skips[(turn - 1) % 32]:
            continue
        symbols[i] += symbols.pop(right(i))
        left = max((k for k in symbols if k < i), default=None)
        agenda += [e for e in (entry(i), entry(left)) if e]
    return [x for i in sorted(symbols) for x in ([VOCABULARY[symbols[i]]] if symbols[i] in VOCABULARY else [BYTES[b] for b in symbols[i].encode()])]


def brute(text, key, conf):
    at = xxhash.xxh64_intdigest((key & M).to_bytes(8, "little"), conf.seed)
    words = VARIED.cut.findall(" " + text)
    return [i for n, w in enumerate(words, 1) for i in brute_word(w, (at + n * 0x9E3779B97F4A7C15) & M, conf.dropout)]


def test_whole_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in pieces.encoded_digest(docs).collect()}
    assert len(got) == len(rows)
    short = [(d, t) for d, t in rows if t and len(t) < 1500]
    assert len(short) > 20
    for d, t in short:
        ids = brute(t, d, MergeDropout())
        assert got[d].n_ids == len(ids) and got[d].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), d


def test_many_candidates_and_cuts_by_brute_force():
    conf = MergeDropout(dropout=0.3)
    for key, text in enumerate(["internationalization" * 6, "漢字 understanding 😀é", "nation " * 50, "a" * 200]):
        assert list(VARIED.encode(text, key)) == brute(text, key, conf)
    assert len({bytes(VARIED.word(" understanding", p)) for p in range(300)}) > 10


def test_many_words_at_once_equal_one_at_a_time():
    words = [" a", "x", " antidisestablishment", " zzzzzzzzzzzzzzzz", " ünïcødé", "日本語", " 123456789", "''''''''", " " * 20, "a" * 24, " naïvé"]
    masks = np.array([(k * 0x9E3779B1 + 1) % (1 << 32) & (0xFFFFFFFF if k % 3 else 0) for k in range(len(words) * 40)], np.uint32)
    many = [w for w in words for _ in range(40)]
    for w, mask, (ids, turns) in zip(many, masks.tolist(), VARIED.agendas(many, masks)):
        if turns <= 32:
            assert (ids, turns) == VARIED.agenda(w, mask)


def test_texts_together_equal_texts_alone():
    texts = ["", None, "understanding the nations " * 400, "▁▁ x " + "y" * 5000, "segmentation of words, " * 300, "understanding the nations " * 400]
    keys = [1, 2, 3, None, 5, 3]
    together = Codec(MergeDropout(dropout=0.3, cache_words=50)).encode_all(texts, keys)
    assert together == [None if t is None else VARIED.encode(t, k or 0) for t, k in zip(texts, keys)]
    assert all(t is None or VARIED.decode(e) == t for t, e in zip(texts, together))


def test_repeated_rows_and_null_keys_in_a_frame(spark):
    """Repeated rows get the same ids, a null key counts as key 0, and a column with the name of an output is replaced."""
    rows = [(5, "understanding nations", "x"), (5, "understanding nations", "y"), (None, "understanding nations", "x"), (0, "understanding nations", "x"), (7, None, "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ids string").repartition(3)
    got = pieces.encode(df, MergeDropout(dropout=0.5), outputs=("ids", "n_ids", "lossless"))
    assert got.columns == ["doc_id", "text", "ids", "n_ids", "lossless"]
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append(r)
    assert found[5][0] == found[5][1] and found[None][0].ids == found[0][0].ids
    assert found[7][0].ids is None and found[8][0].ids == [] and all(r.lossless for k in (5, None, 0, 8) for r in found[k])
