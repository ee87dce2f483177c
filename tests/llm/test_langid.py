"""Nearest-centroid language ID: held-out accuracy, a brute-force vector, and edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import xxhash

from factloom.llm import langid


def brute_features(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    s = " " + " ".join(letters.split()) + " "
    n = Counter()
    for size in (1, 2, 3):
        for i in range(len(s) - size + 1):
            if size == 1 and (i == 0 or i == len(s) - 1):
                continue
            n[s[i : i + size]] += 1
    return n


def test_features_count_all_grams():
    for t in ["That it.", "Éa  b\n12c", "x", "naïve 😀 café", "ПРИВЕТ мир"]:
        ids, counts = langid.features(t)
        want = brute_features(t)
        assert counts.sum() == sum(want.values()) and len(ids) <= len(want) and len(ids) >= len(want) - 1
    assert langid.features("12 34 \n") is None and langid.features("") is None and langid.features(None) is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth) == 1000
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) > 0.97
    assert sum(r.rejected for r in got.values()) <= 5
    assert all(0 <= r.score <= 1 for r in got.values())


def test_cosine_is_that_of_tf_idf():
    texts = [("a", "aa ab ba"), ("b", "zz zy yz"), ("a", "ab ab aa")]
    m = langid.fit(texts, langid.Fit(clusters=1))
    f = langid.features("ab aa")
    v = np.zeros(langid.DIMENSIONS)
    for i, n in zip(*f):
        v[i] = (1 + math.log(n)) * m.idf[i]
    want = max(float(c @ v) / np.linalg.norm(v) for c in m.blocks[0].value[0])
    lang, score, _ = m.predict("ab aa")
    assert lang == "a" and abs(score - want) < 1e-4
    assert m.predict("qqqq jjjj")[2] is True  # nothing in common: too far from every centroid


def test_edges(spark):
    rows = [(i, f"the cat and the dog {i}", "en", "s", 1) for i in range(40)] + [(100 + i, f"der hund und die katze {i}", "de", "s", 1) for i in range(40)]
    odd = [(500, None, "en", None, None), (501, "", "en", None, None), (502, "12 !?", None, None, None), (None, "the dog", "en", None, 1), (503, "the dog", None, "x", 1), (503, "the dog", None, "x", 1), (504, "der und " * 40000, None, "x", 1)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, score int")
    got = langid.identify(df)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows + odd)
    assert [by[k].lang_pred for k in (500, 501, 502, None, 503, 504)] == ["und", "und", "und", "en", "en", "de"]
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows + odd) - 3
    empty = spark.createDataFrame([], df.schema)
    assert langid.identify(empty).collect() == [] and langid.keep_identified(empty).collect() == []
    unlabelled = df.withColumn("lang", df["lang"].substr(100, 1)).where("lang is null")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "code": "def predict(self, text):\n    found = features(text)\n    if found is None or not self.languages:\n        return 0\n    for i in range(10):\n        print(i)\n",
    "b64": "kQ7zP2mX9vB4nL6cR1tW8yH3 jF5dG0sK2uE7iO9pA4wZ6x Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA",
}


def test_other_languages_and_junk_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    for text in FOREIGN.values():
        assert model.predict(text)[2] and model.predict(" ".join([text] * 20))[2]
    told = [model.predict(r.text)[2] for r in docs.select("text").collect()]
    assert sum(told) <= 5


def test_whole_query_against_single_steps(spark):
    """The sample, the model and every row's prediction, by plain Python over the same rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    conf = langid.Fit(per_language=25)
    rows = docs.collect()
    key = {r.doc_id: xxhash.xxh64_intdigest(int(r.doc_id).to_bytes(8, "little", signed=True), 42) for r in rows}
    signed = lambda x: x - 2**64 if x >> 63 else x
    ranked = {}
    for r in sorted(rows, key=lambda r: (signed(key[r.doc_id]), r.doc_id)):
        ranked.setdefault(r.lang, []).append(r)
    texts, share = [], {}
    for lang, own in sorted((k, v) for k, v in ranked.items() if k is not None):
        own = [r for r in own if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
        share[lang] = min(1.0, 150 / len(own))
        texts += [(lang, r.text) for r in [r for r in own if key[r.doc_id] % 2**40 / 2**40 < share[lang]][:25]]
    grams = [(lang, brute_features(t)) for lang, t in texts]
    place = lambda g: langid_place(g)
    vectors = []
    df = np.zeros(langid.DIMENSIONS)
    for lang, n in grams:
        v = np.zeros(langid.DIMENSIONS)
        for g, k in n.items():
            v[place(g)] += k
        vectors.append((lang, v))
        df += v > 0
    idf = np.log((1 + len(grams)) / (1 + df)) + 1
    unit = []
    for lang, v in vectors:
        w = np.where(v > 0, (1 + np.log(np.maximum(v, 1))) * idf, 0)
        unit.append((lang, w / np.linalg.norm(w), int(v.sum()).bit_length()))
    centroids, held = [], []
    for lang in sorted(share):
        own = [u for u in unit if u[0] == lang]
        x = np.array([u[1] for i, u in enumerate(own) if i % 3 != 2], np.float32)
        c = langid._clusters(x, conf.clusters, conf.rounds, conf.least_share)
        centroids += [(lang, k) for k in c]
        held += [(u[2], max(float(k @ u[1]) for k in c)) for i, u in enumerate(own) if i % 3 == 2]
    got = {r.doc_id: r for r in langid.identify(docs, conf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        v = np.zeros(langid.DIMENSIONS)
        for g, k in brute_features(r.text).items():
            v[place(g)] += k
        w = np.where(v > 0, (1 + np.log(np.maximum(v, 1))) * idf, 0)
        w /= np.linalg.norm(w)
        score, lang = max(((float(c @ w), name) for name, c in centroids), key=lambda x: x[0])
        size = int(v.sum()).bit_length()
        least = max(1, min(abs(k - size) for k, _ in held))
        limit = (conf.slack if least == 1 else 0.5) * np.quantile([c for k, c in held if abs(k - size) <= least], 0.002, method="lower")
        assert abs(got[r.doc_id].score - score) < 1e-4 and (got[r.doc_id].lang_pred == lang or abs(score - 1) < 1e-4)
        assert got[r.doc_id].rejected == (score < limit) or abs(score - limit) < 1e-4


def langid_place(gram):
    """The dimension of a gram, from its definition."""
    x = ord(gram[0])
    for i, c in enumerate(gram[1:]):
        x = x * 0x10001 + ord(c) + ((7 if i == 0 else 11) << 50)
    return (x * 0x9E3779B97F4A7C15 % 2**64) >> 50


def test_long_texts_in_pieces():
    text = "ab c\U0001d400d  é! " * 60000
    ids, counts = langid.features(text)
    want = brute_features(text)
    assert counts.sum() == sum(want.values())
    assert {i: n for i, n in zip(ids.tolist(), counts.tolist())} == {i: sum(n for g, n in want.items() if langid_place(g) == i) for i in {langid_place(g) for g in want}}


def test_every_label_is_learned(spark):
    words = ["".join(chr(97 + (i * 7 + k * k) % 26) for k in range(6)) for i in range(230)]
    rows = [(230 * j + i, f"{words[i]} {words[i]} {words[i]}", f"l{i:03}") for i in range(230) for j in range(4)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Fit(clusters=1))
    assert len(model.languages) > 220


def test_blocks_of_labels(spark, sf_dir):
    """Labels in blocks of one or two give what one block gives, also where a block has the best centroid of a later label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = []
    for n in (128, 2, 1):
        model = langid.learn(docs, langid.Fit(block_labels=n))
        assert len(model.blocks) == -(-len(model.languages) // n)
        told.append(sorted(map(tuple, langid.predict(docs, model).collect())))
    for other in told[1:]:
        for r, x in zip(told[0], other, strict=True):
            assert (r[:3], r[4]) == (x[:3], x[4]) and abs(r[3] - x[3]) < 1e-5  # sums of another shape round otherwise
    assert len({r[2] for r in told[0]}) > 3
