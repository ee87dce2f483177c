"""Raking and sampling against brute force."""

import hashlib
import re

import tracemalloc

import numpy as np
import pytest

from factloom.llm import mixing
from factloom.llm.mixing import Mix, calibrate, keep_mixed, mix_documents, rake


def brute(rows, mix):
    """rows: (doc_id, text, lang, source). Independent raking with dictionaries."""
    told = []
    for d, t, lang, source in rows:
        t = t or ""
        words, lines = len(re.findall(r"[^\x20\x09-\x0D]+", t)), t.count("\n") + 1
        topic = "dense" if words and len(t) >= words * 9 else "lines" if lines > 1 and words < lines * 12 else "prose"
        told.append((d, source or "(none)", lang or "(none)", topic, len(re.findall(r"[^\x20\x09-\x0D]+", t))))
    cells = {}
    for r in told:
        cells[r[1:4]] = cells.get(r[1:4], 0) + r[4]
    w = {k: v * mix.keep for k, v in cells.items()}
    total = sum(w.values())
    sums = [{}, {}, {}]
    for k, v in cells.items():
        for a in range(3):
            sums[a][k[a]] = sums[a].get(k[a], 0) + v
    goal = [{c: v**mix.targets[n] if v else 0 for c, v in s.items()} for n, s in zip(mixing.FACTORS, sums)]
    for _ in range(mix.rounds):
        for a in range(3):
            g = sum(goal[a].values())
            now = {}
            for k, v in w.items():
                now[k[a]] = now.get(k[a], 0) + v
            w = {k: min(cells[k], v * (goal[a][k[a]] / g * total / now[k[a]] if now[k[a]] else 0)) for k, v in w.items()}
    out = {}
    for r in told:
        p = w[r[1:4]] / cells[r[1:4]] if cells[r[1:4]] else 1.0
        u = int(hashlib.md5(f"{mix.seed}:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        out[r[0]] = (*r[1:], p, u < p)
    return out


def test_sample_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    want = brute(rows, Mix())
    got = {r.doc_id: r for r in mix_documents(docs).collect()}
    assert set(got) == set(want)
    for d, w in want.items():
        assert tuple(got[d])[1:5] == w[:4] and abs(got[d].probability - w[4]) < 1e-6 and got[d].selected == w[5]
    assert sorted(r.doc_id for r in keep_mixed(docs).collect()) == sorted(d for d, w in want.items() if w[5])


def test_marginals_meet_targets():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1000, (6, 4, 3)).astype(float)
    goals = [rng.random(6), rng.random(4), rng.random(3)]
    codes = [c.ravel() for c in np.indices(x.shape)]
    y = rake(codes, x.ravel(), goals).reshape(x.shape)
    for axis, g in enumerate(goals):
        s = y.sum(axis=tuple(k for k in range(3) if k != axis))
        assert np.allclose(s / s.sum(), g / g.sum(), atol=1e-6)
    assert (y[x == 0] == 0).all() and abs(y.sum() - x.sum()) < 1e-3


def test_many_categories_in_little_memory():
    """Cells are kept as a list: categories of all factors would make a cube of 10^14 numbers."""
    cells = [(f"s{i}", f"l{i % 40_000}", f"t{i % 50_000}", 1 + i % 9) for i in range(50_000)]
    tracemalloc.start()
    told, _ = calibrate(cells, Mix(rounds=5))
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert len(told) == 50_000 and all(0 <= c[3] <= 1 for c in told)


def test_given_shares_and_absent_categories():
    cells = [("a", "en", "prose", 900), ("b", "en", "prose", 100), ("b", "fr", "prose", 50)]
    told, left = calibrate(cells, Mix(targets={"source": {"a": 1, "b": 1, "gone": 2}, "lang": 1.0, "topic": 1.0}, keep=0.1))
    p = {c[:3]: c[3] for c in told}
    assert all(0 <= v <= 1 for v in p.values())
    a, b = p[cells[0][:3]] * 900, sum(p[c[:3]] * c[3] for c in cells[1:])
    assert abs(a - b) / b < 1e-6 and abs(a + b - 105) < 1e-6 and left < 1e-9
    assert calibrate([], Mix()) == ([], 0.0) and calibrate([("a", "x", "t", 0)], Mix())[0][0][3] == 1.0


def test_a_tiny_cell_does_not_decide():
    cells = [(f"s{i}", "en", "prose", 1e9) for i in range(3)] + [("tiny", "en", "prose", 10)]
    told, _ = calibrate(cells, Mix(targets={"source": 0.7}))
    assert {c[0]: round(c[3], 3) for c in told} == {"s0": 0.5, "s1": 0.5, "s2": 0.5, "tiny": 1.0}


def test_gap_is_told(spark):
    rows = [(i, "w " * 10, "en", "big" if i % 50 else "small") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="misses its target"):
        got = mix_documents(df, Mix(targets={"source": {"big": 1, "small": 9}})).collect()
    assert {r.probability for r in got if r.source == "small"} == {1.0}


def test_every_value_is_a_category(spark):
    rows = [(i, "w w", "en", f"s{i % 300}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix_documents(df, Mix(targets={"source": {f"s{i}": 1 + i % 2 for i in range(300)}}, keep=0.3)).collect()
    assert len({r.source for r in got}) == 300 and min(r.probability for r in got) > 0.1
    assert {round(r.probability, 3) for r in got} == {0.2, 0.4}


def test_cells_as_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = lambda mix: {r.doc_id: r.probability for r in mix_documents(docs, mix).collect()}
    targets = {"source": {"src0": 3, "src1": 1, "src2": 1, "absent": 1}, "lang": 0.7, "topic": 0.9}
    a, b = (told(Mix(targets=targets, most_gap=1, driver_cells=n, rounds=2)) for n in (1000, 0))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-5


def test_stand_in_names_do_not_merge(spark):
    rows = [(1, "a b", "en", None), (2, "a b", "en", "(none)"), (3, "a b", "en", "=(none)")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.source for r in mix_documents(df).collect()} == {1: "(none)", 2: "=(none)", 3: "==(none)"}


def test_expected_tokens(spark):
    rows = [(i, "w " * 10, "en" if i % 4 else "fr", "s0" if i % 3 else f"s{i % 5}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix_documents(df, Mix(targets={"source": 0.0, "lang": 0.0, "topic": 1.0})).where("selected").collect()
    fr = sum(r.lang == "fr" for r in got) / len(got)
    assert abs(fr - 0.5) < 0.06


def test_edges(spark):
    rows = [(1, None, None, None, 1.0), (1, None, None, None, 1.0), (None, "one two", "en", "a", 2.0), (3, "", "en", "a", 0.0), (4, "x " * 50000, "en", "b", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability double")
    got = mix_documents(df).collect()
    assert len(got) == 5 and {(r.source, r.n_tokens, r.selected) for r in got if r.doc_id == 1} == {("(none)", 0, True)}
    assert keep_mixed(df).columns == df.columns
    assert mix_documents(df.limit(0)).collect() == [] and keep_mixed(df.limit(0)).collect() == []


def test_clashing_names_and_long_texts(spark):
    """Columns named like every helper keep their own values, with few cells and with cells as a table."""
    names = ["__draw", "__probability", "__cell", "__rows", "__n", "rows", "tokens", "cell", "n"]
    rows = [(i, "wort " * (300_000 if i == 7 else 9), "de", f"s{i % 3}", *[f"{c}{i}" for c in names]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))
    for mix in (Mix(keep=0.9), Mix(keep=0.9, driver_cells=0, rounds=2)):
        got = keep_mixed(df, mix)
        assert got.columns == df.columns
        kept = got.collect()
        assert kept and all(r[c] == f"{c}{r.doc_id}" for r in kept for c in names)
        assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in mix_documents(df, mix).collect() if r.selected)
