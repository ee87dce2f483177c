"""The audit against its SQL over odd rows, and against a plain sum."""

from collections import Counter

import duckdb
import pytest

from factloom.llm import divergence as dv

ROWS = [
    ("en", "a", "The cat and the dog. The CAT!"), ("en", "a", "the cat sat"), ("en", "b", "the dog, the bird"), ("en", "b", None),
    ("en", "c", "the cat naïve über naïve"), ("en", None, "the naïve cat"), ("en", "", "naïve 123 the"), ("en", "d", "123 !?"),
    (None, "a", "x y z"), (None, "a", "x y"), ("", "b", "x"), ("de", "only", "ein wort"), ("fr", "p", "un"), ("fr", "q", ""),
    *[("en", "hot", "the the cat bird")] * 9,
]
COLS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least=3, top=200):
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c > "\x7f" or "a" <= c <= "z" else " " for c in t).split(" ")
    out = []
    for lang in {r[0] for r in rows}:
        df, whole, own = Counter(), Counter(), {}
        for la, source, text in rows:
            if la == lang:
                terms = [w for w in words(text) if w]
                df.update(set(terms))
                whole.update(terms)
                own.setdefault(source, Counter()).update(terms)
        kept = sorted(t for t in df if df[t] >= least)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in own.items()}, p(whole)
        rank = lambda found: [(i, v, k) for k, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)]
        for s in own:
            pairs = [(t, sum((shares[s][x] - shares[t][x]) ** 2 // shares[t][x] for x in kept)) for t in own if t != s]
            terms = [(x, (shares[s][x] - q[x]) ** 2 // q[x]) for x in kept if own[s][x] and shares[s][x] > q[x]]
            out += [(lang, s, "pair", *r) for r in rank(pairs)] + [(lang, s, "term", *r) for r in rank(terms)[:top]]
    return sorted(out)


def got(frame):
    return sorted(tuple(r[c] for c in COLS) for r in frame.collect())


@pytest.mark.parametrize("audit", [dv.Audit(), dv.Audit(least_documents=1, top_terms=3), dv.Audit(broadcast_groups=0), dv.Audit(least_documents=100)])
def test_against_brute_force_and_sql(spark, audit):
    docs = spark.createDataFrame(ROWS, "lang string, source string, text string").repartition(7)
    want = brute(ROWS, audit.least_documents, audit.top_terms)
    assert got(dv.divergence(docs, audit)) == want
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", ROWS)
    assert sorted(db.sql(f"SELECT {', '.join(COLS)} FROM ({dv.oracle(audit)})").fetchall()) == want


def test_full_tasks_write_out(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "lang string, source string, text string").coalesce(1)
    want = brute(ROWS)
    monkeypatch.setattr(dv, "_HELD", 2)
    assert got(dv.divergence(docs)) == want


def test_empty_clashing_and_long(spark):
    schema = "lang string, source string, text string, term string, n long, p0 long, rank string"
    long = "wort " * 200_000 + "ende"
    rows = [("de", s, long, "t", 1, 2, "r") for s in "abc"]
    found = got(dv.divergence(spark.createDataFrame(rows, schema)))
    assert found == brute([r[:3] for r in rows])
    assert dv.divergence(spark.createDataFrame([], schema)).collect() == []
