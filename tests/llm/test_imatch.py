"""I-Match fingerprints against their SQL and against single parts in Python."""

import hashlib

import duckdb
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from factloom.llm import imatch
from factloom.llm.imatch import Lexicon, fingerprint_documents


def terms(text, seed=7):
    words = {w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}
    return sorted({int(hashlib.md5(f"{seed}:{w}".encode()).hexdigest()[:15], 16) for w in words})


def brute(own, lex, text=""):
    """A fingerprint's text, of the terms that count."""
    tell = lambda part: hashlib.md5(",".join(map(str, part)).encode()).hexdigest()[:16] if part else ""
    if not own:
        return "-1:" + hashlib.md5(text.encode()).hexdigest()[:16]
    level = 3
    while 2**level < len(own):
        level += 1
    hashes = [tell([h for h in own if h >> 2 * j & 3]) for j in range(lex.dense)]
    for m in (2 ** (level + 1), 2 ** (level + 2)):
        hashes += [tell([h for h in own if (h >> 16) % m == j or (h >> 38) % m == j]) for j in range(16)]
    return f"{level}:" + ".".join(hashes)


def by_sql(rows, lex):
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return sorted(db.sql(f"SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next FROM ({imatch.oracle(lex)})").fetchall(), key=str)


def run(spark, rows, lex=None, split=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(split)
    got = [tuple(r) for r in fingerprint_documents(df, lex).collect()]
    assert sorted(got, key=str) == by_sql(rows, lex or Lexicon())
    return got


def test_one_text_by_brute_force(spark):
    lex = Lexicon(rarest=0.0, commonest=1.0)
    words = " ".join(f"w{i * i % 911}" for i in range(600))
    rows = [(1, words), (2, words + " and a few more, é"), (3, "Rare One"), (4, None), (5, "!!!")]
    got = {r.doc_id: r.fingerprint for r in fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), lex).collect()}
    lexicon = set(terms(words))  # each occurs in two documents; the Bloom filter has nothing else to pass for documents 1 and 3
    assert got[1] == brute(sorted(lexicon), lex)
    assert got[3] == brute(terms("Rare One"), lex)
    assert got[4] == brute([], lex) and got[5] == brute([], lex, "!!!")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (7, "Alpha beta\ngamma"), (7, "Alpha beta\ngamma"), (-3, "beta gamma é😀 " * 3), (None, "alpha"), (9, "alpha beta " * 20000), (10, "x")]
    run(spark, rows, Lexicon(rarest=0.0, commonest=1.0))
    run(spark, [(5, "one single document here")])
    assert fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    clash = spark.createDataFrame([(1, "a b", "x", 2), (2, "b c", "y", 3)], "doc_id long, text string, fp string, k int")
    assert len(fingerprint_documents(clash).collect()) == 2


def test_half_of_the_ids_null(spark):
    rows = [(i if i % 2 else None, f"{i:04d} text of {i % 7} and {i % 11}") for i in range(400)]
    run(spark, rows, Lexicon(rarest=0.0, commonest=1.0))


def test_lexicon_is_bounded(spark):
    docs = spark.createDataFrame([(f"t{i % 40} u{i % 60} v{i % 80}",) for i in range(2000)], "text string")
    wide = Lexicon(rarest=0.0, commonest=1.0, most_terms=100)
    assert 0 < imatch.lexicon(docs, wide).count() <= 100


def test_likeness(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = fingerprint_documents(docs).join(docs, "doc_id").select("text", "fingerprint", "near_edited", "near_next").collect()
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert sum(r.near_edited for r in got) / len(got) > 0.5
    assert sum(r.near_next for r in got) / len(got) < 0.1
    strangers = spark.createDataFrame([(i, t) for i, t in enumerate(["zq", "xw vk", "jj kk ll", "mm", "", "?"])], "doc_id long, text string")
    assert max(r.near_next for r in fingerprint_documents(strangers).collect()) < 0.1


def test_native(spark, sf_dir):
    plan = fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_parts_are_computed_once(spark):
    """The level, and each subset's terms, stand once in the expression: what stands in a lambda again is computed at each of its turns."""
    lex = Lexicon()
    told = str(imatch.fingerprint(F.col("t"), F.col("b"), 1024, lex))
    assert [told.count(x) for x in ("bin(", "shiftleft(")] == [1, 1]
    assert told.count("filter(") == lex.dense + 5  # words, known terms, drawn ones, and the sparse subsets at two levels
