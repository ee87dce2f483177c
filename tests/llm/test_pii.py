"""Surrogates: detection, type and format, distinctness, coreference, and untouched clean texts."""

import ipaddress
import re

from pyspark.sql import functions as F

from factloom.llm import pii
from factloom.llm.pii import Surrogates, collisions, detect, entities, permute, pseudonymise, pseudonymised_documents, replace

KEY = b"test key"
CONF = Surrogates(key=KEY)


def kinds(text):
    return [(text[a:b], k) for a, b, k, _, _ in detect(text)]


def test_detection():
    t = "und.34@mail7.example.com +1 (017) 555-7713, 97.51.17.173 4845168114407329 123-45-6789; +44 20 7946 0958 DE89 3704 0044 0532 0130 00"
    assert kinds(t) == [
        ("und.34@mail7.example.com", "email"), ("+1 (017) 555-7713", "phone"), ("97.51.17.173", "ipv4"), ("4845168114407329", "card"),
        ("123-45-6789", "ssn"), ("+44 20 7946 0958", "phone"), ("DE89 3704 0044 0532 0130 00", "iban"),
    ]
    for clean in ["7086638319846192", "2020-01-02 1.2.3 999.1.1.1", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "a@b @home x@", "The mr and the Herring", "0000000000000000", "v1.2.3.4.5"]:
        assert kinds(clean) == [], clean


def test_people_gender_script_and_coreference():
    t = "Mr Smith and Mrs. Anna Smith met John Smith. SMITH? Smith left; г-жа Иванова, my name is Peter Müller"
    new, n = replace(t, CONF, {})
    assert "Smith" not in new and "Anna" not in new and "Müller" not in new and "Иванова" not in new
    surname = re.search(r"Mr (\w+) and Mrs\. (\w+) (\w+) met (\w+) (\w+)\. ([A-Z]+)\? (\w+) left; г-жа ([А-я]+), my name is (\w+) (\w+)$", new).groups()
    assert surname[0] == surname[2] == surname[4] == surname[6] and surname[5] == surname[0].upper()
    assert surname[1].endswith(("na", "lia", "ra", "tine")) and surname[3].endswith(("ton", "rick", "las", "ner"))


def test_types_and_formats_stay():
    for shown, kind in kinds("Und.34@Mail7.example.com +1 (017) 555-7713 97.51.17.173 4845-1681-1440-7329 123-45-6789 GB82 WEST 1234 5698 7654 32"):
        new, n = replace(shown, CONF, {})
        assert n == 1 and new != shown
        assert kinds(new) == [(new, kind)]
        if kind != "ipv4":
            shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))
            assert shape(new) == shape(shown)
        assert replace(shown, CONF, {})[0] == new != replace(shown, Surrogates(key=b"other"), {})[0]


def test_permutation():
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(permute(i, size, KEY, "x") for i in range(size)) == list(range(size))


def test_clean_texts_are_untouched(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pseudonymised_documents(docs).join(docs.select("doc_id", F.col("text").alias("before")), "doc_id").collect()
    assert len(rows) == 200
    for r in rows:
        found = detect(r.before)
        assert r.n_entities == len(found) and (r.text == r.before) == (not found)
        for a, b, *_ in found:
            assert r.before[a:b] not in r.text


def test_collisions_are_redrawn(spark):
    names = [(f"Mr {a}{b}{c}",) for a in "BCDFGHKLMNPRSTVW" for b in ("al", "er", "in", "ok", "ud", "am", "yl", "ev") for c in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame([(i, f"Hello {n[0]}.") for i, n in enumerate(names)], "doc_id long, text string").repartition(4)
    found = entities(df)
    assert collisions(found.cache(), Surrogates()).count() > 0  # 3328 names in a space of 12800
    new = [r.text for r in pseudonymise(df).collect()]
    assert len(set(new)) == len(names) and not set(new) & {f"Hello {n[0]}." for n in names}
    joined = [r.text for r in pseudonymise(df, Surrogates(most_exceptions=0)).collect()]
    assert sorted(joined) == sorted(new)


def test_surrogate_that_is_a_real_entity(spark):
    first = pii.surrogate("ipv4", "10.20.30.40", "", Surrogates().key)
    df = spark.createDataFrame([(1, "at 10.20.30.40"), (2, f"at {first}")], "doc_id long, text string")
    new = {r.doc_id: r.text for r in pseudonymise(df).collect()}
    assert first not in new[1] and new[1] != new[2]


def test_odd_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "mail a.b@c.org " * 20000, None), (3, "漢字 😀", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, changed string")
    out = pseudonymise(df).collect()
    assert len(out) == 5 and {r.n_entities for r in out} == {0, 20000} and "a.b@c.org" not in "".join(r.text or "" for r in out)
    assert pseudonymised_documents(df.limit(0)).collect() == []


def run(spark, texts, **conf):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonymise(df, Surrogates(**conf)).orderBy("doc_id").collect()]


def test_one_person_whatever_the_context(spark):
    new = run(spark, ["Mr Alex Smith wrote. My name is Alex Smith.", "Mary Smith came. Mary said hello.", "MR JOHN SMITH and Sarah O’Neil, then Sarah O'Neil.", "Priya Patel, κυρία Ελένη Παππά; 王伟先生来了,王伟走了,王女士。", "call +1 (017) 555-7713 or 017-555-7713"])
    a, b = re.fullmatch(r"Mr (\w+ \w+) wrote\. My name is (\w+ \w+)\.", new[0]).groups()
    assert a == b and "Alex" not in new[0] and a.split()[0].endswith(("ton", "rick", "las", "ner"))
    first, second = re.fullmatch(r"(\w+) \w+ came\. (\w+) said hello\.", new[1]).groups()
    assert first == second != "Mary" and new[1].split()[1] == a.split()[1]
    x = re.fullmatch(r"MR ([A-Z]+) ([A-Z]+) and (\w+ \w+), then (\w+ \w+)\.", new[2]).groups()
    assert x[1] == a.split()[1].upper() and x[2] == x[3] and "Neil" not in new[2]
    assert not re.search("Priya|Patel|Ελένη|Παππά|王伟", new[3]) and re.search("[α-ω]", new[3])
    han = re.search(r"; (.)(.)先生来了,(.)(.)走了,(.)女士", new[3]).groups()
    assert han[0] == han[2] == han[4] and han[1] == han[3]
    p, q = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", new[4]).group(1, 2), new[4][-12:]
    assert f"{p[0]}-{p[1]}" == q != "017-555-7713"


def test_usual_phone_forms():
    for t in ("+33 6 12 34 56 78", "06 12 34 56 78", "030 12345678", "0171 2345678", "(555)123-4567", "+442079460958"):
        assert kinds(f"at {t}.") == [(t, "phone")], t
        assert kinds(replace(t, CONF, {})[0])[0][1] == "phone"
    assert kinds("call 5551234567 now") == [("5551234567", "phone")]
    for clean in ("2024-01-02 10 20 30", "1700000000", "0.12 34 56", "12 34 56 78 90", "page 030 of 12345678901"):
        assert kinds(clean) == [], clean


def test_given_names_are_a_parameter(spark):
    assert run(spark, ["then Zorblax Quux spoke"]) == ["then Zorblax Quux spoke"]
    assert "Zorblax" not in run(spark, ["then Zorblax Quux spoke"], names=(("Zorblax", "f"),))[0]


def test_whole_query_by_brute_force(spark, sf_dir):
    """Votes, draws and redraws over all texts in plain Python."""
    conf = Surrogates()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10_000 + i, f"{t} {g} {x}{y}.") for i, (t, g, x, y) in enumerate((t, g, x, y) for t in ("Mr", "Ms", "Dr") for g in ("Alex", "Kim") for x in ("Bal", "Ker", "Lin", "Mok", "Nud") for y in "abcdefghijklmnopqrstuvwxyz")]
    votes = {}
    for _, t in rows:
        for *_, kind, canonical, gender in detect(t or ""):
            votes.setdefault((kind, canonical), {"f": 0, "m": 0, "n": 0})[gender] += 1
    listed = {n.lower(): g for g, names in pii.GIVEN.items() for n in names}
    gender = {e: "f" if v["f"] > v["m"] else "m" if v["m"] > v["f"] else listed.get(e[1], "n") if e[0] == "given" else "n" for e, v in votes.items()}
    attempt = dict.fromkeys(gender, 0)
    real = {c.lower() for _, c in gender}
    while True:
        drawn = {}
        for e, k in attempt.items():
            drawn.setdefault(pii.surrogate(*e, gender[e], conf.key, k).lower(), []).append((k, e[1], e[0]))
        again = [(x[2], x[1]) for new, own in drawn.items() for i, x in enumerate(sorted(own)) if i or new in real]
        if not again:
            break
        for e in again:
            attempt[e] += 1
    want = {}
    for d, t in rows:
        out, at = [], 0
        for a, b, kind, canonical, _ in detect(t or ""):
            new = pii.surrogate(kind, canonical, gender[kind, canonical], conf.key, attempt[kind, canonical])
            out += [t[at:a], pii.formatted(t[a:b], kind, new)]
            at = b
        want[d] = None if t is None else "".join(out) + t[at:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in pseudonymised_documents(df).collect()} == want
    assert max(attempt.values()) > 0


def test_ordinary_words_are_no_people():
    for clean in (
        "Contact: The office is closed. The house is big.", "Name:\nAddress of the firm. Address again.", "Customer: Open Ticket. Please Open the door.",
        "at 12:30:45 and a::b", "pages 555-7713",
    ):
        assert detect(clean) == [], clean


def test_more_cues():
    assert kinds("Dear John") == [("John", "given")] and kinds("I met Priya yesterday") == [("Priya", "given")]
    assert kinds("Mr Smith came. SMITH said") == [("Smith", "surname"), ("SMITH", "surname")]
    assert kinds("call 555-7713 now") == [("555-7713", "phone")]
    assert kinds("Sincerely,\nOda Holm\n") == [("Oda", "given"), ("Holm", "surname")] == kinds("Contact: x\nName: Oda Holm")[:2]
    t = "at 2001:DB8::FF00:42:8329 and 2001:0db8:0000:0000:0000:ff00:0042:8329 or fe80::1"
    new, n = replace(t, CONF, {})
    a, b, c = re.fullmatch(r"at (\S+) and (\S+) or (\S+)", new).groups()
    assert n == 3 and [k for _, k in kinds(new)] == ["ipv6"] * 3
    assert ipaddress.ip_address(a) == ipaddress.ip_address(b) != ipaddress.ip_address(c) and a.isupper() and len(b) == 39


def test_common_words_of_the_corpus(spark):
    """A label's word is a name only while fewer documents have it as an ordinary word; a title makes it one in any case."""
    rows = ["Name: Open", "Name: Will Graham", "the door was open", "open it", "Name: Oda", "Mr Open came"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").repartition(3)
    for conf in (Surrogates(), Surrogates(most_exceptions=0)):
        assert pii.common_words(df, conf) == {"open"}
        new = {r.doc_id: r.text for r in pseudonymise(df, conf).collect()}
        assert [new[0], new[2], new[3]] == [rows[0], rows[2], rows[3]]
        assert "Will" not in new[1] and "Graham" not in new[1] and "Oda" not in new[4] and "Open" not in new[5]


def test_a_shape_that_is_used_up(spark):
    """All 676 addresses of a shape: none of them is free as a surrogate."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([(i, f"{a}@{b}.io") for i, (a, b) in enumerate((a, b) for a in letters for b in letters)], "doc_id int, text string").repartition(3)
    new = [r.text for r in pseudonymise(df).collect()]
    assert len(set(new)) == 676 and not set(new) & {r.text for r in df.collect()}


def test_helper_names_on_the_joined_path(spark):
    rows = [(i, f"mail a{i}.b@c.org", f"O{i}", f"S{i}", f"N{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string, __own string, __sha string, __n string")
    got = pseudonymise(df, Surrogates(most_exceptions=0))
    assert got.columns == [*df.columns, "n_entities"]
    assert all((r["__own"], r["__sha"], r["__n"]) == (f"O{r.doc_id}", f"S{r.doc_id}", f"N{r.doc_id}") and r.text != rows[r.doc_id][1] for r in got.collect())
