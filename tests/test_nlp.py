"""Tokenizer and splitters: goldens that follow from the rules, and invariants."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.nlp.sentences import Note, annotate, at_phrase, sentences
from factloom.nlp.tokenizer import DEFAULT, Lexicon, cut_word, tokenize


TERMS = Lexicon(frozenset({"Dr."}))


def words(text, lexicon=DEFAULT):
    return [t for t, _ in tokenize(text, lexicon)]


def test_tokens():
    assert words("Seen by Dr. Smith.", TERMS) == ["Seen", "by", "Dr.", "Smith", "."]
    assert words("Seen by Dr. Smith.") == ["Seen", "by", "Dr", ".", "Smith", "."]  # no list of terms in the code
    assert words("b.i.d. w/ 136.9BJ 1.0mm") == ["b.i.d.", "w/", "136.9BJ", "1.0mm"]
    assert words("a  b\n\nc") == ["a", " ", "b", "\n\n", "c"]
    assert words("(fever),") == ["(", "fever", ")", ","]
    assert words("11/12/2001 01:09:00.0") == ["11/12/2001", "01:09:00.0"]
    assert words("left-sided") == ["left", "-", "sided"]
    assert cut_word("q.h.s.x", Lexicon(frozenset({"q.h.s.x"}))) == ("q.h.s.x",)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.,:;()/-% \n\t'\"+é•", max_size=60))
def test_tokens_cover_the_text(text):
    tokens, at = tokenize(text), 0
    for t, start in tokens:
        assert text[start : start + len(t)] == t and text[at:start] in ("", " ")
        at = start + len(t)
    assert text[at:] in ("", " ")
    for rules in ("fast", "full"):
        found = sentences(text, rules)
        assert "".join("".join(s for _, _, s in found).split()) == "".join(text.split())
        assert all(a < b and text[a:b] == s for a, b, s in found)


def split(text, rules="fast"):
    return [s.strip() for _, _, s in sentences(text, rules)]


def test_sentences():
    assert split("He is well. She left.") == ["He is well.", "She left."]
    assert split('He said "no." Then left.') == ['He said "no."', "Then left."]
    assert split("Plan:   rest") == ["Plan:   rest"] and split("Stable    Rest now") == ["Stable", "Rest now"]
    assert split("Final diagnosis.   None") == ["Final diagnosis.", "None"]
    assert split("the diagnosis\n\n\nflu") == ["the diagnosis", "flu"]  # `is` is glued before one line end at most
    assert split("the diagnosis \n\n flu") == ["the diagnosis", "flu"] and split("seen at\n flu") == ["seen at\n flu"]
    assert split("   \n ") == [] and split("") == [] and sentences(None) == []
    bullets = "given today • one thing • two things"
    assert split(bullets, "full") == ["given today", "• one thing", "• two things"] and split(bullets) == [bullets]


def test_phrases():
    import re

    note = Note("Assessment and Plan the patient is well Assessment and Plan again")
    assert len(at_phrase(note, [(0, len(note))], re.compile("Assessment and Plan"), 10)) == 2


def test_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, " ")], "id int, note_text string")
    got = {r.id: [s.text for s in r.sentences] for r in annotate(df, "note_text", "full").collect()}
    assert got[2] == got[3] == [] and len(got[1]) >= 1
    with pytest.raises(ValueError):
        annotate(df, "note_text", "other")


@pytest.mark.parametrize("rules", ["fast", "full"])
def test_queries_row_by_row(spark, sf_dir, rules):
    """Every sentence of the whole table, against the splitter called text by text; and the spans of a text are in order and cover it."""
    from factloom.plans import all_queries

    got = {}
    for r in all_queries()[f"sentences_{rules}"](spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r.i, r.sent_start, r.sent_stop, r.sentence))
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        want = sentences(text, rules)
        assert sorted(got.get(doc_id, [])) == [(i, a, b, s) for i, (a, b, s) in enumerate(want)]
        assert all(text[a:b] == s for a, b, s in want) and "".join("".join(s for _, _, s in want).split()) == "".join((text or "").split())
