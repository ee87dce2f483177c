"""Two sentence splitters over the rule tokenizer: `fast`, for building documents, and `full`, for recall hypotheses.

Both cut after sentence punctuation and at wide white space, and glue back what can't end a sentence. A blank text has no
sentences. Sentences cover the text from its first token on, white space included.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.nlp.tokenizer import DEFAULT, Lexicon, cut_long_word, cut_word, tokenize

# What ends a sentence, and what never does. The latter match the end of a text without a word boundary
# and without regard to case.
ENDS = frozenset(".!?")
NEVER_LAST = (",", "-", "(", "=", "/", "mrs.", "mr.", "ms.", "i.e.", ":", "dr.", "at", "with", "and", "the", "is", "s/p")
_NEVER_LAST = re.compile("(" + "|".join(map(re.escape, NEVER_LAST)) + ")$", re.I)
_REACH = max(map(len, NEVER_LAST)) + 1  # and one line end, which `$` leaves out
BULLET = re.compile("[•¿](?![CF])")
_END = re.compile("[" + re.escape("".join(sorted(ENDS))) + "]")
_WORD, _SPACE = re.compile(r"\S+"), re.compile(r"\s*")
_BLANK = re.compile(r"\s\s+|[^\S\x20]|\A\x20")
_PIECE = 1 << 18

Span = tuple[int, int]


class Note:
    def __init__(self, text: str, lexicon: Lexicon = DEFAULT):
        self.text = text
        self.tokens = tokenize(text, lexicon)

    def __len__(self) -> int:
        return len(self.tokens)

    def shown(self, a: int, b: int) -> str:
        """Text of tokens a to b, without the space that may follow."""
        t, at = self.tokens[b - 1]
        return self.text[self.tokens[a][1] : at + len(t)]


def _punctuation(s: str) -> bool:
    return all(unicodedata.category(c)[0] == "P" for c in s)


def at_phrase(note: Note, spans: list[Span], pattern: re.Pattern, least: int = 250) -> list[Span]:
    """Cut before the token at which a match of a phrase starts."""
    out: list[Span] = []
    for a, b in spans:
        shown, base = note.shown(a, b), note.tokens[a][1]
        starts = {m.start() + base for m in pattern.finditer(shown)} if len(shown) >= least else set()
        cuts = [a, *(i for i in range(a + 1, b) if note.tokens[i][1] in starts), b]
        out += list(zip(cuts, cuts[1:]))
    return out


class Scan:
    """A text whose tokens are only looked at where a sentence may end. Spans are offsets of tokens, the second one of the token behind."""

    def __init__(self, text: str, lexicon: Lexicon = DEFAULT):
        self.text, self.lexicon, self.held = text, lexicon, ("", ())
        # Tokens of white space, as (offset, length): less the one space behind a word.
        self.wide = [(at, m.end() - at) for m in _BLANK.finditer(text) for at in [m.start() + (m.start() > 0 and m[0][0] == " ")]]

    def cut(self, word: str) -> tuple[str, ...]:
        if len(word) > 2 and word[-1] in ".?" and word[:-1].isalpha() and word not in self.lexicon.terms:
            return word[:-1], word[-1]  # what the rules come to, as no other one is about letters alone
        if len(word) < 64:
            return cut_word(word, self.lexicon)
        if self.held[0] != word:
            self.held = word, cut_long_word(word, self.lexicon)
        return self.held[1]

    def end(self, b: int) -> int:
        """Where the token before offset b ends: one space between them belongs to neither."""
        return b - 1 if b > 1 and self.text[b - 1] == " " and not self.text[b - 2].isspace() else b

    def begin(self, p: int, least: int = 0) -> int:
        """Where the word around offset p begins, not before offset `least`."""
        reach = 32
        while True:
            low = max(least, p - reach)
            piece = self.text[low:p]
            parts = piece.split()
            if piece[-1:].isspace() or not parts:
                return p
            if len(parts) > 1 or piece[0].isspace() or low == least:
                return p - len(parts[-1])
            reach *= 4

    def token(self, p: int) -> tuple[int, int]:
        """The token that holds offset p, which is no white space."""
        at = self.begin(p)
        for t in self.cut(_WORD.match(self.text, at)[0]):
            if p < at + len(t):
                return at, at + len(t)
            at += len(t)
        raise AssertionError("tokens cover their word")

    def at_punctuation(self) -> list[Span]:
        """A sentence ends before the first token after an end mark that isn't punctuation."""
        text, n, cuts, done = self.text, len(self.text), [0], 0
        while m := _END.search(text, done):
            start, ended = self.begin(m.start(), done), False
            while True:
                word = _WORD.match(text, start)[0]
                at = start
                for t in self.cut(word):
                    if ended and not _punctuation(t):
                        cuts.append(at)
                        ended = False
                    elif t in ENDS:
                        ended = True
                    at += len(t)
                done = at
                if not ended or at == n:
                    break
                start = at + 1
                if text[at] != " " or text[start : start + 1].isspace():  # white space that is a token
                    cuts.append(at + (text[at] == " "))
                    break
                if start == n:
                    break
                if unicodedata.category(text[start])[0] != "P":
                    cuts.append(start)
                    break
        cuts.append(n)
        return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    def marked(self, pattern: re.Pattern) -> list[int]:
        """Offsets of the tokens in which a pattern of one character and what follows it occurs."""
        found, done = [], 0
        while m := pattern.search(self.text, done):
            at = self.begin(m.start(), done)
            for t in self.cut(_WORD.match(self.text, at)[0]):
                if pattern.search(t):
                    found.append(at)
                at += len(t)
            done = at
        return found

    def split(self, spans: list[Span], places: list[int], least: int, colons: int = -1) -> list[Span]:
        """Cut spans of at least `least` characters, and over `colons` colons, at each of the places inside."""
        if not places:
            return spans
        out: list[Span] = []
        k = 0
        for a, b in spans:
            while k < len(places) and places[k] <= a:
                k += 1
            first = k
            while k < len(places) and places[k] < b:
                k += 1
            if k == first or (end := self.end(b)) - a < least or colons >= 0 and self.text.count(":", a, end) <= colons:
                out.append((a, b))
            else:
                cuts = [a, *places[first:k], b]
                out += zip(cuts, cuts[1:])
        return out

    def glue(self, spans: list[Span], pairs: frozenset[str] = frozenset()) -> list[Span]:
        """Join a span to the one before if that can't end a sentence, or if the two words at the seam belong together."""
        text, starts, last = self.text, [], 0  # last: where the last token that isn't white space ends
        for a, b in spans:
            if text[a].isspace():
                a = _SPACE.match(text, a).end()
            if a >= b:
                continue
            if starts:
                end = self.end(a)
                joined = _NEVER_LAST.search(text[max(starts[-1], end - _REACH) : end])
                if not joined and end > last and text.endswith(NEVER_LAST, starts[-1], last):
                    joined = text[slice(*self.token(last - 1))] in NEVER_LAST
                if not joined and pairs:
                    joined = re.sub(r"\s{2,}|\n", " ", text[self.token(last - 1)[0] : self.token(a)[1]]).lower().strip() in pairs
                if not joined:
                    starts.append(a)
            else:
                starts.append(a)
            last = self.end(b)
            while text[last - 1].isspace():
                last -= 1
        if not starts:
            return []
        starts[0] = 0
        return list(zip(starts, [*starts[1:], len(text)]))


def fast(scan: Scan, pairs: frozenset[str] = frozenset()) -> list[Span]:
    return scan.glue(scan.split(scan.at_punctuation(), [a for a, n in scan.wide if n > 2], 1), pairs)


def full(scan: Scan, pairs: frozenset[str] = frozenset()) -> list[Span]:
    spans = scan.split(scan.at_punctuation(), [a for a, n in scan.wide if n > 1], 250)
    spans = scan.split(spans, [a for a, _ in scan.wide], 100, 2)
    spans = scan.split(spans, scan.marked(BULLET), 10)
    return scan.glue(scan.split(spans, [a for a, n in scan.wide if n > 2], 0), pairs)


SPLITTERS = {"fast": fast, "full": full}


def sentences(text: str | None, rules: str = "fast", lexicon: Lexicon = DEFAULT, pairs: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, text) of each sentence, in characters."""
    if not text or text.isspace():
        return []
    scan = Scan(text, lexicon)
    return [(a, end, text[a:end]) for a, b in SPLITTERS[rules](scan, pairs) for end in [scan.end(b)]]


def in_pieces(batches: Iterable[pa.RecordBatch], text: str, rules: str, lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """The rows with `sentences`, in pieces of about `_PIECE` characters or one longer text: the sentences of a whole Arrow batch would be large."""

    def told(rows: pa.RecordBatch, found: list[list[tuple[int, int, str]]]) -> pa.RecordBatch:
        flat = [s for one in found for s in one]
        columns = [pa.array([i for one in found for i in range(len(one))], pa.int32()), *(pa.array([s[k] for s in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string())))]
        ends = pa.array(accumulate(map(len, found), initial=0), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["i", "start", "stop", "text"]))
        return pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, "sentences"])

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        first, size, found = 0, 0, []
        for k in range(batch.num_rows):
            t = texts[k].as_py()
            found.append(sentences(t, rules, lexicon))
            size += len(t or "") + 64
            if size >= _PIECE or k + 1 == batch.num_rows:
                yield told(batch.slice(first, len(found)), found)
                first, size, found = k + 1, 0, []


def annotate(docs: DataFrame, text: str, rules: str = "fast", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """`docs` with `sentences`: array<struct<i, start, stop, text>>; other columns travel along."""
    if rules not in SPLITTERS:
        raise ValueError(f"rules are one of {sorted(SPLITTERS)}")
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema)
    return docs.mapInArrow(lambda batches: in_pieces(batches, text, rules, lexicon), f"{schema}, sentences array<struct<i:int,start:int,stop:int,text:string>>")


def register(spark) -> None:
    """SQL: note_sentences_fast(text) and note_sentences_full(text), arrays of strings."""
    from pyspark.sql.functions import pandas_udf

    def splitter(rules: str):
        def split(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [s for _, _, s in sentences(t, rules)])

        return pandas_udf(split, "array<string>")

    for rules in SPLITTERS:
        spark.udf.register(f"note_sentences_{rules}", splitter(rules))
