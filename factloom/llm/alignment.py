"""Alignment of two tokenizers over the same bytes, and which of their ids belong together over a corpus.

A and B encode each text (a space and the text); both cover the same bytes. Where a token of A and a token of B end at the same byte, a group ends.
A token of A and a token of B in one group are linked. The method is an event sweep:

1. encoding: every text gives A's and B's end events, packed as runs of ids (a token's length is known from its id, so a run and the byte where it begins are its
   events). Runs have at most `run_tokens` tokens and a number for their document, drawn in the task that reads it;
2. the runs of A and B are united, repartitioned by document and sorted by document and offset;
3. sweep: a state machine takes a partition's runs in turn. It holds the tokens behind the last common end and at most a run of each side beyond it, whatever
   the size of a document or partition, and emits groups (their text goes to a running digest) and the distinct links of what it has passed;
4. counting: in how many documents is a pair of ids linked? Tasks count their documents' distinct pairs in a bounded table; counts meet by pair. Only
   documents that are longer than one sweep have their pairs made distinct by a shuffle;
5. scoring: each document's links are looked up. Up to `broadcast_pairs` of the most frequent pairs are broadcast, the rest is joined by a shuffle.

Pairs are bounded by the product of the vocabularies, so no table here grows with the corpus beyond that. Texts are encoded by parts that end before single spaces
between other characters, where no token of either kind reaches over; a bounded cache keeps the parts' ids. A text that B can't give back byte by byte (one
with U+2581, say) has no tokens.

A's file is a byte-level BPE. Where its ids are in the order of its merges, ids are taken by rank, which gives the same and is quicker; else by the file's own library.

Defined results: null or empty texts have zero counts and an empty digest, as have those without tokens. A null doc_id stays null, repeated rows are documents of their
own. Very long texts are encoded whole and swept in runs; in a group with very many tokens on both sides, pairs are made in slices from the distinct ids. Ties for an id's
most frequent pair all count as best. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text without these can be cut at every space. Python's white space is all of Unicode's and four separators more.
_CROWDED = re.compile(r"\s | $")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_KEPT = 500_000  # parts in each of the cache's two generations
_MANY = 1 << 20  # pairs of one group that are made at once


@dataclass(frozen=True)
class Alignment:
    a: str = BYTE_BPE
    b: str = PIECES
    run_tokens: int = 1 << 16
    sweep_tokens: int = 1 << 17  # tokens of a side that are swept at once
    counted_pairs: int = 1 << 22
    broadcast_pairs: int = 1 << 19


class Sides(dict):
    """Both tokenizers. The dictionary keeps parts' ids, as two byte strings; None if B's bytes aren't the part's."""

    def __init__(self, conf: Alignment):
        super().__init__()
        import sentencepiece
        import tiktoken

        model = json.load(open(conf.a, encoding="utf-8"))
        vocab = model["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
        spelled = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
        plain = model["normalizer"] is None and model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and all(vocab.get(m.replace(" ", "", 1)) == 256 + n for n, m in enumerate(merges)):
            self.encode_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=spelled, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(conf.a)
            whole.encode_special_tokens = True
            self.encode_a = lambda text: whole.encode(text, add_special_tokens=False).ids
        self.a = [b""] * (max(spelled.values()) + 1)
        for token, i in spelled.items():
            self.a[i] = token
        pieces = sentencepiece.SentencePieceProcessor(model_file=conf.b)
        self.b = []
        for i in range(pieces.get_piece_size()):
            piece = pieces.id_to_piece(i)
            self.b.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else b"" if pieces.is_control(i) or pieces.is_unknown(i) else piece.replace(SPACE, " ").encode())
        if any(SPACE in pieces.id_to_piece(i).lstrip(SPACE) for i in range(len(self.b)) if not pieces.is_control(i)):
            raise ValueError("a piece of B reaches over a space between other characters")
        self.encode_b = lambda text: pieces.encode(text, num_threads=1)
        self.old: dict = {}

    def _ids(self, part: str):
        a, b = self.encode_a(" " + part), self.encode_b(part)
        whole = b" " + part.encode()
        if b"".join(map(self.b.__getitem__, b)) != whole or b"".join(map(self.a.__getitem__, a)) != whole:
            return None
        return array("H", a).tobytes(), array("H", b).tobytes()

    def __missing__(self, part: str):
        found = self.old.get(part, self)
        if found is self:
            found = self._ids(part)
        if len(part) < 64:
            if len(self) >= _KEPT:
                self.old = self.copy()
                self.clear()
            self[part] = found
        return found

    def of(self, text: str | None) -> tuple[bytes, bytes]:
        """Both sides' ids, or nothing if the text has no tokens."""
        if not text:
            return b"", b""
        parts = _BETWEEN.split(text) if _CROWDED.search(" " + text) else text.split(" ")
        try:
            a, b = zip(*map(self.__getitem__, parts))
        except TypeError:
            # A part isn't given back, so the whole text decides.
            return self._ids(text) or (b"", b"")
        return b"".join(a), b"".join(b)


_sides: dict[Alignment, Sides] = {}


def sides(conf: Alignment) -> Sides:
    """One per worker process, which Spark reuses from task to task."""
    if conf not in _sides:
        _sides.clear()
        _sides[conf] = Sides(conf)
    return _sides[conf]


class Tables:
    """What the sweep needs of the vocabularies: lengths in bytes, and ids as text with what may follow them."""

    def __init__(self, conf: Alignment):
        both = sides(conf)
        self.n = len(both.a), len(both.b)
        if max(self.n) > 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 ids")
        self.length = np.array(list(map(len, both.a)), np.int64), np.array(list(map(len, both.b)), np.int64)
        # Rows: A's ids with "," and with "|", B's ids with "," and with ";".
        told = [f"{i}{mark}".encode().ljust(6, b"\0") for n, marks in zip(self.n, (",|", ",;")) for mark in marks for i in range(n)]
        self.told = np.frombuffer(b"".join(told), np.uint8).reshape(-1, 6)
        self.size = (self.told != 0).sum(axis=1)


_tables: dict[Alignment, Tables] = {}


def tables(conf: Alignment) -> Tables:
    if conf not in _tables:
        _tables.clear()
        _tables[conf] = Tables(conf)
    return _tables[conf]


_EVENTS = "row bigint, at bigint, side tinyint, doc_id bigint, last boolean, ids binary"


def events(docs: DataFrame, conf: Alignment) -> DataFrame:
    """Runs of end events: document, byte where the run begins, side (0 A, 1 B), whether it is the side's last, packed ids."""
    names = [f.split()[0] for f in _EVENTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, lengths = sides(conf), tables(conf).length
        press = zstandard.ZstdCompressor(level=1)
        row = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                row += 1
                for side, raw in enumerate(both.of(text.as_py())):
                    at, step = 0, 2 * conf.run_tokens
                    for k in range(0, len(raw) or 1, step):
                        ids = raw[k : k + step]
                        out.append((row, at, side, doc_id, k + step >= len(raw), press.compress(ids)))
                        if k + step < len(raw):
                            at += int(lengths[side][np.frombuffer(ids, np.uint16)].sum())
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _EVENTS)


@dataclass
class _Open:
    """A document that the sweep is in, or has passed."""

    row: int
    doc_id: int | None
    digest: object
    text: list | None
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    split: bool = False  # its links come in several parts, where a pair can come again
    pairs: tuple = ()


_NOTHING = np.empty(0, np.uint32), np.empty(0, np.int64)
_ROWS = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, split boolean, n_pairs bigint, pairs binary, groups string"


class Sweep:
    """The state machine. `feed` takes runs in order and gives finished rows: documents with their links, or parts of a split document's links."""

    def __init__(self, conf: Alignment, with_groups: bool = False):
        self.t, self.most, self.with_groups = tables(conf), conf.sweep_tokens, with_groups
        self.held: tuple[list, list] = [], []  # runs of ids of each side that haven't been swept
        self.docs: list[tuple[_Open, int, int]] = []  # documents and their tokens in `held`
        self.size = 0
        self.press = zstandard.ZstdCompressor(level=1)

    def feed(self, row: int, doc_id: int | None, side: int, ids: np.ndarray) -> Iterator[tuple]:
        other = not self.docs or self.docs[-1][0].row != row
        if self.size >= self.most:
            yield from self.sweep(whole=other)
        if other:
            self.docs.append((_Open(row, doc_id, hashlib.sha256(), [] if self.with_groups else None), 0, 0))
        doc, *n = self.docs[-1]
        n[side] += len(ids)
        self.docs[-1] = (doc, *n)
        self.held[side].append(ids)
        # Documents without tokens are held too.
        self.size += len(ids) + 1

    def sweep(self, whole: bool) -> Iterator[tuple]:
        """Pass what is held up to the last end that both sides share. whole: all documents in it are complete."""
        ids = [np.concatenate(x) if x else np.empty(0, np.uint16) for x in self.held]
        sizes = np.array([d[1:] for d in self.docs], np.int64).reshape(-1, 2)
        ends = [np.cumsum(self.t.length[k][ids[k]]) for k in (0, 1)]
        marks = [np.zeros(max(e[-1] if len(e) else 0 for e in ends) + 1, bool) for _ in ends]
        for mark, e in zip(marks, ends):
            mark[e] = True
        common = [marks[1][ends[0]], marks[0][ends[1]]]
        # Tokens behind the last common end wait. They are all of the last document, as every document ends at a common end.
        keep = [len(x) if whole else int(np.flatnonzero(c)[-1]) + 1 if c.any() else 0 for x, c in zip(ids, common)]
        rest = [x[k:] for x, k in zip(ids, keep)]
        if keep[0]:
            if not whole:
                sizes[-1] -= [len(x) for x in rest]
                self.docs[-1][0].split = True
            yield from self._pass([x[:k] for x, k in zip(ids, keep)], [c[:k] for c, k in zip(common, keep)], sizes)
        for doc, *_ in self.docs if whole else self.docs[:-1]:
            yield self._row(doc, *(doc.pairs or _NOTHING), done=True)
        self.docs = [] if whole else [(self.docs[-1][0], *map(len, rest))]
        self.held = ([rest[0]], [rest[1]])
        self.size = sum(map(len, rest))

    def _row(self, doc: _Open, pairs: np.ndarray, n: np.ndarray, done: bool = False) -> tuple:
        """done: the document's row, else a part of its links. Pairs are in order: A's ids as steps, B's ids, counts."""
        a = (pairs >> np.uint32(16)).astype(np.uint16)
        packed = self.press.compress(np.diff(a, prepend=np.uint16(0)).tobytes() + pairs.astype(np.uint16).tobytes() + n.astype(np.uint32).tobytes())
        if not done:
            return doc.row, None, 0, 0, 0, 0, None, True, len(pairs), packed, None
        sha = doc.digest.hexdigest() if doc.n_groups else ""
        return doc.row, doc.doc_id, doc.n_a, doc.n_b, doc.n_groups, doc.n_links, sha, doc.split, len(pairs), packed, None if doc.text is None else b"".join(doc.text).decode()

    def _pass(self, ids: list, common: list, sizes: np.ndarray) -> Iterator[tuple]:
        (a, b), (na, nb), docs = ids, self.t.n, [d[0] for d in self.docs]
        group = [np.cumsum(c) - c for c in common]  # each token's group
        n_groups = int(common[0].sum())
        many = [np.bincount(g, minlength=n_groups) for g in group]
        first = [np.cumsum(m) - m for m in many]
        links = many[0] * many[1]
        # The ids' texts: a group's A tokens, then its B tokens.
        code = np.empty(len(a) + len(b), np.int32)
        code[np.arange(len(a)) + first[1][group[0]]] = a + common[0] * np.int32(na)
        code[np.arange(len(b)) + (first[0] + many[0])[group[1]]] = b + (common[1] * np.int32(nb) + np.int32(2 * na))
        raw = self.t.told[code].ravel()
        raw = raw[raw != 0].tobytes()
        text_ends = np.concatenate([[0], np.cumsum(self.t.size[code])])[np.cumsum(sizes.sum(axis=1))].tolist()
        n_of = np.diff(np.searchsorted(first[0], np.cumsum(sizes[:, 0])), prepend=0)  # groups of each document
        doc_of = np.repeat(np.arange(len(docs)), n_of)
        links_of = np.bincount(doc_of, weights=links, minlength=len(docs)).astype(np.int64)
        begin = 0
        for doc, end, n_a, n_b, n_g, n_l in zip(docs, text_ends, *sizes.T.tolist(), n_of.tolist(), links_of.tolist()):
            if end > begin:
                # The mark behind the last group only counts once more groups follow.
                text = b";" * bool(doc.n_groups) + raw[begin : end - 1]
                doc.digest.update(text)
                if doc.text is not None:
                    doc.text.append(text)
            doc.n_a, doc.n_b, doc.n_groups, doc.n_links, begin = doc.n_a + n_a, doc.n_b + n_b, doc.n_groups + n_g, doc.n_links + n_l, end
        # Pairs of all groups but very large ones at once, as document << 32 | A << 16 | B.
        large = np.flatnonzero(links > 4096)
        for k in doc_of[large].tolist():
            docs[k].split = True
        small = (links <= 4096)[group[0]]
        left = np.flatnonzero(small)
        times = many[1][group[0][left]]
        left = np.repeat(left, times)
        right = b[first[1][group[0][left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)]
        keys, n = np.unique(doc_of[group[0][left]].astype(np.uint64) << np.uint64(32) | a[left].astype(np.uint64) << np.uint64(16) | right.astype(np.uint64), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(docs) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
        pairs = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for doc, x, y in zip(docs, cuts, cuts[1:]):
            if not doc.split:
                doc.pairs = pairs[x:y], n[x:y]
            elif y > x:
                yield self._row(doc, pairs[x:y], n[x:y])
        for g in large.tolist():
            (xs, xn), (ys, yn) = (np.unique(x[f[g] : f[g] + m[g]], return_counts=True) for x, f, m in zip(ids, first, many))
            step = max(1, _MANY // len(ys))
            for k in range(0, len(xs), step):
                some = xs[k : k + step].astype(np.uint32)[:, None] << np.uint32(16) | ys.astype(np.uint32)
                yield self._row(docs[doc_of[g]], some.ravel(), (xn[k : k + step, None] * yn).ravel())


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]


def _batch(rows: list[tuple], schema: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema)], names=[n for n, _ in schema])


def swept(docs: DataFrame, conf: Alignment | None = None, with_groups: bool = False) -> DataFrame:
    """A row a document (doc_id, counts, digest, links if not split, the groups if asked for), and parts of split documents' links."""
    conf, schema = conf or Alignment(), _arrow(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, unpress = Sweep(conf, with_groups), zstandard.ZstdDecompressor()
        out, size = [], 0
        runs = ((r, d, s, np.frombuffer(unpress.decompress(x), np.uint16)) for b in batches for r, d, s, x in zip(*(b.column(k).to_pylist() for k in range(4))))

        def rows() -> Iterator[tuple]:
            for r in runs:
                yield from machine.feed(*r)
            if machine.docs:
                yield from machine.sweep(whole=True)

        for row in rows():
            out.append(row)
            size += len(row[9]) + len(row[10] or "")
            if size > 1 << 22 or len(out) >= 4096:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    ordered = events(docs, conf).repartition("row").sortWithinPartitions("row", "at", "side")
    return ordered.select("row", "doc_id", "side", "ids").mapInArrow(run, _ROWS)


def _unpacked(batch: pa.RecordBatch, unpress) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in the batch, pairs as A << 16 | B, their numbers of links); the batch has columns n_pairs and pairs."""
    for k, (n, packed) in enumerate(zip(batch.column("n_pairs").to_pylist(), batch.column("pairs"))):
        if n:
            raw = unpress.decompress(packed.as_py())
            a = np.cumsum(np.frombuffer(raw, np.uint16, n), dtype=np.uint16).astype(np.uint32)
            yield k, a << np.uint32(16) | np.frombuffer(raw, np.uint16, n, 2 * n), np.frombuffer(raw, np.uint32, n, 4 * n)


def _exploded(rows: DataFrame, skip=None) -> DataFrame:
    """row, a, b, n of the rows' links; skip: a broadcast of pairs (in order) to leave out."""
    schema = "row bigint, a int, b int, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = batch.column("row").to_pylist()
            for k, pairs, n in _unpacked(batch, unpress):
                if skip is not None:
                    known = _known(pairs, skip.value[0])[1]
                    pairs, n = pairs[~known], n[~known]
                columns = [np.full(len(pairs), ids[k]), (pairs >> np.uint32(16)).astype(np.int32), (pairs & np.uint32(0xFFFF)).astype(np.int32), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _arrow(schema))], names=["row", "a", "b", "n"])

    return rows.select("row", "n_pairs", "pairs").mapInArrow(run, schema)


def _known(pairs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
    return at, keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)


def pair_counts(rows: DataFrame, conf: Alignment) -> DataFrame:
    """swept() -> a, b, docs (documents that hold the pair linked), best (no pair of this a has more)."""
    schema = "a int, b int, docs bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        held, size = [], 0

        def told() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            columns = [(keys >> np.uint32(16)).astype(np.int32), (keys & np.uint32(0xFFFF)).astype(np.int32), n.astype(np.int64)]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["a", "b", "docs"])

        for batch in batches:
            for _, pairs, _ in _unpacked(batch, unpress):
                held.append(pairs)
                size += len(pairs)
                if size >= conf.counted_pairs:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    whole = rows.where("not split").select("n_pairs", "pairs").mapInArrow(run, schema)
    parts = _exploded(rows.where("split")).select("row", "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("docs"))
    counts = whole.union(parts).groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    # An A id has as many pairs as B has ids at most.
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def _frequent(pairs: DataFrame, most: int) -> DataFrame:
    """The most frequent pairs, at most `most` of them: whole classes of about equal counts, of which there are under 1,100."""
    kind = F.floor(F.log2("docs") * 16).cast("int")
    left, least = most, None
    for k, n in sorted((tuple(r) for r in pairs.groupBy(kind.alias("k")).count().collect()), reverse=True):
        if n > left:
            break
        left, least = left - n, k
    return pairs.where(kind >= least) if least is not None else pairs.where("false")


def aligned_documents(docs: DataFrame, conf: Alignment | None = None) -> DataFrame:
    """The thin result, one row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    conf, spark = conf or Alignment(), docs.sparkSession
    rows = cut(swept(docs, conf).drop("groups"))
    pairs = cut(pair_counts(rows, conf))
    table = _frequent(pairs, conf.broadcast_pairs).toPandas()
    keys = table["a"].to_numpy(np.uint32) << np.uint32(16) | table["b"].to_numpy(np.uint32)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], table["docs"].to_numpy(np.int64)[order], table["best"].to_numpy(bool)[order]))
    sums = ["n_a", "n_b", "n_groups", "n_links"]
    schema = "n_best bigint, count_sum bigint, row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        frequent, documents, best = known.value
        for batch in batches:
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, own, n in _unpacked(batch, unpress):
                at, hit = _known(own, frequent)
                at, n = at[hit], n[hit].astype(np.int64)
                n_best[k], count_sum[k] = n[best[at]].sum(), n @ documents[at]
            yield pa.RecordBatch.from_arrays([pa.array(n_best), pa.array(count_sum), *map(batch.column, names[2:])], names=names)

    scored = rows.select("row", "doc_id", *sums, "groups_sha256", "n_pairs", "pairs").mapInArrow(run, schema)
    if len(table) < pairs.count():
        rare = _exploded(rows, known).join(pairs, ["a", "b"]).groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum")
        )
        scored = scored.unionByName(rare, allowMissingColumns=True)
    out = scored.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*sums, "n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256")
    )
    return out.select("doc_id", *sums, "n_best", "count_sum", "groups_sha256")


def document_groups(docs: DataFrame, conf: Alignment | None = None) -> DataFrame:
    """doc_id and groups: `a1,a2|b1;a3|b2,b3`, decimal ids of A and B by group."""
    return swept(docs, conf, with_groups=True).where("groups_sha256 is not null").select("doc_id", "groups")


def document_links(docs: DataFrame, conf: Alignment | None = None) -> DataFrame:
    """row (a number of the document), a, b and n: how often the two ids are linked in it."""
    rows = swept(docs, conf)
    whole = _exploded(rows.where("not split"))
    return whole.union(_exploded(rows.where("split")).groupBy("row", "a", "b").agg(F.sum("n").alias("n")))
