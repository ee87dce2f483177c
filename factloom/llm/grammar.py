"""Token ids as files, compressed by Re-Pair grammars, with random access.

`write_ids` encodes whole texts with a tokenizer file, puts an end id after each document and writes all ids in ascending order of
doc_id. Texts are range-partitioned by key and sorted; each task then encodes its documents in turn and closes a shard at the first
document end beyond `shard_ids` ids. Every shard has a grammar of its own:

* each round counts all adjacent pairs of symbols and replaces the frequent ones (`least` times or more) by nonterminals, many pairs a
  round: where pairs overlap, the more frequent one is replaced, and the other one counts again in the next round. No pair spans two documents;
* rounds end when one of them shortens the shard by less than `least_gain`. A hash table of counts finds the pairs, and only occurrences
  of exactly the pair that a slot stands for are replaced, so a collision delays a pair to a later round and never mixes two.

A shard is one row of a Parquet table, the file format: part and shard number, ids of the part before it, keys and id counts of its documents, the symbols
that are left (uint32), its rules (left and right symbol, uint32) and the rules' expansion lengths (uint32). Lengths place any range of ids: their running
sum over the symbols gives the symbols to expand, and nothing else is decoded (`Shard.ids`, `read_range`). Spark's writer commits each task's
file once, wherever the folder is, so a lost executor's tasks can run again.

Words between ASCII white space are encoded on their own, as the tokenizer drops white space and joins nothing over it; a bounded cache keeps their ids. Those of
ASCII and Latin-1 letters, digits and marks are split by the tokenizer's own pattern and go to the library's merge model at once; all others, and what lies between
rarer kinds of white space, pass through the whole library.

Memory: a shard and the word cache; a document that is longer than a shard is one of its own. No step holds a key's rows: equal keys are split over partitions by text and row.

Defined results: a null text counts as empty and has the end id alone. Null keys come first, repeated keys are ordered by a hash of their texts, repeated rows are
all written. Very long texts are encoded whole. An empty table gives files without shards and no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import checkpoint_folder, partitions, text_or_empty

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: The pre-tokenizer's pattern, for words of the characters in _PLAIN, once they are in lower case.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: What some take for white space and others don't.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_KEPT = 700_000  # words in each of the cache's two generations


@dataclass(frozen=True)
class IdFiles:
    tokenizer: str = TOKENIZER
    end_id: int = 2
    shard_ids: int = 1 << 20
    least: int = 24  # occurrences in a shard that make a pair frequent
    least_gain: float = 0.02  # share of the symbols that a round must remove for another one to follow
    slots: int = 18  # bits of the table that counts pairs


class WordIds(dict):
    """Ids of texts. The dictionary keeps the ids of words, as bytes, in two generations."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merge = self.whole.model.tokenize
        self.size = self.whole.get_vocab_size()
        self.code, self.kind = ("H", np.uint16) if self.size <= 1 << 16 else ("I", np.uint32)
        self.old: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        # The byte-level alphabet: printable bytes stand for themselves, the n-th other byte for character 256 + n.
        self.byte = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}

    def _ids(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():  # most words: one part, and capitals mean small letters
            return array(self.code, [t.id for t in self.merge(word)]).tobytes() if word.islower() else self[word.lower()]
        plain = word.isascii() and word.isprintable() or _PLAIN.fullmatch(word)
        if not plain:
            return array(self.code, self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        # Letters and a mark behind them are parts of their own, and capitals mean small letters: those words are kept more often.
        if word[:-1].isalpha() and not word[-1].isalnum():
            return self[word[:-1]] + self[word[-1]]
        if not word.islower() and (small := word.lower()) != word:
            return self[small]
        found = []
        for part in [word] if word.isalpha() else _PARTS.findall(word):
            found += [t.id for t in self.merge(part if part.isascii() else "".join(map(self.byte.__getitem__, part.encode())))]
        return array(self.code, found).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word) if self.old else None
        if ids is None:
            ids = self._ids(word)
        if len(word) < 64:
            if len(self) >= _KEPT:
                self.old = self.copy()
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str) -> np.ndarray:
        words = text.split() if not _ODD_SPACE.search(text) else [w for w in _ASCII_SPACE.split(text) if w]
        return np.frombuffer(b"".join(map(self.__getitem__, words)), self.kind)


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One per worker process, which Spark reuses from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordIds(path)
    return _encoders[path]


def compress(ids: np.ndarray, counts: np.ndarray, conf: IdFiles, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents with `counts` ids each -> symbols and rules (n x 2). Symbol `terminals` + k is rule k."""
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[np.cumsum(counts) - 1] = True
    slots, rules, turn = 1 << conf.slots, [np.empty((0, 2), np.uint32)], 0
    while len(s) > 1:
        mix = np.uint32((0x9E3779B1 + turn * 0x7F4A7C16) & 0xFFFFFFFF | 1)
        at = ((s[:-1] * mix ^ s[1:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - conf.slots)).astype(np.int32)
        free = ~last[:-1]
        often = np.bincount(at[free], minlength=slots) >= conf.least
        places = np.flatnonzero(often[at] & free)
        at, pair = at[places], s[places].astype(np.uint64) << np.uint64(32) | s[places + 1]
        # A slot stands for one of the pairs that fall into it; the others wait for a round that mixes otherwise.
        stands = np.zeros(slots, np.uint64)
        stands[at] = pair
        own = stands[at] == pair
        places, at = places[own], at[own]
        count = np.bincount(at, minlength=slots)
        own = count[at] >= conf.least
        places, at = places[own], at[own]
        # Of two occurrences that share a symbol, the one of the more frequent pair is replaced; in a run of one id, every other one.
        rank = count[at] << conf.slots | at
        touch = np.flatnonzero(np.diff(places) == 1)
        lost = np.zeros(len(places), bool)
        lost[touch[rank[touch] < rank[touch + 1]]] = True
        lost[touch[rank[touch] > rank[touch + 1]] + 1] = True
        same = touch[rank[touch] == rank[touch + 1]] + 1
        if len(same):
            begin = np.arange(len(places))
            begin[same] = 0
            lost |= (np.arange(len(places)) - np.maximum.accumulate(begin)) % 2 == 1
        places, at = places[~lost], at[~lost]
        used = np.bincount(at, minlength=slots) * 2 >= conf.least
        own = used[at]
        places, at = places[own], at[own]
        if not len(places):
            break
        which = np.flatnonzero(used)
        symbol = np.zeros(slots, np.uint32)
        symbol[which] = terminals + sum(map(len, rules)) + np.arange(len(which), dtype=np.uint32)
        rules.append(np.stack([stands[which] >> np.uint64(32), stands[which] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        s[places], last[places] = symbol[at], last[places + 1]
        stays = np.ones(len(s), bool)
        stays[places + 1] = False
        gained, s, last = len(places) / len(s), s[stays], last[stays]
        turn += 1
        if gained < conf.least_gain:
            break
    return s, np.concatenate(rules)


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for. A rule only names terminals and rules before it."""
    found: list[int] = []
    for left, right in rules.tolist():
        found.append((1 if left < terminals else found[left - terminals]) + (1 if right < terminals else found[right - terminals]))
    return np.array(found, np.uint32)


class Shard:
    """A written shard, decoded in any place."""

    def __init__(self, row: dict):
        self.terminals = row["terminals"]
        self.symbols = np.frombuffer(row["symbols"], "<u4")
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        lengths = np.concatenate([np.ones(self.terminals, np.int64), np.frombuffer(row["lengths"], "<u4").astype(np.int64)])
        self.lengths, self.ends = lengths, np.cumsum(lengths[self.symbols])
        self.flat: np.ndarray | None = None

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        if self.flat is None:
            parts: list[list[int]] = []
            for left, right in self.rules.tolist():
                parts.append(([left] if left < self.terminals else parts[left - self.terminals]) + ([right] if right < self.terminals else parts[right - self.terminals]))
            self.flat = np.concatenate([np.arange(self.terminals, dtype=np.uint32), *[np.array(p, np.uint32) for p in parts]])
            self.begins = np.cumsum(self.lengths) - self.lengths
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.begins[symbols] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from `first` to before `last`, of which only the symbols that hold them are expanded."""
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(self.ends, first, "right"), np.searchsorted(self.ends, last, "left") + 1
        skip = first - (int(self.ends[a - 1]) if a else 0)
        return self._expanded(self.symbols[a:b])[skip : skip + last - first]


SCHEMA = "part int, shard int, first bigint, n_ids bigint, terminals int, doc_ids array<bigint>, counts array<int>, symbols binary, rules binary, lengths binary"
_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("terminals", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
     ("counts", pa.list_(pa.int32())), ("symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary())]
)


def shards(docs: DataFrame, conf: IdFiles | None = None) -> DataFrame:
    """The rows of the file format."""
    conf = conf or IdFiles()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    keys = ["doc_id", "h", "tie"]
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie"), "text")
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(conf.tokenizer)
        end = np.array([conf.end_id], words.kind)
        part, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        ids_of: list[int | None] = []
        counts: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal number, first
            ids, terminals = np.concatenate(held), max(words.size, conf.end_id + 1)
            s, rules = compress(ids, np.array(counts), conf, terminals)
            row = [part, number, first, len(ids), terminals, list(ids_of), list(counts), s.tobytes(), rules.tobytes(), expansion_lengths(rules, terminals).tobytes()]
            number, first = number + 1, first + len(ids)
            for x in (held, ids_of, counts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.of(text.as_py())
                held += [ids, end]
                ids_of.append(doc_id)
                counts.append(len(ids) + 1)
                size += len(ids) + 1
                if size >= conf.shard_ids:
                    yield close()
                    size = 0
        if held:
            yield close()

    return ranged.mapInArrow(run, SCHEMA)


def write_ids(docs: DataFrame, folder: str, conf: IdFiles | None = None) -> None:
    shards(docs, conf).write.option("compression", "zstd").parquet(folder)


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """All shards, with `before`: the ids in front of the shard's part."""
    table = spark.read.schema(SCHEMA).parquet(folder)
    # One row a part, and parts are as many as shuffle partitions: their running sum is small, whatever the number of shards.
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return table.join(F.broadcast(before), "part")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row a document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                shard, n = Shard(row), np.array(row["counts"], np.int64)
                ends, place = np.cumsum(n), row["before"] + row["first"]
                ids = shard.ids(0, row["n_ids"]).astype("<u4")
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist())]
                columns = [row["doc_ids"], ends - n + place, n, crc, *[np.split(ids.astype(np.int32), ends[:-1])] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return _placed(spark, folder).mapInArrow(run, schema)


def read_range(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """The ids from place `first` to before place `last` of the whole corpus, by shard: start, ids. Other shards aren't decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                place = row["before"] + row["first"]
                a, b = max(first - place, 0), min(last - place, row["n_ids"])
                ids = Shard(row).ids(a, b).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([place + a], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["start", "ids"])

    place = F.col("before") + F.col("first")
    return _placed(spark, folder).where((place < last) & (place + F.col("n_ids") > first)).mapInArrow(run, "start bigint, ids array<int>")


def written_documents(docs: DataFrame, conf: IdFiles | None = None) -> DataFrame:
    """The thin result: all documents are written to a new folder beside the checkpoints and read back from there."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, conf)
    return read_documents(spark, folder)
