"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is a byte-fallback BPE model file; its path is a parameter. Encoding runs SentencePiece's agenda:
candidate merges leave a priority queue by score, then position. Each candidate is skipped with probability
`dropout`, decided by a keyed hash of seed, document, place in the document and the candidate's turn, so the same input
always gives the same ids, while every occurrence of a word draws its own skips. Without dropout the ids equal the
library's own.

No piece crosses certain boundaries (before a space; between Latin letters and other characters; checked
against the vocabulary when it is loaded), so words are encoded on their own. A place in a document draws a mask of skips, whose bit i tells whether the word's i-th candidate is skipped.
A cut is decided by the word and the bits of the candidates it came to, so a bounded two-generation cache keeps cuts by both
and bounds no word's cuts: a mask without a skip gives the undisturbed cut, others are cut anew if they aren't kept. Words to be cut
wait for each other, and thousands go through their agendas together, a turn at a time, by numpy.

Decoding gives back exactly the text: spaces are the pieces' U+2581, characters outside the vocabulary and literal
U+2581 in a text are byte pieces, and the one space that encoding adds in front is removed.

Defined results: a null text has no ids and is decoded as null; an empty text has an empty list and is decoded as empty. A null key encodes as
key 0. Repeated rows (same key, same text) get the same ids. Very long texts are encoded whole, word by word, in batches of few rows. An
empty table gives no rows. Columns of the input stay, but for those that have the name of an output, which are replaced.
"""

from __future__ import annotations

import gc
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest as _hash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Where words may be cut, finest first. Words hold plain spaces, which keeps cached words at a byte a letter.
_CUTS = (
    re.compile(f" *[{_LATIN}]+| *[^ {_LATIN}]+| +"),
    re.compile(" *[^ ]+| +"),
    re.compile("(?s).+"),
)
_M = (1 << 64) - 1
_NEVER = np.int32(2**31 - 1)
_SHORT = 24  # characters of a word that is cut together with others
_AT_ONCE = 4096  # words that are cut together
_OPEN = 1 << 20  # characters of texts whose cuts are held until all of them are known


@dataclass(frozen=True)
class MergeDropout:
    dropout: float = 0.1
    seed: int = 20240229
    vocabulary: str = VOCABULARY
    cache_words: int = 500_000  # of each generation: words, and their cuts with skips, of which the first counts twice


class Codec:
    def __init__(self, conf: MergeDropout):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=conf.vocabulary)
        n = model.get_piece_size()
        self.conf = conf
        self.score, self.id, self.raw, self.byte = {}, {}, [], [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.id[piece] = i
                self.score[piece] = -model.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.cut = next(c for c in _CUTS if all(len(c.findall(p.replace(SPACE, " "))) == 1 for p in self.id))
        self.literal_space = array("i", (self.byte[b] for b in SPACE.encode())).tobytes()
        # Of each 16 bits of a hash, the skips of 8 candidates: a mask has as many of the 2^16 values as its probability.
        ones = np.array([m.bit_count() for m in range(256)])
        upto = np.cumsum(conf.dropout**ones * (1 - conf.dropout) ** (8 - ones)) * (1 << 16)
        self.skips = np.minimum(np.searchsorted(upto, np.arange(1 << 16) + 0.5), 255).astype(np.uint8)
        self.bits = n.bit_length()
        # Merges by the numbers of both sides, and each piece's place in the agenda: lower is earlier, equal scores share one.
        self.merge = {}
        for piece, i in self.id.items():
            for k in range(1, len(piece)):
                left, right = self.id.get(piece[:k]), self.id.get(piece[k:])
                if left is not None and right is not None:
                    self.merge[left << self.bits | right] = i
        ranks = {x: r for r, x in enumerate(sorted(set(self.score.values())))}
        self.rank = [0] * n
        for piece, i in self.id.items():
            self.rank[i] = ranks[self.score[piece]]
        self.code = {k: self.rank[i] for k, i in self.merge.items()}
        # The same for many words at once: merges in a hash table, pieces of one character, and what stands for no symbol.
        self.edge = n
        self._hash_merges()
        self.symbol = np.full(sys.maxunicode + 1, -1, np.int32)
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[ord(" ")] = self.id.get(SPACE, -1)
        # word -> (undisturbed ids, mask of its candidates, {turns' mask | 1 << turns: ids, 0: numbers of turns})
        self.young: dict[str, tuple[bytes, int, dict]] = {}
        self.old: dict[str, tuple[bytes, int, dict]] = {}
        self.held = 0

    def masks(self, places: np.ndarray) -> np.ndarray:
        """Skips of the first 32 candidates at each place, by its 64-bit hash."""
        x = (places ^ (places >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return self.skips[(x ^ (x >> np.uint64(31))).view(np.uint16)].view(np.uint32)

    def word(self, word: str, place: int) -> bytes:
        """The ids of a word at a place."""
        place = _hash((place & _M).to_bytes(8, "little"), self.conf.seed & _M)
        return self.agenda(word, int(self.masks(np.array([place], np.uint64))[0]), place)[0]

    def agenda(self, word: str, mask: int = 0, place: int | None = None) -> tuple[bytes, int]:
        """The agenda over one word: int32 ids, and how many candidates had their turn. From the 33rd candidate on, the place's
        further masks decide; without a place, nothing is skipped there."""
        get = self.id.get
        ids = [get(c, -1) for c in word.replace(" ", SPACE)]
        if len(ids) > 32 or -1 in ids:
            return self._queued(word, mask, place)
        # A word this short has the ranks of all neighbours in a list, whose first least is next: that is cheaper than a queue.
        merge, rank, bits, none = self.merge, self.code.get, self.bits, 1 << 62
        pairs = [rank(a << bits | b, none) for a, b in zip(ids, ids[1:])]
        turn = 0
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            if turn and not turn & 31 and place is not None:
                mask = int(self.masks(np.array([_hash(turn.to_bytes(8, "little"), place)], np.uint64))[0])
            skipped = mask >> (turn & 31) & 1
            turn += 1
            if skipped:
                pairs[i] = none
                continue
            m = ids[i] = merge[ids[i] << bits | ids[i + 1]]
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(m << bits | ids[i + 1], none)
            if i:
                pairs[i - 1] = rank(ids[i - 1] << bits | m, none)
        return array("i", ids).tobytes(), turn

    def _queued(self, word: str, mask: int, place: int | None) -> tuple[bytes, int]:
        """agenda() with a priority queue, for words of any length. Entries are rank << 32 | place of the left symbol."""
        word = word.replace(" ", SPACE)
        merge, rank, bits = self.merge, self.rank, self.bits
        turn = 0
        n = len(word)
        ids = [self.id.get(c, -1) for c in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            m = merge.get(ids[i] << bits | ids[i + 1])
            if m is not None:
                agenda.append(rank[m] << 32 | i)
        if agenda:
            heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            a = entry & 0xFFFFFFFF
            b = after[a]
            if b >= n:
                continue
            m = merge.get(ids[a] << bits | ids[b])
            if m is None or rank[m] != entry >> 32:
                continue  # a side has merged with another symbol meanwhile
            if turn and not turn & 31 and place is not None:
                mask = int(self.masks(np.array([_hash(turn.to_bytes(8, "little"), place)], np.uint64))[0])
            skipped = mask >> (turn & 31) & 1
            turn += 1
            if skipped:
                continue
            ids[a], ids[b] = m, -2
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                x = merge.get(m << bits | ids[c])
                if x is not None:
                    heappush(agenda, rank[x] << 32 | a)
            p = before[a]
            if p >= 0:
                x = merge.get(ids[p] << bits | m)
                if x is not None:
                    heappush(agenda, rank[x] << 32 | p)
        if -1 not in ids:
            return array("i", [i for i in ids if i >= 0]).tobytes(), turn
        out = array("i")
        for i, c in zip(ids, word):
            if i >= 0:
                out.append(i)
            elif i == -1:
                out.extend(self.byte[x] for x in c.encode())
        return out.tobytes(), turn

    def _room(self, n: int) -> None:
        if self.held >= self.conf.cache_words:
            self.old, self.young, self.held = self.young, {}, 0
        self.held += n

    def _kept(self, word: str, mask: int) -> bytes | None:
        """A cut from the caches: the undisturbed one if the mask skips none of its candidates, else one with these skips."""
        entry = self.young.get(word)
        if entry is None:
            entry = self.old.get(word)
            if entry is None:
                return None
            self._room(1)
            self.young[word] = entry = (*entry[:2], None)
        if not entry[1] & (mask | 1 << 32):
            return entry[0]
        if entry[2]:
            for n in entry[2][0]:
                ids = entry[2].get(mask & ((1 << n) - 1) | 1 << n)
                if ids is not None:
                    return ids
        return None

    def _keep(self, word: str, mask: int, ids: bytes, turns: int) -> None:
        if turns > 32 or len(word) > 64:
            return
        used = (1 << turns) - 1
        entry = self.young.get(word)
        if not used & mask:
            if entry is None:
                self._room(1)
                self.young[word] = (ids, used, None)
        elif entry is not None:
            kept = entry[2]
            self._room(1 if kept else 2)
            if kept is None:
                kept = {0: ()}
                self.young[word] = (*entry[:2], kept)
            kept[mask & used | 1 << turns] = ids
            if turns not in kept[0]:
                kept[0] += (turns,)

    def _hash_merges(self) -> None:
        """A table with free slots that holds both sides of each merge, its rank and its piece, at the first free slot after its hash."""
        keys = np.array(sorted(self.merge), np.int64)
        size = 1 << max(4, (8 * len(keys)).bit_length())
        self.slots, self.slot_rank, self.slot_piece = np.full(size, -1), np.full(size, _NEVER), np.zeros(size, np.int32)
        self.spread = np.uint64(64 - size.bit_length() + 1)
        slot = self._slot(keys)
        while len(keys):
            first = np.unique(np.where(self.slots[slot] < 0, slot, -1), return_index=True)
            put = first[1][first[0] >= 0]
            self.slots[slot[put]] = keys[put]
            self.slot_rank[slot[put]] = [self.code[k] for k in keys[put].tolist()]
            self.slot_piece[slot[put]] = [self.merge[k] for k in keys[put].tolist()]
            rest = np.delete(np.arange(len(keys)), put)
            keys, slot = keys[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.spread).view(np.int64)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of neighbours (_NEVER if they don't merge) and the pieces that they merge to."""
        keys = left.astype(np.int64) << self.bits | right
        slot = self._slot(keys)
        held = self.slots[slot]
        on = np.nonzero((held != keys) & (held >= 0))
        while len(on[0]):
            slot[on] = (slot[on] + 1) & (len(self.slots) - 1)
            held = self.slots[slot[on]]
            more = (held != keys[on]) & (held >= 0)
            on = tuple(x[more] for x in on)
        return self.slot_rank[slot], self.slot_piece[slot]

    def agendas(self, words: list[str], masks: np.ndarray) -> list[tuple[bytes, int]]:
        """agenda() of many words of at most _SHORT characters at once, a turn of all words at a time. Words with a character outside of the
        vocabulary or a candidate after the 32nd come back with 33 turns and no ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        width = int(lengths.max()) + 2  # an edge on both sides
        of = np.repeat(np.arange(len(words)), lengths)
        nth = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.full((len(words), width), self.edge, np.int32)
        ids[of, nth + 1] = self.symbol[codes]
        odd = (ids < 0).any(axis=1)
        ids[odd] = self.edge
        ranks, into = self._ranked(ids[:, :-1], ids[:, 1:])
        after = np.broadcast_to(np.arange(1, width + 1), ids.shape).copy()
        before = after - 2
        turns = np.zeros(len(words), np.int64)
        masks = masks.astype(np.int64)
        rows = np.arange(len(words))
        for turn in range(33):
            mine = ranks[rows]
            i = mine.argmin(axis=1)
            live = mine[np.arange(len(rows)), i] != _NEVER
            rows, i = rows[live], i[live]
            if not len(rows):
                break
            turns[rows] = turn + 1
            skipped = (masks[rows] >> turn & 1).astype(bool)
            ranks[rows[skipped], i[skipped]] = _NEVER
            r, i = rows[~skipped], i[~skipped]
            b, m = after[r, i], into[r, i]
            c, p = after[r, b], before[r, i]
            ids[r, i], ids[r, b] = m, self.edge
            after[r, i], before[r, c], ranks[r, b] = c, i, _NEVER
            ranks[r, i], into[r, i] = self._ranked(m, ids[r, c])
            ranks[r, p], into[r, p] = self._ranked(ids[r, p], m)
        turns[odd] = 33
        alive = ids != self.edge
        ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        whole = ids[alive].tobytes()
        return [(whole[a:b], n) for a, b, n in zip([0, *ends], ends, turns.tolist())]

    def _settle(self, wait: list[tuple]) -> None:
        """Cuts what waits: (list of cuts, index in it, word, mask, places, index in them)."""
        short = [x for x in wait if len(x[2]) <= _SHORT]
        cuts = self.agendas([x[2] for x in short], np.array([x[3] for x in short], np.uint32)) if short else []
        long = [(x, (b"", 33)) for x in wait if len(x[2]) > _SHORT]
        for (found, k, word, mask, places, j), (ids, turns) in (*zip(short, cuts), *long):
            if turns > 32:
                ids, turns = self.agenda(word, mask, int(places[j]))
            found[k] = ids
            self._keep(word, mask, ids, turns)
        wait.clear()

    def _look_up(self, text: str, key: int, found: list, wait: list[tuple]) -> None:
        """The cuts of a text's words go to `found`; those that aren't kept go to `wait` instead."""
        at = _hash((key & _M).to_bytes(8, "little"), self.conf.seed & _M)
        for nth, part in enumerate(text.split(SPACE)):
            if nth:
                found.append(self.literal_space)
            words = self.cut.findall(part if nth else " " + part)
            places = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at)
            begin = len(found)
            for w, mask in zip(words, self.masks(places).tolist()):
                entry = self.young.get(w)
                if entry is not None and not entry[1] & (mask | 1 << 32):
                    found.append(entry[0])
                    continue
                ids = self._kept(w, mask)
                found.append(ids)
                if ids is None:
                    k = len(found) - 1
                    wait.append((found, k, w, mask, places, k - begin))
                    if len(wait) >= _AT_ONCE:
                        self._settle(wait)
            at = (at + len(words) * 0x9E3779B97F4A7C15) & _M

    def encode_all(self, texts: list[str | None], keys: list[int | None]) -> list[array | None]:
        # Nothing here makes cycles, but the many tuples would set off the collector, which walks the caches.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts, keys)
        finally:
            if collects:
                gc.enable()

    def _encode_all(self, texts: list[str | None], keys: list[int | None]) -> list[array | None]:
        out: list = []
        wait: list[tuple] = []
        begin = size = 0

        def close() -> None:
            self._settle(wait)
            out[begin:] = [None if f is None else array("i", b"".join(f)) for f in out[begin:]]

        for text, key in zip(texts, keys):
            out.append(None if text is None else [])
            if text:
                self._look_up(text, key or 0, out[-1], wait)
                size += len(text)
                if size > _OPEN:
                    close()
                    begin, size = len(out), 0
        close()
        return out

    def encode(self, text: str, key: int = 0) -> array:
        return self.encode_all([text], [key])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]


_codecs: dict[MergeDropout, Codec] = {}


def codec(conf: MergeDropout) -> Codec:
    """One per worker process, which Spark reuses from task to task."""
    if conf not in _codecs:
        _codecs.clear()
        _codecs[conf] = Codec(conf)
    return _codecs[conf]


def _ids_column(found: list[array | None]) -> pa.Array:
    lengths = [len(f) if f is not None else 0 for f in found]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    values = np.concatenate([np.frombuffer(f, np.int32) for f in found if f] or [np.empty(0, np.int32)])
    missing = pa.array([f is None for f in found])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=missing)


_OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "n_ids": T.IntegerType(), "ids_sha256": T.StringType(), "lossless": T.BooleanType()}


def encode(docs: DataFrame, conf: MergeDropout | None = None, text: str = "text", key: str = "doc_id", outputs: tuple = ("ids",), keep_text: bool = True) -> DataFrame:
    """`docs` with any of: ids (array<int>), n_ids, ids_sha256 (of the ids as int32), lossless (decoding gives the text back)."""
    conf = conf or MergeDropout()
    rest = [c for c in docs.columns if (keep_text or c != text) and c not in outputs]
    schema = T.StructType([*[docs.schema[c] for c in rest], *[T.StructField(o, _OUTPUTS[o]) for o in outputs]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(conf)
        make = {
            "ids": lambda found, texts: _ids_column(found),
            "n_ids": lambda found, texts: pa.array([None if f is None else len(f) for f in found], pa.int32()),
            "ids_sha256": lambda found, texts: pa.array([None if f is None else hashlib.sha256(f.tobytes()).hexdigest() for f in found], pa.string()),
            "lossless": lambda found, texts: pa.array([None if f is None else c.decode(f) == t for f, t in zip(found, texts)], pa.bool_()),
        }
        for big in batches:
            # Long texts go on in batches of few rows, since the ids of a batch are held together.
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                texts, keys = b.column(text).to_pylist(), b.column(key).to_pylist()
                found = c.encode_all(texts, keys)
                yield pa.RecordBatch.from_arrays([*[b.column(x) for x in rest], *[make[o](found, texts) for o in outputs]], names=names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, conf: MergeDropout | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    conf = conf or MergeDropout()
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(conf)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                texts = [None if x is None else c.decode(x) for x in b.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def encoded_digest(docs: DataFrame) -> DataFrame:
    """The thin result: doc_id, n_chars (code points), n_ids, ids_sha256 and whether decoding gave the text back."""
    rows = docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "text")
    return encode(rows, outputs=("n_ids", "ids_sha256", "lossless"), keep_text=False)
