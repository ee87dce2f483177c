"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed character 1- to 3-grams over its letters (lower-cased; every run of other
characters is one space), with weights (1 + ln tf) * idf, normalised to length 1. Each learned language has
several centroids, from spherical k-means over its training vectors (clusters of a few outliers are given up, as they hold
mislabelled texts), and a prediction is the language of the centroid with the largest cosine.

Rejection is by cosine distance, 1 - cosine. Every third sampled text of a language is held back from its centroids; the distances
of these to their language's nearest centroid tell how far a text of a learned language lies from it, which depends on its length. So
for each doubling of the number of grams there is a limit: the distance that only `reject_share` of the held-back texts of that length
and its neighbours exceed, given `slack` of room. A text beyond its limit is rejected: it is like none of the learned languages.

The model is fitted on a bounded sample, which is a parameter: at most `per_language` labelled texts of each label,
those with the smallest hashes of their ids among a thinned draw by hash, out of the rows that may be learned from. Every label is
learned. The sample becomes counts of at most DIMENSIONS grams a text in tasks, and each language is fitted in a task of its own. Centroids are written as a table
and go to the tasks in blocks of `block_labels` labels, each a broadcast of bounded size; the driver and a task hold one block at a time, and a text keeps
its best centroid from block to block. Of each label, the driver keeps its name and the distances of at most a third of its sample.

Defined results: a null text, and a text without letters: `und`, score 0, rejected. With no labelled row at all, everything is `und`. A
null doc_id is not held out and not learned from. Text, and nothing else, decides a prediction, so that repeated rows get equal results;
of centroids at equal cosine, that of the label that sorts first counts. Very long texts are read whole, in pieces of bounded memory. An
empty table gives no rows. `identify` ignores other columns, whatever their names; `keep_identified` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

DIMENSIONS = 1 << 14
#: Labels whose shares are broadcast; more of them are joined by a shuffle.
MOST_SENT = 100_000
UNDETERMINED = "und"


@dataclass(frozen=True)
class Fit:
    per_language: int = 300
    block_labels: int = 128  # labels whose centroids are held, and sent, together: at most 128 * clusters * 64 KB
    clusters: int = 4
    rounds: int = 10
    least_share: float = 0.08  # of a language's sample that a cluster must hold; smaller ones are mostly wrong labels
    reject_share: float = 0.002
    slack: float = 0.6  # of the cosine at the limit


def _letters_table() -> np.ndarray:
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c
    return table


_table: np.ndarray | None = None


#: Characters that are looked at together, which bounds memory for texts of any length.
_AT_ONCE = 1 << 18


def _normalised(part: str) -> np.ndarray:
    """Code points, with 32 for all that aren't letters."""
    global _table
    if _table is None:
        _table = _letters_table()
    codes = np.frombuffer(part.lower().encode("utf-32-le", "replace"), np.uint32)
    high = codes > 0xFFFF
    if not high.any():
        return _table[codes]
    codes = codes.copy()  # letters outside the basic plane: by Python's own table
    codes[high] = [c if chr(c).isalpha() else 32 for c in codes[high].tolist()]
    codes[~high] = _table[codes[~high]]
    return codes


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a text and how often each occurs; None if it has no letter."""
    if not text:
        return None
    counts = np.zeros(DIMENSIONS, np.int64)
    mix, letters = np.uint64(0x9E3779B97F4A7C15), False
    tail = np.array([32], np.uint64)  # what comes before: a space at first, then the last two codes
    for at in range(0, len(text) + 1, _AT_ONCE):
        codes = _normalised(text[at : at + _AT_ONCE])
        if at + _AT_ONCE > len(text):
            codes = np.append(codes, np.uint32(32))
        space = codes == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] |= tail[-1] != 32
        codes = codes[keep]
        if not len(codes):
            continue
        letters = letters or bool((codes != 32).any())
        c, k = np.concatenate((tail, codes.astype(np.uint64))), len(tail)
        two = c[k - 1 : -1] * np.uint64(0x10001) + c[k:] + np.uint64(7 << 50)
        three = (c[:-2] * np.uint64(0x10001) + c[1:-1] + np.uint64(7 << 50)) * np.uint64(0x10001) + c[2:] + np.uint64(11 << 50)
        counts += np.bincount((np.concatenate((c[k:], two, three)) * mix >> np.uint64(50)).astype(np.int64), minlength=DIMENSIONS)
        tail = c[-2:]
    if not letters:
        return None
    counts[(np.array([32], np.uint64) * mix >> np.uint64(50)).astype(np.int64)] -= 1  # the space after the last letter is no gram of its own
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def _vector(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(found[1])) * idf[found[0]]
    return (w / (np.linalg.norm(w) or 1.0)).astype(np.float32)


def _length(counts: np.ndarray) -> int:
    """A text's class of length: doublings of its number of grams."""
    return int(counts.sum()).bit_length()


@dataclass
class Block:
    """Some labels' centroids at hand; a broadcast of the same value takes its place on a cluster."""

    value: tuple[np.ndarray, np.ndarray]  # (centroid, dimension), of length 1; each centroid's number of its label


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    blocks: list  # in order of labels
    reject: np.ndarray  # by class of length: a text under this cosine is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """One block of labels at a time, with each text's best so far."""
        found = [features(t) for t in texts]
        vectors = [None if f is None else _vector(f, self.idf) for f in found]
        best: list[tuple[float, int]] = [(-np.inf, 0)] * len(texts)
        for block in self.blocks:
            centroids, language_of = block.value
            for i, (f, v) in enumerate(zip(found, vectors)):
                if f is not None:
                    cosines = centroids[:, f[0]] @ v
                    k = int(np.argmax(cosines))
                    if cosines[k] > best[i][0]:
                        best[i] = float(cosines[k]), int(language_of[k])
        out = []
        for f, (cosine, language) in zip(found, best):
            if f is None or not self.languages:
                out.append((UNDETERMINED, 0.0, True))
            else:
                limit = self.reject[min(_length(f[1]), len(self.reject) - 1)]
                out.append((self.languages[language], float(min(1.0, max(0.0, round(cosine, 6)))), bool(cosine < limit)))
        return out


def _clusters(x: np.ndarray, k: int, rounds: int, least: float) -> np.ndarray:
    """Spherical k-means, deterministic: seeds are texts at even ranks of likeness to the language's mean, which, unlike
    farthest texts, aren't outliers. Clusters under the least share are given up."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    k = min(k, len(x))
    ranked = np.argsort(x @ unit(x.mean(axis=0)), kind="stable")
    c = x[ranked[[(2 * i + 1) * len(x) // (2 * k) for i in range(k)]]]
    for _ in range(rounds):
        nearest = np.argmax(x @ c.T, axis=1)
        c = np.array([unit(x[nearest == i].mean(axis=0)) if (nearest == i).any() else c[i] for i in range(len(c))])
    held = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    return c[(held >= least * len(x)) | (held == held.max())]


def fit_language(found: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, conf: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Of one language's texts, in a fixed order: centroids, and (class of length, cosine) of those that are held back."""
    x = np.zeros((len(found), DIMENSIONS), np.float32)
    for row, f in enumerate(found):
        x[row, f[0]] = _vector(f, idf)
    back = np.arange(len(found)) % 3 == 2
    centroids = _clusters(x[~back], conf.clusters, conf.rounds, conf.least_share).astype(np.float32)
    # A language of one or two texts has none to hold back.
    told = back if back.any() else ~back
    return centroids, np.array([(_length(f[1]), c) for f, c, b in zip(found, (x @ centroids.T).max(axis=1), told) if b])


def limits(held: np.ndarray, conf: Fit) -> np.ndarray:
    """By class of length: the least cosine that isn't rejected. Classes without a text near take half of the nearest one's."""
    if not len(held):
        return np.zeros(1)
    out = []
    for k in range(64):
        apart = np.abs(held[:, 0] - k)
        out.append((conf.slack if apart.min() <= 1 else 0.5) * np.quantile(held[apart <= max(1, apart.min()), 1], conf.reject_share, method="lower"))
    return np.array(out)


def _block(first: int, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(centroids), np.concatenate([np.full(len(c), first + i) for i, c in enumerate(centroids)])


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def fit(texts: list[tuple[str, str]], conf: Fit | None = None) -> Model:
    """texts: (language, text), in a fixed order; what learn() does in tasks, for a sample at hand."""
    conf = conf or Fit()
    found = [(lang, f) for lang, t in texts if (f := features(t)) is not None]
    df = np.zeros(DIMENSIONS)
    for _, (ids, _) in found:
        df[ids] += 1
    idf = _idf(df, len(found))
    names = sorted({lang for lang, _ in found})
    fitted = [fit_language([f for lang, f in found if lang == name], idf, conf) for name in names]
    blocks = [Block(_block(0, [c for c, _ in fitted]))] if fitted else []
    return Model(names, idf, blocks, limits(np.concatenate([h for _, h in fitted]) if fitted else np.empty(0), conf))


def remainder(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(b.num_rows):
            found = features(b.column("text")[at].as_py())
            if found is not None:
                lists = [pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in found]
                yield pa.RecordBatch.from_arrays([b.column(n).slice(at, 1) for n in ("lang", "h", "d")] + lists, names=["lang", "h", "d", "ids", "counts"])


def sample(docs: DataFrame, conf: Fit) -> DataFrame:
    """lang, text, h, d (the id) of the rows to learn from: at most per_language of each label."""
    rows = docs.where((remainder() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("bigint").alias("d"))
    # Few rows are ranked: those whose hash is small enough for about twice the sample, given how many there are.
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(2.0 * conf.per_language + 100) / F.col("n")).alias("share"))  # one row a label
    uniform = F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = cut(share)
    share = F.broadcast(share) if share.count() <= MOST_SENT else share
    thin = rows.join(share, "lang").where(uniform < F.col("share"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "d"))
    return thin.withColumn("nth", nth).where(F.col("nth") <= conf.per_language).drop("nth", "share")


def learn(docs: DataFrame, conf: Fit | None = None) -> Model:
    """Fit on a bounded sample of the rows that may be learned from."""
    conf = conf or Fit()
    schema = "lang string, h bigint, d bigint, ids array<bigint>, counts array<bigint>"
    found = cut(sample(docs, conf).select("lang", "h", "d", "text").mapInArrow(_counted, schema))
    df = np.zeros(DIMENSIONS)
    for r in found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).collect():  # at most DIMENSIONS rows
        df[r["id"]] = r["n"]
    idf = _idf(df, found.count())

    def of_language(key, rows):
        rows = rows.sort_values(["h", "d"], kind="stable")
        centroids, held = fit_language(list(zip(rows["ids"], rows["counts"])), idf, conf)
        return pd.DataFrame({"lang": [key[0]], "centroids": [centroids.tobytes()], "held": [held.tobytes()]})

    told = cut(found.groupBy("lang").applyInPandas(of_language, "lang string, centroids binary, held binary"))
    names = [r["lang"] for r in told.select("lang").orderBy("lang").collect()]
    context, blocks, held = docs.sparkSession.sparkContext, [], []
    # The driver holds one block of labels at a time; each goes to the executors as a broadcast of its own.
    for first in range(0, len(names), conf.block_labels):
        some = names[first : first + conf.block_labels]
        rows = told.where((F.col("lang") >= some[0]) & (F.col("lang") <= some[-1])).orderBy("lang").collect()
        blocks.append(context.broadcast(_block(first, [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMENSIONS) for r in rows])))
        held += [np.frombuffer(r["held"], np.float64).reshape(-1, 2) for r in rows]
    return Model(names, idf, blocks, limits(np.concatenate(held) if held else np.empty(0), conf))


def _parts(batch: pa.RecordBatch, rows: int = 64) -> Iterator[list[str | None]]:
    """Texts of a batch, few at a time, since their counts are held together."""
    for at in range(0, batch.num_rows, rows):
        yield batch.column("text").slice(at, rows).to_pylist()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [x for part in _parts(b) for x in model.predict_all(part)]
            columns = [b.column("doc_id"), b.column("held_out"), *map(pa.array, ([x[0] for x in told], [x[1] for x in told], [x[2] for x in told]))]
            kinds = [None, None, pa.string(), pa.float64(), pa.bool_()]
            columns = [c if k is None else c.cast(k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, conf: Fit | None = None) -> DataFrame:
    return predict(docs, learn(docs, conf))


def keep_identified(docs: DataFrame, conf: Fit | None = None) -> DataFrame:
    """The rows of `docs` whose language is not rejected, in one pass over the text and without a shuffle."""
    model = learn(docs, conf)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays = pa.array([not x[2] for part in _parts(b) for x in model.predict_all(part)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(stays) for c in b.columns], names=names)

    return docs.mapInArrow(run, schema)
