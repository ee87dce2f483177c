"""SimHash near-duplicates through Gray-order hierarchical indexes.

Fingerprints: lower-case A-Z, words are runs of non-space, 4-word shingles (fewer words: the whole sequence;
none: fingerprint zero), XXH64 with seed 42 of each shingle, and a bit is 1 if set in over half of the hashes.

Links: two fingerprints are linked at 4 or fewer differing bits. The search for links is exact:

* The 64 bits are cut into blocks. Two fingerprints within distance 4 agree on one of 5 blocks at least (or on
  two of 6, three of 7, ... for larger tables: `key_blocks`). So each distinct fingerprint goes to one bucket for
  each choice of blocks, named by those blocks' bits; that shared pattern is a bucket's upper index node.
* In a bucket, fingerprints are sorted by Gray rank. Runs of the sorted order become nodes; a node has the mask of
  the bits that all its members share and their common pattern. Runs of nodes become upper nodes, whose mask is
  factored out of the nodes below, so a search adds up differences on the way down, and drops a whole group as
  soon as the sum exceeds 4. A group is taken whole, without looking at its members, if the differences so far and
  its free bits together can't exceed 4, and skipped if it is already connected to the searcher.
* A bucket larger than `most` fingerprints is dealt out as pairs of chunks, so that no task needs a bucket and no
  pair is lost.

A bucket returns a spanning forest of its links, not all its pairs, so a group of n near copies gives at most n
edges per bucket. Connected components of the edges come from alternating large-star and small-star steps, each
of which aggregates minima with map-side combining and is cut by a checkpoint; nothing is collected.

Nulls: a null text has no words. A null doc_id counts as no id: a component's id is its smallest non-null doc_id,
null if it has none. Repeated rows get the same result; an empty table gives none. Very long texts are hashed whole, shingle by shingle.
`near_duplicates` ignores other columns; `drop_near_copies` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import unused
from factloom.llm.common import cut, join_hot, partitions

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
_UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes that are counted at once, which bounds memory for texts of any length.
_AT_ONCE = 1 << 16


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().translate(_UPPER_TO_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _AT_ONCE):
        to = min(n, at + _AT_ONCE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to], stops[at:to])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
        columns = [b.column("doc_id"), b.column("mark"), pa.array(found.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp): fp has the 64 bits as a signed bigint; mark tells texts of one doc_id apart."""
    plain = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), F.col("text"))
    return plain.mapInArrow(_fingerprint_batches, "doc_id bigint, mark bigint, fp bigint")


# ---------------------------------------------------------------- the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the binary-reflected Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Nodes over fingerprints of several buckets; a searcher enters at its own bucket's root.

    levels[0] are single fingerprints, levels[-1] the buckets. Each level has, by node: the first and last+1 node
    below, the residual mask (shared bits that the node above doesn't share), the pattern, and the free bits.
    """

    FAN = 8

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        """bucket: non-decreasing numbers; fp: sorted by Gray rank in each bucket."""
        n = len(fp)
        ones = np.full(n, ~np.uint64(0))
        self.levels = [(np.arange(n), np.arange(n) + 1, ones, fp)]
        group = bucket
        while len(group) > 1:
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            sizes = np.diff(np.append(first, len(group)))
            if (sizes == 1).all():
                break
            at = np.arange(len(group)) - np.repeat(first, sizes)
            starts = np.flatnonzero(at % self.FAN == 0)
            mask, pattern = self.levels[-1][2], self.levels[-1][3]
            head = np.repeat(pattern[starts], np.diff(np.append(starts, len(group))))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ head), starts)
            self.levels.append((starts, np.append(starts[1:], len(group)), shared, pattern[starts] & shared))
            group = group[starts]
        self.roots = group
        self.free = [(BITS - np.bitwise_count(m)).astype(np.int64) for _, _, m, _ in self.levels]
        # Residual masks: what the node above already compares is not compared again.
        self.residual = []
        for k, (_, _, mask, _) in enumerate(self.levels):
            if k + 1 < len(self.levels):
                a, b, above, _ = self.levels[k + 1]
                mask = mask & ~np.repeat(above, b - a)
            self.residual.append(mask)

    def search(self, query: np.ndarray, root: np.ndarray, skip, took, most: int = 1 << 20) -> None:
        """Calls took(level, query rows, nodes) for groups that are taken whole, single leaves included.

        skip(level, query rows, nodes) marks pairs that need no search. At most about `most` pairs of a searcher
        and a node are held for each level at once.
        """
        held = [(len(self.levels) - 1, np.arange(len(query)), root, np.zeros(len(query), np.int64))]
        while held:
            k, rows, nodes, far = held.pop()
            keep = ~skip(k, rows, nodes)
            rows, nodes, far = rows[keep], nodes[keep], far[keep]
            far = far + np.bitwise_count((query[rows] ^ self.levels[k][3][nodes]) & self.residual[k][nodes])
            near = far <= DISTANCE
            whole = near & (far + self.free[k][nodes] <= DISTANCE)
            if whole.any():
                took(k, rows[whole], nodes[whole])
            rest = near & ~whole
            if k == 0 or not rest.any():
                continue
            rows, nodes, far = rows[rest], nodes[rest], far[rest]
            step = max(1, most // self.FAN)
            for at in range(0, len(rows), step):
                r, v, d = rows[at : at + step], nodes[at : at + step], far[at : at + step]
                first, n = self.levels[k][0][v], self.levels[k][1][v] - self.levels[k][0][v]
                held.append((k - 1, np.repeat(r, n), _spread(first, n), np.repeat(d, n)))


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (size[0] of them), first[1], ..."""
    return np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join components; parent holds each element's smallest known one and ends fully compressed."""
    while True:
        x, y = parent[a], parent[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def spanning_edges(bucket: np.ndarray, fp: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Edges (of fingerprints) of a forest that spans all links inside each bucket."""
    order = np.lexsort((gray_rank(fp), bucket))
    bucket, fp = bucket[order], fp[order]
    fresh = np.ones(len(fp), bool)
    fresh[1:] = (bucket[1:] != bucket[:-1]) | (fp[1:] != fp[:-1])
    bucket, fp = bucket[fresh], fp[fresh]
    index, n = GrayIndex(bucket, fp), len(fp)
    parent = np.arange(n)
    spans = [(np.arange(n), np.arange(n) + 1)]  # of leaves, by level
    for a, b, _, _ in index.levels[1:]:
        lo, hi = spans[-1]
        spans.append((lo[a], hi[b - 1]))
    # Groups whose members can't differ by more than DISTANCE are components from the start.
    for k in range(1, len(index.levels)):
        near = index.free[k] <= DISTANCE
        lo, size = spans[k][0][near], (spans[k][1] - spans[k][0])[near]
        _union(parent, np.repeat(lo, size), _spread(lo, size))
    root_of = np.searchsorted(index.roots, bucket)
    at, wide = 0, 32  # a few searchers first: in a dense group they join nearly all that follow
    while at < n:
        q = np.arange(at, min(n, at + wide))
        at, wide = at + wide, min(block, wide * 4)
        uniform = [parent.copy()]  # a node's component, or -1 if its leaves are in several
        for a, _, _, _ in index.levels[1:]:
            lo, hi = np.minimum.reduceat(uniform[-1], a), np.maximum.reduceat(uniform[-1], a)
            uniform.append(np.where(lo == hi, lo, -1))

        # No search in groups that end before the searcher, as links are found from either side, nor in its component.
        def skip(k, rows, nodes, q=q, uniform=uniform):
            return (spans[k][1][nodes] <= q[rows] + 1) | (uniform[k][nodes] == uniform[0][q[rows]])

        def took(k, rows, nodes, q=q):
            lo, size = spans[k][0][nodes], (spans[k][1] - spans[k][0])[nodes]
            _union(parent, np.repeat(q[rows], size), _spread(lo, size))

        index.search(fp[q], root_of[q], skip, took)
    linked = parent != np.arange(n)
    return fp[parent[linked]], fp[linked]


def _edge_batches(batches: Iterator[pa.RecordBatch], least: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; whole buckets are searched together, many small ones at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    names = ["a", "b"]

    def edges(parts):
        keys = [np.concatenate(x) for x in zip(*parts)]
        fp = keys.pop().view(np.uint64)
        change = np.zeros(len(fp), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        a, b = spanning_edges(np.cumsum(change), fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("table", "bits", "chunk", "fp")))
        if sum(len(h[0]) for h in held) < least:
            continue
        merged = [np.concatenate(x) for x in zip(*held)]
        last = np.ones(len(merged[0]), bool)
        for k in merged[:3]:
            last &= k == k[-1]
        whole = int(np.argmax(last))  # the last bucket may go on
        if whole:
            yield edges([tuple(m[:whole] for m in merged)])
        held = [tuple(m[whole:] for m in merged)]
    if held and len(held[0][0]):
        yield edges(held)


def key_blocks(rows: int) -> list[tuple[int, int]]:
    """(mask as shift/width list) choice: 5 blocks and one of them while buckets stay small, then more blocks."""
    spare = 1
    while spare < 4 and rows >> (BITS * spare // (DISTANCE + spare)) > 1 << 13:
        spare += 1
    n = DISTANCE + spare
    edges = [BITS * k // n for k in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, spare)]


def links(distinct: DataFrame, rows: int, most: int = 1 << 15) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, which span all links of DISTANCE bits or fewer."""
    spark = distinct.sparkSession
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(key_blocks(rows))])
    keyed = distinct.select("fp", F.explode(tables).alias("k")).select("k.table", "k.bits", "fp")
    # Buckets above `most` are cut into chunks, and each fingerprint goes to every pair of chunks that has its own.
    large = keyed.groupBy("table", "bits").agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = large.select(F.col("table").alias("t"), F.col("bits").alias("v"), F.ceil(F.col("n") / most).cast("int").alias("chunks"))
    chunked = keyed.join(large, (keyed["table"] == large["t"]) & (keyed["bits"] == large["v"]), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = chunked.select("table", "bits", "fp", "chunks", own.alias("own"), other.alias("other"))
    pair = F.when(F.col("chunks").isNull(), F.lit(-1)).otherwise(F.least("own", "other") * 65536 + F.greatest("own", "other"))
    dealt = dealt.select("table", "bits", pair.cast("int").alias("chunk"), "fp")
    spread = dealt.repartition(partitions(spark), "table", "bits", "chunk").sortWithinPartitions("table", "bits", "chunk")
    return spread.mapInArrow(_edge_batches, "a bigint, b bigint").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of all nodes that have an edge; root is the smallest node that is reachable."""

    def told(df):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = told(edges)
    for _ in range(rounds):
        # large-star: each node sends its larger neighbours to its smallest neighbour, or to itself
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = join_hot(both, least, "u", "n").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = cut(large)
        # small-star: each node sends its smaller neighbours, and itself, to the smallest of them
        sent = join_hot(large, cut(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))), "b", "n")
        small = sent.select(F.col("m").alias("a"), F.col("a").alias("b")).union(sent.select(F.col("m").alias("a"), "b"))
        edges = cut(small.where("a <> b").distinct())
        if (after := told(edges)) == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after
    raise RuntimeError("components didn't settle")


def with_components(prints: DataFrame) -> DataFrame:
    """(doc_id, mark, fp) -> the same with root (a fingerprint) and component_id. `prints` is read several times."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    roots = components(links(distinct.select("fp"), distinct.count()))
    rooted = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")))
    by_fp = cut(join_hot(rooted.select("fp", "rows", "root"), named, "root", "prints"))
    return join_hot(prints, by_fp, "fp", "rows").select("doc_id", "mark", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The thin result: doc_id, fingerprint (16 hex digits), component_id."""
    found = with_components(cut(fingerprints(docs)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component stays: one with its smallest doc_id (rows without an id are last)."""
    id_name, mark = keys = unused(docs.columns, "id", "mark")
    last = F.lit((1 << 63) - 1)
    found = with_components(cut(fingerprints(docs)))
    keep = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "mark")).alias("k"))
    keep = keep.select(F.col("k.id").alias(id_name), F.col("k.mark").alias(mark)).distinct()
    rows = docs.withColumns({id_name: F.coalesce(F.col("doc_id").cast("bigint"), last), mark: F.xxhash64("text")})
    # Repeated rows meet in every task before they are shuffled.
    order = F.struct(F.col("text").isNull().alias("none"), "text")
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return one.join(keep, keys, "left_semi").select("row.*")
