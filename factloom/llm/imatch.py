"""I-Match document fingerprints.

Terms are the distinct runs of letters and digits of a lower-cased text, told apart by 60 bits of their keyed MD5. A first pass
counts exactly, by a shuffle of term hashes combined before it, in how many documents each term occurs. The lexicon is the terms
whose share of documents, and so inverse document frequency, lies in the band [`rarest`, `commonest`]. A document has a bounded
number of distinct terms on average, so at most (that number / `rarest`) terms can be in the band, however large the corpus; if
they are more than `most_terms`, the lower end of the band is doubled until they aren't. The lexicon goes to the documents as one
Bloom filter of 16 to 32 bits a term and three probes (about one in 150 other terms passes, for every document alike).

A document's lexicon terms, distinct and sorted, meet randomised subsets of the lexicon, which overlap; the terms in a subset are
hashed together to 64 bits (the fingerprint has 16 hex digits each, nothing between dots where a document has no term of a subset):

* `dense` subsets keep three quarters of the lexicon each. Such a hash survives only if all terms that differ are outside of the subset.
* For graded likeness, `sparse` subsets at each of two densities, 2**-L and 2**-(L+1), where the document has at most 2**L
  lexicon terms: each then holds about a term of it, and survives an edit with the probability that this term does.

Likeness of two fingerprints, from 0 to 1: of the sparse subsets at densities that both have, the share s whose hashes agree among
those that are not empty in both estimates the Jaccard likeness of the terms; it is told as the share of common terms, 2s/(1+s). If
a share d > 0 of the dense hashes agree, likeness is (1+d)/2 at least. Documents whose numbers of terms differ by a factor of four
have no common density, and likeness 0 but for the dense hashes.

A document with fewer than `few` lexicon terms uses all its terms instead; one without any term has a hash of its text alone as
fingerprint, which is like (1) itself only. So texts that have nothing in the lexicon aren't all alike.

All of it is DataFrame functions. Texts move once, by id, to meet the head of the next document; order comes from a
range partitioning of the ids alone. Ids that hold more than `HOT_SHARE` of all rows (as null may) are salted by text.

Defined results: null text is empty. The next document is the one with the next smaller doc_id, after the smallest the
largest; where several rows share an id, the one whose head, then fingerprint, is smallest stands for it. A null doc_id counts as the
smallest bigint. Repeated rows get the same result. A single document is its own next one. Very long texts are read whole, in one
row each. An empty table gives no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import bound, cut, partitions, text_or_empty

_HALF = 1 << 63
HOT_SHARE = 0.001
_SHIFTS = (0, 16, 32)  # of the probes of the Bloom filter
_DRAWS = (16, 38)  # of the two sparse subsets that a term is drawn for; the dense ones use the bits below
_LEAST_LEVEL, _MOST_LEVEL = 3, 17


@dataclass(frozen=True)
class Lexicon:
    rarest: float = 0.0005
    commonest: float = 0.2
    most_terms: int = 1 << 20
    dense: int = 4  # at most 8
    few: int = 3
    seed: int = 7


SPARSE = 16


def term_hashes(text: Column, lex: Lexicon) -> Column:
    """array<bigint>: 60-bit hashes of the distinct terms, sorted."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")
    hashed = lambda w: F.conv(F.left(F.md5(F.concat(F.lit(f"{lex.seed}:"), w).cast("binary")), F.lit(15)), 16, 10).cast("bigint")
    return F.sort_array(F.array_distinct(F.transform(words, hashed)))


def lexicon(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """h: the terms in the band, of `docs` with a column text."""
    terms = docs.select(F.explode(term_hashes(F.col("text"), lex)).alias("h"))
    n = docs.count()
    low, high = max(lex.rarest * n, 2.0), max(lex.commonest * n, 2.0)
    inside = cut(terms.groupBy("h").agg(F.count("*").alias("df")).where((F.col("df") >= low) & (F.col("df") <= high)))
    while inside.where(F.col("df") >= low).count() > lex.most_terms:
        low *= 2
    return inside.where(F.col("df") >= low).select("h")


def bitmap(terms: DataFrame) -> tuple[DataFrame, int]:
    """One row: array<bigint> of a Bloom filter's bits; and the number of the bits' addresses, a power of two."""
    size = 1 << max(10, (16 * terms.count() - 1).bit_length())
    at = F.explode(F.array(*[F.shiftright("h", s).bitwiseAND(size - 1) for s in _SHIFTS]))
    words = terms.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bits"))
    blank = terms.sparkSession.range(size >> 6).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    whole = words.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bitmap")), size


def fingerprint(text: Column, bits: Column, size: int, lex: Lexicon) -> Column:
    """struct<level, hashes>: hashes of the dense subsets, then of the sparse ones at level and level + 1; level -1 has the text's only."""
    told = lambda some: bound(some, lambda part: F.when(F.size(part) == 0, "").otherwise(F.left(F.md5(F.array_join(part.cast("array<string>"), ",").cast("binary")), F.lit(16))))

    def known(h: Column) -> Column:
        hit = F.lit(True)
        for s in _SHIFTS:
            p = F.shiftright(h, s).bitwiseAND(size - 1)
            hit = hit & (F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)
        return hit

    def hashed(own: Column, level: Column) -> Column:
        dense = [told(F.filter(own, lambda h: F.shiftright(h, 2 * j).bitwiseAND(3) != 0)) for j in range(lex.dense)]
        drawn = lambda h, s, m: F.shiftright(h, s).bitwiseAND(m)

        def sparse(few: Column, m: Column) -> Column:
            hit = lambda h, j: (drawn(h, _DRAWS[0], m) == j) | (drawn(h, _DRAWS[1], m) == j)
            return F.transform(F.sequence(F.lit(0), F.lit(SPARSE - 1)), lambda j: told(F.filter(few, lambda h: hit(h, j))))

        def both(span: Column) -> Column:
            few = F.filter(own, lambda h: (drawn(h, _DRAWS[0], span) < SPARSE) | (drawn(h, _DRAWS[1], span) < SPARSE))
            return bound(few, lambda few: F.concat(sparse(few, span), bound(span * 2 + 1, lambda m: sparse(few, m))))

        # The numbers of a term's draws are uniform in 2**(level + 1), of which the first SPARSE name a subset.
        span = F.call_function("shiftleft", F.lit(2).cast("bigint"), level) - 1
        return F.struct(level.alias("level"), F.concat(F.array(*dense), bound(span, both)).alias("hashes"))

    def levelled(own: Column) -> Column:
        n = F.size(own)
        level = F.when(n <= 1 << _LEAST_LEVEL, _LEAST_LEVEL).otherwise(F.least(F.length(F.bin(n - 1)), F.lit(_MOST_LEVEL)))
        return bound(level, lambda level: hashed(own, level))

    def used(terms: Column) -> Column:
        return bound(F.filter(terms, known), lambda inside: F.when(F.size(inside) >= lex.few, inside).otherwise(terms))

    nothing = F.struct(F.lit(-1).alias("level"), F.array(F.left(F.md5(text.cast("binary")), F.lit(16))).alias("hashes"))
    return bound(bound(term_hashes(text, lex), used), lambda own: F.when(F.size(own) == 0, nothing).otherwise(levelled(own)))


def likeness(a: Column, b: Column, lex: Lexicon) -> Column:
    def shares(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: F.when((p != "") | (q != ""), (p == q).cast("int")))
        return F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("same")),
            lambda s, p: F.struct((s["n"] + F.when(p.isNull(), 0).otherwise(1)).alias("n"), (s["same"] + F.coalesce(p, F.lit(0))).alias("same")),
            lambda s: s["same"] / F.greatest(s["n"], F.lit(1)),
        )

    part = lambda x, skip, n: F.slice(x["hashes"], lex.dense + 1 + skip, n)
    apart = b["level"] - a["level"]
    share = (
        F.when(apart == 0, shares(part(a, 0, 2 * SPARSE), part(b, 0, 2 * SPARSE)))
        .when(apart == 1, shares(part(a, SPARSE, SPARSE), part(b, 0, SPARSE)))
        .when(apart == -1, shares(part(a, 0, SPARSE), part(b, SPARSE, SPARSE)))
        .otherwise(F.lit(0.0))
    )
    dense = shares(F.slice(a["hashes"], 1, lex.dense), F.slice(b["hashes"], 1, lex.dense))
    graded = bound(F.struct(share.alias("s"), dense.alias("d")), lambda x: F.greatest(2 * x["s"] / (1 + x["s"]), F.when(x["d"] > 0, (1 + x["d"]) / 2).otherwise(F.lit(0.0))))
    either = (a["level"] < 0) | (b["level"] < 0)
    return F.when(either, ((a["level"] == b["level"]) & (a["hashes"] == b["hashes"])).cast("double")).otherwise(F.round(graded, 6))


def shown(fp: Column) -> Column:
    return F.concat_ws(":", fp["level"].cast("string"), F.array_join(fp["hashes"], "."))


def _next_ids(keys: DataFrame, n: int) -> DataFrame:
    """keys: k (distinct), n_chars -> (of, next_k, need), in descending order of k, and after the last the first."""
    ranged = keys.repartitionByRange(n, F.desc("k")).sortWithinPartitions(F.desc("k")).withColumn("part", F.spark_partition_id())
    rows = cut(ranged)
    inside = rows.withColumn("next_k", F.lead("k").over(Window.partitionBy("part").orderBy(F.desc("k"))))
    # At most one row per partition: the first id of the partitions that follow.
    firsts = rows.groupBy("part").agg(F.max("k").alias("first"))
    in_order = Window.orderBy("part")
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(in_order), F.first("first").over(everything)).alias("follows"))
    joined = inside.join(F.broadcast(after), "part")
    return joined.select(F.col("k").alias("of"), F.coalesce("next_k", "follows").alias("next_k"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))


def fingerprint_documents(docs: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    lex = lex or Lexicon()
    n = partitions(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-_HALF)).alias("k"), text_or_empty().alias("text"))
    bits, size = bitmap(lexicon(docs, lex))
    bits = cut(bits).scalar()
    keys = cut(docs.groupBy("k").agg(F.max(F.length("text")).alias("n_chars"), F.count("*").alias("rows")))
    most = (keys.agg(F.sum("rows")).first()[0] or 0) * HOT_SHARE
    hot = [r.k for r in keys.where((F.col("rows") > most) & (F.col("rows") > 1)).select("k").collect()]  # fewer than 1 / HOT_SHARE
    # Without a hot id there is no salt, so that both joins find the rows dealt out by id alone.
    on = ["k", "salt"] if hot else ["k"]

    def salted(df: DataFrame) -> DataFrame:
        every = F.when(F.col("k").isin(hot), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
        return df.withColumn("salt", F.explode(every)) if hot else df

    # A subquery may not stand inside a higher-order function, but a column that holds it may.
    printed = docs.withColumn("bits", bits).select("k", "text", fingerprint(F.col("text"), F.col("bits"), size, lex).alias("fp"))
    salt = F.when(F.col("k").isin(hot), F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).otherwise(F.lit(0))
    rows = (printed.withColumn("salt", salt) if hot else printed).repartition(n, *on)
    wanted = salted(_next_ids(keys.select("k", "n_chars"), n).withColumnRenamed("next_k", "k"))
    heads = rows.join(wanted, on).select("of", F.struct(F.left("text", F.col("need")).alias("head"), F.col("fp").alias("fp")).alias("next"))
    heads = salted(heads.groupBy("of").agg(F.min("next").alias("next")).withColumnRenamed("of", "k"))
    joined = rows.join(heads, on)
    n_chars = F.length("text")
    cut_off = F.floor(n_chars / 3).cast("int")
    edited = joined.select("k", "text", "fp", "next", F.concat(F.left("text", n_chars - cut_off), F.left("next.head", cut_off)).alias("edited"))
    edited = edited.withColumn("bits", bits)
    edited = edited.select("k", "text", "fp", "next", "edited", fingerprint(F.col("edited"), F.col("bits"), size, lex).alias("edited_fp"))
    return edited.select(
        F.when(F.col("k") != -_HALF, F.col("k")).alias("doc_id"),
        n_chars.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), lex).alias("near_edited"),
        likeness(F.col("fp"), F.col("next.fp"), lex).alias("near_next"),
    )


def oracle(lex: Lexicon | None = None) -> str:
    """DuckDB SQL for fingerprint_documents, for a band that holds at most `most_terms` terms."""
    lex = lex or Lexicon()
    told = lambda part: f"CASE WHEN len({part}) = 0 THEN '' ELSE left(md5(array_to_string({part}, ',')), 16) END"
    dense = ", ".join(told(f"list_filter(own, lambda h: ((h >> {2 * j}) & 3) <> 0)") for j in range(lex.dense))
    drawn = " OR ".join(f"((h >> {s}) & m) = j" for s in _DRAWS)
    sparse = lambda m: f"list_transform(range({SPARSE}), lambda j: {told('list_filter(own, lambda h: ' + drawn.replace('m)', m + ')') + ')')})"
    level = f"CASE WHEN len(own) <= {1 << _LEAST_LEVEL} THEN {_LEAST_LEVEL} ELSE least(length(bin(len(own) - 1)), {_MOST_LEVEL}) END"
    spots = lambda h, size: f"[{', '.join(f'({h} >> {s}) & ({size} - 1)' for s in _SHIFTS)}]"

    def share(x: str, y: str) -> str:
        places = f"range(1, len({x}) + 1)"
        same = f"len(list_filter({places}, lambda i: ({x})[i] = ({y})[i] AND ({x})[i] <> ''))"
        return f"({same} / greatest(len(list_filter({places}, lambda i: ({x})[i] <> '' OR ({y})[i] <> '')), 1))"

    def near(a: str, b: str) -> str:
        cut_of = lambda x, lo, hi: f"{x}.hashes[{lex.dense + 1 + lo}:{lex.dense + hi}]"
        s = f"""CASE {b}.level - {a}.level WHEN 0 THEN {share(cut_of(a, 0, 2 * SPARSE), cut_of(b, 0, 2 * SPARSE))}
            WHEN 1 THEN {share(cut_of(a, SPARSE, 2 * SPARSE), cut_of(b, 0, SPARSE))} WHEN -1 THEN {share(cut_of(a, 0, SPARSE), cut_of(b, SPARSE, 2 * SPARSE))} ELSE 0.0 END"""
        d = share(f"{a}.hashes[1:{lex.dense}]", f"{b}.hashes[1:{lex.dense}]")
        return f"CASE WHEN {a}.level < 0 OR {b}.level < 0 THEN ({a}.shown = {b}.shown)::INTEGER::DOUBLE ELSE round(greatest(2 * ({s}) / (1 + ({s})), CASE WHEN {d} > 0 THEN (1 + {d}) / 2 ELSE 0.0 END), 6)::DOUBLE END"

    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::BIGINT, {-_HALF}) AS k, row_number() OVER () AS rid FROM documents
        ), keys AS (SELECT k, max(length(t)) AS n FROM d GROUP BY k
        ), wanted AS (SELECT k AS of_k, coalesce(lead(k) OVER (ORDER BY k DESC), max(k) OVER ()) AS k, n // 3 AS need FROM keys
        ), heads AS (
            SELECT of_k, arg_min(t, left(t, need)) AS next_t, min(left(t, need)) AS head FROM d JOIN wanted USING (k) GROUP BY of_k
        ), v AS (
            SELECT d.*, next_t, left(t, length(t) - length(t) // 3) || left(head, length(t) // 3) AS e FROM d JOIN heads ON of_k = d.k
        ), texts AS (SELECT t FROM v UNION SELECT e FROM v UNION SELECT next_t FROM v
        ), w AS (
            SELECT t, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: ('0x' || left(md5('{lex.seed}:' || x), 15))::BIGINT))) AS terms FROM texts
        ), df AS (SELECT h, count(*) AS df FROM (SELECT unnest(terms) AS h FROM v JOIN w USING (t)) GROUP BY h
        ), n AS (SELECT greatest({lex.rarest} * count(*), 2.0) AS low, greatest({lex.commonest} * count(*), 2.0) AS high FROM d
        ), lexicon AS (SELECT h FROM df, n WHERE df >= low AND df <= high
        ), z AS (SELECT 1::BIGINT << greatest(10, CASE WHEN count(*) = 0 THEN 10 ELSE length(bin(16 * count(*) - 1)) END)::BIGINT AS size FROM lexicon
        ), spots AS (SELECT DISTINCT unnest({spots("h", "size")}) AS spot FROM lexicon, z
        ), seen AS (SELECT DISTINCT unnest(terms) AS h FROM w
        ), known AS (SELECT h FROM seen, z WHERE {" AND ".join(f"((h >> {s}) & (size - 1)) IN (SELECT spot FROM spots)" for s in _SHIFTS)}
        ), inside AS (SELECT t, list(h ORDER BY h) AS inside FROM (SELECT t, unnest(terms) AS h FROM w) JOIN known USING (h) GROUP BY t
        ), o AS (SELECT w.t, CASE WHEN len(inside) >= {lex.few} THEN inside ELSE terms END AS own FROM w LEFT JOIN inside USING (t)
        ), f AS (
            SELECT t, level, CASE WHEN level < 0 THEN [left(md5(t), 16)] ELSE list_concat([{dense}], list_concat({sparse("((2::BIGINT << level) - 1)")}, {sparse("((4::BIGINT << level) - 1)")})) END AS hashes
            FROM (SELECT *, CASE WHEN len(own) = 0 THEN -1 ELSE {level} END AS level FROM o)
        ), p AS (SELECT *, level || ':' || array_to_string(hashes, '.') AS shown FROM f)
        SELECT v.doc_id, length(v.t)::BIGINT AS n_chars, sha256(v.e) AS edited_sha256, a.shown AS fingerprint, b.shown AS edited_fingerprint,
               {near("a", "b")} AS near_edited, {near("a", "c")} AS near_next
        FROM v JOIN p a ON a.t = v.t JOIN p b ON b.t = v.e JOIN p c ON c.t = v.next_t"""
