"""Source divergence audit: how far the sources of a language are from each other, and which terms set one apart from its language.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z in lower case. A language keeps the terms that at least `least_documents`
of its documents have: V of them. A group is a language and a source; a group, and a language, gives each kept term the share
p = 1 + floor(10^9 (count + 1) / (N + V)) with N the group's occurrences of all kept terms. One share p against another one q costs
f = floor((p - q)^2 / q), in whole numbers throughout.

The sum of f over all V kept terms, for two sources of a language, is taken by inclusion and exclusion over the terms that each of them has, so that no
table of groups times terms is made:

* constants: both counts are zero for every term to begin with, V f(p0, q0);
* histograms: the terms of one side depend on their count alone. A group's histogram of counts, priced against the other group's share of
  an absent term, adds k (f(p, q0) - f(p0, q0)) for the k terms with that count, and the other way round;
* postings: a join of the groups that have a term finds the overlaps, and puts f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) right.

The ranks of `term` run only over terms that a group has, for which p > q.

Counting combines in each input task, whose table is bounded and written out when full; counts then meet by (language, term), so a hot source or language is spread by its
terms, and a frequent term has a row per group and task. Postings of a term are as many as a language's sources. The result has a row for each two sources of a language, by
its contract. Tables with a row a group are broadcast up to `broadcast_groups` groups; beyond that hot groups are, and others are shuffled.

Defined results: null text, language or source counts as ''. A group without terms, or a language without kept terms (V = 0), has value 0 with every other
source. Repeated rows are documents of their own. Ties go by the item's UTF-8 bytes. Very long texts are counted whole. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, join_hot

_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B)]
#: What ends a term becomes a space, capitals become small letters, bytes beyond ASCII stay.
_FOLDED = bytes((b | 0x20) if b in _LETTERS else b if b >= 0x80 else 0x20 for b in range(256))
_HELD = 300_000  # terms of groups that a task counts before it writes them out
_SCALE = 1_000_000_000


@dataclass(frozen=True)
class Audit:
    least_documents: int = 3
    top_terms: int = 200
    broadcast_groups: int = 50_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents), possibly in several rows. Every group also has a row of the term ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in groups.items():
                terms, size = [*n, b""], len(n) + 1
                columns = [[lang] * size, [source] * size, [t.decode() for t in terms], [*n.values(), 0], [*map(df.__getitem__, n), 0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2)], names=["lang", "source", "term", "n", "df"])
            groups.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                if (lang, source) not in groups:
                    groups[lang, source] = Counter(), Counter()
                n, df = groups[lang, source]
                terms = text.as_py().translate(_FOLDED).split()
                before = len(n)
                n.update(terms)
                df.update(set(terms))
                held += len(n) - before
                if held >= _HELD:
                    yield from told()
                    held = 0
        yield from told()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*named).mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")


def postings(docs: DataFrame, audit: Audit) -> DataFrame:
    """lang, source, term, n, lang_n (of all sources), lead (1 in one row of each kept term). Rows of the term '' name the groups."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    same = Window.partitionBy("lang", "term")
    told = counts.withColumns({
        "lang_n": F.sum("n").over(same), "lang_df": F.sum("df").over(same), "lead": (F.row_number().over(same.orderBy("source")) == 1).cast("int"),
    })
    kept = told.where((F.col("term") == "") | (F.col("lang_df") >= audit.least_documents))
    return kept.select("lang", "source", "term", "n", "lang_n", F.when(F.col("term") == "", 0).otherwise(F.col("lead")).alias("lead"))


def share(n: Column, whole: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (whole + kept)), in decimals since the product can outgrow 64 bits; null if there is nothing to share."""
    wide = lambda c: c.cast("decimal(19,0)")
    below = wide(whole + kept)
    product = F.lit(_SCALE).cast("decimal(10,0)") * wide(n + 1)
    return F.when(whole + kept > 0, F.call_function("div", product, below) + 1)


def cost(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, audit: Audit | None = None) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    audit = audit or Audit()
    table = cut(postings(docs, audit))
    stats = table.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("rows"), F.sum("lead").alias("leads"))
    langs = stats.groupBy("lang").agg(F.sum("own_n").alias("all_n"), F.sum("leads").alias("kept"))
    groups = cut(
        stats.join(langs, "lang").select("lang", "source", "own_n", "all_n", "kept", "rows", share(F.lit(0), F.col("own_n"), F.col("kept")).alias("p0"))
    )
    few = groups.count() <= audit.broadcast_groups

    def of_group(rows: DataFrame) -> DataFrame:
        if few:
            return rows.join(F.broadcast(groups.drop("rows")), ["lang", "source"])
        key = F.struct("lang", "source").alias("g")
        return join_hot(rows.select("*", key), groups.select(key, "own_n", "all_n", "kept", "p0", "rows"), "g", "rows").drop("g")

    own = table.where("term <> ''")
    priced = of_group(own).withColumn("p", share(F.col("n"), F.col("own_n"), F.col("kept")))
    group = ["lang", "source"]

    # The two groups of a pair: its own share is p, the item's is q.
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    others = F.broadcast(others) if few else others
    c = F.col
    none = cost(c("p0"), c("q0"))
    constants = groups.join(others, "lang").where("source <> item").select(*group, "item", F.coalesce(c("kept") * none, F.lit(0)).alias("value"))
    histogram = of_group(own.groupBy(*group, "n").agg(F.count("*").alias("k"))).withColumn("p", share(c("n"), c("own_n"), c("kept")))
    sides = histogram.join(others, "lang").where("source <> item")
    one_sided = sides.select("lang", F.explode(F.array(
        F.struct(c("source"), c("item"), (c("k") * (cost(c("p"), c("q0")) - none)).alias("value")),
        F.struct(c("item").alias("source"), c("source").alias("item"), (c("k") * (cost(c("q0"), c("p")) - cost(c("q0"), c("p0")))).alias("value")),
    )).alias("x")).select("lang", "x.*")
    left = priced.select(*group, "term", "p", "p0")
    right = priced.select("lang", "term", c("source").alias("item"), c("p").alias("q"), c("p0").alias("q0"))
    both = left.join(right, ["lang", "term"]).where("source <> item")
    overlaps = both.select(*group, "item", (cost(c("p"), c("q")) - cost(c("p"), c("q0")) - cost(c("p0"), c("q")) + none).alias("value"))
    summed = [x.groupBy(*group, "item").agg(F.sum("value").alias("value")) for x in (one_sided, overlaps)]
    pairs = constants.union(summed[0]).union(summed[1]).groupBy(*group, "item").agg(F.sum("value").alias("value"))

    q = share(c("lang_n"), c("all_n"), c("kept"))
    terms = priced.withColumn("q", q).where("n > 0 and p > q").select(*group, c("term").alias("item"), cost(c("p"), c("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(c("value").desc(), "item"))
    told = lambda rows, part: rows.withColumn("rank", rank).withColumn("part", F.lit(part))
    out = told(pairs, "pair").unionByName(told(terms, "term").where(c("rank") <= audit.top_terms))
    return out.select("lang", "source", "part", "item", "value", "rank")


def oracle(audit: Audit | None = None) -> str:
    """DuckDB SQL for divergence(), which sums over the whole table of groups times terms."""
    audit = audit or Audit()
    share = lambda n, whole: f"(1 + ({_SCALE}::HUGEINT * ({n} + 1)) // ({whole} + v))"
    cost = "((p - q) * (p - q)) // q"
    ranked = lambda part: f"SELECT lang, source, '{part}' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM"
    return f"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM documents
        ), occ AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM occ GROUP BY ALL HAVING count(DISTINCT id) >= {audit.least_documents}),
        counts AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        langs AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = l.lang) AS v, (SELECT coalesce(sum(lang_n), 0) FROM kept k WHERE k.lang = l.lang) AS all_n FROM (SELECT DISTINCT lang FROM d) l),
        groups AS (
            SELECT g.lang, g.source, v, all_n, (SELECT coalesce(sum(n), 0) FROM counts c WHERE c.lang = g.lang AND c.source = g.source) AS own_n
            FROM (SELECT DISTINCT lang, source FROM d) g JOIN langs USING (lang)
        ), dense AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "own_n")} AS p, {share("lang_n", "all_n")} AS lp
            FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), sums AS (
            SELECT s.lang, s.source, t.source AS item, sum(((s.p - t.p) * (s.p - t.p)) // t.p) AS value
            FROM dense s JOIN dense t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL
        ), pairs AS (
            SELECT s.lang, s.source, t.source AS item, coalesce(value, 0) AS value
            FROM groups s JOIN groups t ON s.lang = t.lang AND s.source <> t.source
            LEFT JOIN sums x ON x.lang = s.lang AND x.source = s.source AND x.item = t.source
        ), terms AS (SELECT lang, source, term AS item, {cost} AS value FROM (SELECT *, lp AS q FROM dense) WHERE n > 0 AND p > q)
        SELECT * FROM ({ranked("pair")} pairs) UNION ALL SELECT * FROM ({ranked("term")} terms) WHERE rank <= {audit.top_terms}"""
