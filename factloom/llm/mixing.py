"""Mixing sources to target weights by iterative proportional fitting (raking).

Every document has a source, a language and a topic; the token totals of their combinations are the cells. Raking
scales the cells' totals, factor by factor, until each marginal (source, language, topic) has its target shares.
A document's probability is its cell's raked total over its cell's actual total; a keyed hash of its id draws against it. Raking starts
from the share `keep` of all tokens and never lets a cell have more than it holds, so the expected number of tokens is `keep` of the
corpus whatever the smallest cell is, no cell is upsampled, and the others make up for those that are used up. Where cells are used
up or missing, targets can be out of reach: `Plan.gap` tells by how much of all tokens the worst category misses its target, and a warning
is given above `most_gap`.

Targets are given as shares by category, or as a power: shares in proportion to (actual total)**power, where 1 keeps
the mix and 0 makes categories even. Every value of a factor is a category. Up to `driver_cells` cells are raked on the driver
and broadcast; beyond that the cells stay a table, raked by grouped sums and joins that are checkpointed, and are joined to the
documents by a shuffle but for the hot ones. Categories with a target share of 0 draw nothing; targets of categories that
have no tokens go to the others in proportion.

The topic is a column (`topic_column`) or, without one, the form of the whole text: `dense` if it has nine characters or more for each
word (code, links, tables of numbers), else `lines` if it has several lines with fewer than twelve words on average (lists, tables, verse),
else `prose`.

Defined results: a null source, language or topic is the category "(none)"; real values that begin like it, after any number of "=",
get one more "=" in front. A null or empty text has 0 tokens: such a document doesn't weigh,
and is drawn with its cell's probability (1 if its whole cell has no token). A null doc_id draws by its text.
Repeated rows draw alike. Very long texts are counted whole. An empty table gives no rows. Other columns are ignored by `mix_documents` and
returned as they are by `keep_mixed`, whatever their names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import unused
from factloom.llm.common import NOT_SPACE, bound, cut, join_hot, text_or_empty

FACTORS = ("source", "lang", "topic")
NONE = "(none)"
_NONE_LIKE = r"^=*\(none\)"


@dataclass(frozen=True)
class Mix:
    targets: dict = field(default_factory=lambda: {"source": 0.7, "lang": 0.7, "topic": 0.9})
    keep: float = 0.5  # share of all tokens that is drawn
    seed: str = "mix-1"
    topic_column: str | None = None
    driver_cells: int = 100_000
    rounds: int = 100
    tolerance: float = 1e-12  # change in a round, as a share of all tokens, at which raking ends
    most_gap: float = 0.01


def topic(text: Column, words: Column | None = None) -> Column:
    """The form of a text; words: its token_count(), if that's at hand. It is worked out once, however often it is compared."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    form = lambda n: F.when((n > 0) & (F.length(text) >= n * 9), "dense").when((lines > 1) & (n < lines * 12), "lines").otherwise("prose")
    return bound(token_count(text), form) if words is None else form(words)


def token_count(text: Column) -> Column:
    """Words, as runs of non-space: counted at their first characters."""
    return F.regexp_count(text, F.lit(f"(?<!{NOT_SPACE}){NOT_SPACE}")).cast("bigint")


def draw(key: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from a keyed hash."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _goals(codes: list[np.ndarray], totals: np.ndarray, targets: list[np.ndarray], whole: float) -> list[np.ndarray | None]:
    goals = []
    for code, t in zip(codes, targets):
        t = np.where(np.bincount(code, totals, len(t)) > 0, t, 0.0)
        goals.append(t / t.sum() * whole if t.sum() else None)
    return goals


def rake(codes: list[np.ndarray], totals: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-12, keep: float | None = None) -> np.ndarray:
    """Scale the cells' totals until each factor's sums are its targets' shares of the grand total, or of `keep` of it, where no cell may have
    more than its total. codes: for each factor, each cell's category as a number; memory is that of the cells and categories."""
    x = totals * (1.0 if keep is None else keep)
    whole = x.sum()
    if not whole:
        return x
    goals = _goals(codes, totals, targets, whole)
    for _ in range(rounds):
        before = x
        for code, t in zip(codes, goals):
            if t is None:
                continue
            now = np.bincount(code, x, len(t))
            x = x * np.divide(t, now, out=np.zeros_like(t), where=now > 0)[code]
            x = x if keep is None else np.minimum(x, totals)
        if np.abs(x - before).max() <= tolerance * whole:
            break
    return x


def gap(codes: list[np.ndarray], x: np.ndarray, totals: np.ndarray, targets: list[np.ndarray], whole: float) -> float:
    """By how much of all drawn tokens the worst category misses its target."""
    missed = [np.abs(np.bincount(c, x, len(t)) - t).max() for c, t in zip(codes, _goals(codes, totals, targets, whole)) if t is not None] if whole else []
    return float(max(missed, default=0.0)) / whole if whole else 0.0


def calibrate(cells: list[tuple], mix: Mix) -> tuple[list[tuple], float]:
    """(source, lang, topic, tokens) -> (source, lang, topic, probability), and the gap."""
    if not cells:
        return [], 0.0
    values = [sorted({c[k] for c in cells}) for k in range(3)]
    place = [{v: i for i, v in enumerate(vs)} for vs in values]
    codes = [np.array([place[k][c[k]] for c in cells]) for k in range(3)]
    totals = np.array([c[3] for c in cells], float)
    targets = []
    for k, name in enumerate(FACTORS):
        given = mix.targets.get(name, 1.0)
        if isinstance(given, dict):
            targets.append(np.array([float(given.get(v, 0.0)) for v in values[k]]))
        else:
            sums = np.bincount(codes[k], totals, len(values[k]))
            targets.append(np.where(sums > 0, sums, 1.0) ** given * (sums > 0))
    raked = rake(codes, totals, targets, mix.rounds, mix.tolerance, mix.keep)
    chances = np.divide(raked, totals, out=np.ones_like(raked), where=totals > 0)
    return [(*c[:3], p) for c, p in zip(cells, chances.tolist())], gap(codes, raked, totals, targets, totals.sum() * mix.keep)


def calibrate_frame(cells: DataFrame, mix: Mix) -> tuple[DataFrame, float]:
    """calibrate() for more cells than the driver should hold. cells: the factors, n_tokens; materialised."""
    whole = (cells.agg(F.sum("n_tokens")).first()[0] or 0) * mix.keep
    x = cells.withColumn("x", F.col("n_tokens") * F.lit(mix.keep))
    if not whole:
        return cells.withColumn("probability", F.lit(1.0)), 0.0
    goals = {}
    for f in FACTORS:
        given = mix.targets.get(f, 1.0)
        sums = cells.groupBy(f).agg(F.sum("n_tokens").cast("double").alias("g")).where("g > 0")
        if isinstance(given, dict):
            told = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{f} string, t double")
            wanted = sums.select(f).join(told, f, "left").select(f, F.coalesce("t", F.lit(0.0)).alias("t"))
        else:
            wanted = sums.select(f, F.pow("g", F.lit(float(given))).alias("t"))
        wanted = cut(wanted)
        total = wanted.agg(F.sum("t")).first()[0]
        if total:
            goals[f] = wanted.withColumn("t", F.col("t") * F.lit(whole / total))
    scales = lambda x, f: x.groupBy(f).agg(F.sum("x").alias("now"), F.count("*").alias("n")).join(goals[f], f, "left")
    for _ in range(mix.rounds):
        x = x.withColumn("before", F.col("x"))
        for f in goals:
            scale = cut(scales(x, f).select(f, "n", F.coalesce(F.when(F.col("now") > 0, F.col("t") / F.col("now")), F.lit(0.0)).alias("scale")))
            x = join_hot(x, scale, f, "n")
            x = cut(x.withColumn("x", F.least(F.col("x") * F.col("scale"), F.col("n_tokens").cast("double"))).drop("scale"))
        if x.agg(F.max(F.abs(F.col("x") - F.col("before")))).first()[0] <= mix.tolerance * whole:
            break
    missed = max((scales(x, f).agg(F.max(F.abs(F.col("now") - F.coalesce("t", F.lit(0.0))))).first()[0] / whole for f in goals), default=0.0)
    return cut(x.select(*FACTORS, F.when(F.col("n_tokens") > 0, F.col("x") / F.col("n_tokens")).otherwise(1.0).alias("probability"), "rows")), missed


def factors(topic_column: str | None = None, words: Column | None = None) -> dict[str, Column]:
    def category(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(F.when(value.rlike(_NONE_LIKE), F.concat(F.lit("="), value)).otherwise(value), F.lit(NONE))

    return {"source": category("source"), "lang": category("lang"), "topic": category(topic_column) if topic_column else topic(text_or_empty(), words)}


def draw_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text_or_empty().cast("binary"))))


class Plan:
    """What a corpus and a Mix come to: each cell's probability, and the gap that is left."""

    def __init__(self, weighed: DataFrame, mix: Mix):
        """weighed: source, lang, topic, n_tokens; read once."""
        cells = cut(weighed.groupBy(*FACTORS).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows")))
        self.small = cells.count() <= mix.driver_cells
        if self.small:
            told, self.gap = calibrate(sorted(tuple(r)[:4] for r in cells.collect()), mix)
            self.table = weighed.sparkSession.createDataFrame(told, "source string, lang string, topic string, probability double")
        else:
            self.table, self.gap = calibrate_frame(cells, mix)
        if self.gap > mix.most_gap:
            warnings.warn(f"a category misses its target by {self.gap:.3f} of all drawn tokens", stacklevel=3)

    def applied(self, rows: DataFrame, values: dict[str, Column], name: str) -> DataFrame:
        """`rows` with a column `name`; `values` gives the factors."""
        key, n = unused([*rows.columns, name], "cell", "rows")
        # Never null, so that the join adds no test for that, which would work out the factors of each row once more.
        cell = lambda columns: F.coalesce(F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()])), F.lit(""))
        keyed = rows.withColumn(key, cell(values))
        own = {n: F.col(n) for n in FACTORS}
        table = self.table.select(cell(own).alias(key), F.col("probability").alias(name), *([] if self.small else [F.col("rows").alias(n)]))
        return keyed.join(F.broadcast(table), key) if self.small else join_hot(keyed, table, key, n)


def mix_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """One row per row: doc_id, source, lang, topic, n_tokens, probability, selected."""
    mix = mix or Mix()
    named = {n: c.alias(n) for n, c in factors(mix.topic_column).items()}
    rows = cut(docs.select("doc_id", *named.values(), token_count(text_or_empty()).alias("n_tokens"), draw_key().alias("draw_key")))
    out = Plan(rows, mix).applied(rows, {n: F.col(n) for n in FACTORS}, "__probability")
    drawn = draw(F.col("draw_key"), mix.seed) < F.col("__probability")
    return out.select("doc_id", *FACTORS, "n_tokens", F.round("__probability", 6).alias("probability"), drawn.alias("selected"))


def keep_mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The rows of `docs` that are drawn, with their columns. The text isn't shuffled while the cells are few."""
    mix = mix or Mix()
    drawn, chance, n = unused(docs.columns, "draw", "probability", "n")
    if mix.topic_column:
        weighed = docs.select(*[c.alias(f) for f, c in factors(mix.topic_column).items()], token_count(text_or_empty()).alias("n_tokens"))
    else:
        counted = docs.withColumn(n, token_count(text_or_empty()))
        weighed = counted.select(*[c.alias(f) for f, c in factors(words=F.col(n)).items()], F.col(n).alias("n_tokens"))
    rows = docs.withColumn(drawn, F.coalesce(draw(draw_key(), mix.seed), F.lit(1.0)))
    kept = Plan(weighed, mix).applied(rows, factors(mix.topic_column), chance)
    return kept.where(F.col(drawn) < F.col(chance)).select(*docs.columns)


def oracle(mix: Mix | None = None) -> str:
    """DuckDB SQL for mix_documents with powers as targets: raking is a recursive query, one factor a step."""
    mix = mix or Mix()
    t = "coalesce(text, '')"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    words, lines = f"len(regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+'))", f"(length({t}) - length(replace({t}, chr(10), '')) + 1)"
    category = lambda c: f"coalesce(CASE WHEN regexp_matches({c}, {quoted(_NONE_LIKE)}) THEN '=' || {c} ELSE {c} END, '{NONE}')"
    factor = "CASE step % 3 WHEN 0 THEN ts / ss WHEN 1 THEN tl / sl ELSE tt / st END"
    goals = ", ".join(f"g{n[0]} AS (SELECT {n}, pow(sum(n), {mix.targets[n]}) AS g FROM cells GROUP BY {n} HAVING sum(n) > 0)" for n in FACTORS)
    whole = f"(SELECT sum(n) * {mix.keep} FROM cells)"
    return f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, {category("source")} AS source, {category("lang")} AS lang,
                   CASE WHEN {words} > 0 AND length({t}) >= {words} * 9 THEN 'dense' WHEN {lines} > 1 AND {words} < {lines} * 12 THEN 'lines' ELSE 'prose' END AS topic,
                   {words} AS n_tokens,
                   ('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, 'text:' || md5({t}))), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE AS u
            FROM documents
        ), cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL), {goals},
        start AS (
            SELECT c.*, gs.g / (SELECT sum(g) FROM gs) * {whole} AS ts, gl.g / (SELECT sum(g) FROM gl) * {whole} AS tl, gt.g / (SELECT sum(g) FROM gt) * {whole} AS tt
            FROM cells c JOIN gs USING (source) JOIN gl USING (lang) JOIN gt USING (topic) WHERE c.n > 0
        ), r AS (
            SELECT source, lang, topic, n, n * {mix.keep}::DOUBLE AS x, ts, tl, tt, 0 AS step FROM start
            UNION ALL
            SELECT source, lang, topic, n, least(x * {factor}, n), ts, tl, tt, step + 1 FROM (
                SELECT *, sum(x) OVER (PARTITION BY source) AS ss, sum(x) OVER (PARTITION BY lang) AS sl, sum(x) OVER (PARTITION BY topic) AS st FROM r WHERE step < {3 * mix.rounds})
        ), p AS (SELECT source, lang, topic, x / n AS probability FROM r WHERE step = {3 * mix.rounds})
        SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(coalesce(p.probability, 1.0), 6) AS probability, d.u < coalesce(p.probability, 1.0) AS selected
        FROM d LEFT JOIN p ON p.source = d.source AND p.lang = d.lang AND p.topic = d.topic"""
