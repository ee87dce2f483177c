"""Secret scans: base patterns, and sliding-window Shannon entropy per character class.

Everything is one projection over each row (no shuffle, no Python). Positions count code points, ends are
exclusive.

Base kinds (leftmost, non-overlapping per kind, failing matches dropped): `assign`, `access`, `hex`.
Added kinds: a candidate is a maximal run of letters, digits and `+/_=-` of at least the window's length, out of which the
parts that the allow-list names (stand-ins, alphabets, UUIDs) are cut; what is left on either side is a candidate of its own.
`entropy_b64` looks at a candidate as a whole, unless it has only hexadecimal digits; `entropy_hex` looks at each maximal
run of hexadecimal digits in it, so that a key glued to a name by a sign is found. A window slides over either; the number of
each character in the window changes by one in and one out, and with it S = sum of c*log2(c), so that the entropy
log2(W) - S/W is never counted anew. Overlapping windows at or above the class's threshold merge into one span.
Candidates that match a pattern of the allow-list from end to end (words, numbers) have no span; base spans always stay.

Defined results: a null or empty text has no spans. Texts and candidates of any length are scanned whole, in blocks of windows,
and no pattern recurses by the length of a text. Spans with one start are ordered by kind, then by end. Repeated rows give
repeated results; an empty table gives no rows. All columns of the input stay; `base_spans` and `secret_spans` of the input
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bound, running_totals, text_or_empty

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a lower bound in the pattern equals dropping short matches afterwards; the look-behind
#: only saves starts in the middle of a run.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE_CLASS = "[A-Za-z0-9+/_=-]"
HEX_CLASS = "[0-9A-Fa-f]"
ASSIGN_MIN = 12

KINDS = ("assign", "access", "hex", "entropy_b64", "entropy_hex")
ALPHABETS = {
    "entropy_b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
    "entropy_hex": "0123456789ABCDEFabcdef",
}

#: Parts of a candidate that aren't secret, in any case of letters; they are cut out of it.
ALLOW_INSIDE = (
    "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUIDs
    "example", "placeholder", "changeme", "x{6,}",  # stand-ins
    "0123456789", "1234567890", "abcdefghijkl",  # alphabets
)
#: What a candidate is when it is not a secret from end to end. Single classes only: a repeated group would recurse.
ALLOW_WHOLE = (
    "[A-Za-z+/_=-]+",  # words, also joined by signs: paths, identifiers, slugs, borders
    "[0-9]+",  # plain numbers
)


@dataclass(frozen=True)
class EntropyScan:
    window: int = 20  # up to 127, as a counter is a byte
    thresholds: dict = field(default_factory=lambda: {"entropy_b64": 3.65, "entropy_hex": 2.85})
    allow_inside: tuple = ALLOW_INSIDE
    allow_whole: tuple = ALLOW_WHOLE
    block: int = 4096  # windows that are slid over at once


def _located(text: Column, pattern: str, least: int = 0) -> Column:
    """array<struct<start, stop, token>> of all matches; with `least`, of those whose group 1 has as many characters."""
    lengths = lambda parts: F.transform(parts, lambda p: F.length(p).cast("bigint"))

    def spans(found: Column) -> Column:
        # Before the i-th match lie the parts up to it and the matches before it.
        parts = F.split(text, pattern, -1)
        starts = F.zip_with(running_totals(lengths(found)), running_totals(lengths(F.slice(parts, F.lit(1), F.size(found)))), lambda a, b: a + b)
        gaps = lengths(parts)
        return F.zip_with(F.zip_with(found, starts, lambda m, s: F.struct(m.alias("m"), s.alias("s"))), gaps, lambda x, gap: F.when(x.isNotNull(), F.struct((x["s"] + gap).alias("start"), (x["s"] + gap + F.length(x["m"])).alias("stop"), x["m"].alias("token"))))

    located = F.filter(bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans), lambda s: s.isNotNull())
    if least:
        held = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        located = F.filter(F.zip_with(located, held, lambda s, g: F.when(F.length(g) >= least, s)), lambda s: s.isNotNull())
    none = F.array().cast("array<struct<start:bigint,stop:bigint,token:string>>")
    return F.when(text.rlike(pattern), located).otherwise(none)


def _moved(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["stop"] + by).alias("stop"), s["token"].alias("token")))


def _slide(letters: Column, kind: str, scan: EntropyScan) -> Column:
    """array<struct<start, stop>> of merged windows over at least a window of letters (places in the alphabet).

    Counters are bytes, eight to a word; a step changes the words of the letter that comes and the one that goes.
    """
    w = scan.window
    weight = F.array(*[F.lit(float(c * log2(c)) if c else 0.0) for c in range(w + 1)])
    most = (log2(w) - scan.thresholds[kind] + 1e-9) * w
    words = (len(ALPHABETS[kind]) + 7) // 8
    word = lambda x: F.shiftright(x, 3)
    shift = lambda x: x.bitwiseAND(7) * 8
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), shift(x))
    counted = lambda c, x: F.call_function("shiftright", F.get(c, word(x)), shift(x)).bitwiseAND(255).cast("int")
    zero = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), words).alias("count"),
        F.lit(0.0).alias("s"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
    )

    def step(state, i):
        new, old = F.get(letters, i), F.when(i >= w, F.get(letters, i - w)).otherwise(F.lit(-1))
        a, b = counted(state["count"], new), counted(state["count"], old)
        leaves = F.when(old >= 0, F.get(weight, b - 1) - F.get(weight, b)).otherwise(F.lit(0.0))
        s = F.when(new == old, state["s"]).otherwise(state["s"] + F.get(weight, a + 1) - F.get(weight, a) + leaves)
        moved = F.transform(
            state["count"],
            lambda c, j: c + F.when(j == word(new), one(new)).otherwise(F.lit(0)) - F.when((old >= 0) & (j == word(old)), one(old)).otherwise(F.lit(0)),
        )
        count = F.when(new == old, state["count"]).otherwise(moved)
        start, stop = (i - (w - 1)).cast("bigint"), (i + 1).cast("bigint")
        n = F.size(state["spans"])
        last = F.get(state["spans"], n - 1)
        joins = (n > 0) & (last["stop"] >= start)
        before = F.when(joins, F.slice(state["spans"], F.lit(1), n - 1)).otherwise(state["spans"])
        span = F.struct(F.when(joins, last["start"]).otherwise(start).alias("start"), stop.alias("stop"))
        spans = F.when((i >= w - 1) & (s <= most), F.concat(before, F.array(span))).otherwise(state["spans"])
        return F.struct(count.alias("count"), s.alias("s"), spans.alias("spans"))

    return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), zero, step, lambda state: state["spans"])


def _hot_spans(candidate: Column, kind: str, scan: EntropyScan) -> Column:
    """array<struct<start, stop>> of merged windows of one candidate whose entropy reaches the threshold."""
    w, b = scan.window, scan.block
    letters = F.transform(F.split(candidate["token"], ""), lambda c: F.instr(F.lit(ALPHABETS[kind]), c) - 1)

    def in_blocks(letters: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(letters) - w, F.lit(b))
        move = lambda s, at: F.struct((s["start"] + at).alias("start"), (s["stop"] + at).alias("stop"))
        of_block = lambda at: bound(F.slice(letters, at + 1, F.lit(b + w - 1)), lambda own: F.transform(_slide(own, kind, scan), lambda s: move(s, at)))
        return F.flatten(F.transform(starts, of_block))

    def joined(spans: Column) -> Column:
        """Spans of adjoining blocks meet: a span begins where its predecessor ends before it, and ends likewise."""
        n = F.size(spans)
        begins = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["stop"] < s["start"]))
        ends = F.filter(spans, lambda s, i: (i == n - 1) | (F.get(spans, i + 1)["start"] > s["stop"]))
        at = candidate["start"]
        return F.zip_with(begins, ends, lambda x, y: F.struct((x["start"] + at).alias("start"), (y["stop"] + at).alias("stop")))

    return bound(bound(letters, in_blocks), joined)


def _inside(scan: EntropyScan) -> str:
    return f"(?i:{'|'.join(scan.allow_inside)})"


def _entropy(text: Column, scan: EntropyScan) -> Column:
    w = scan.window
    runs = _located(text, f"(?<!{CANDIDATE_CLASS}){CANDIDATE_CLASS}{{{w},}}")
    # Possessive, so that nothing is tried again: either a part of the allow-list, or all that comes before the next one.
    parts = f"{_inside(scan)}|((?:(?!{_inside(scan)}){CANDIDATE_CLASS})++)"
    cut_up = lambda r: F.when(r["token"].rlike(_inside(scan)), _moved(_located(r["token"], parts, w), r["start"])).otherwise(F.array(r))
    candidates = F.flatten(F.transform(runs, cut_up))
    allowed = lambda c: F.lit(False) if not scan.allow_whole else c["token"].rlike("^(?:" + "|".join(scan.allow_whole) + ")$")

    def hot(candidates: Column) -> Column:
        whole = F.filter(candidates, lambda c: ~c["token"].rlike(f"^{HEX_CLASS}+$") & ~allowed(c))
        hexes = F.flatten(F.transform(candidates, lambda c: _moved(_located(c["token"], f"{HEX_CLASS}{{{w},}}"), c["start"])))
        hexes = F.filter(hexes, lambda c: ~allowed(c))
        return F.concat(
            _named(F.flatten(F.transform(whole, lambda c: _hot_spans(c, "entropy_b64", scan))), "entropy_b64"),
            _named(F.flatten(F.transform(hexes, lambda c: _hot_spans(c, "entropy_hex", scan))), "entropy_hex"),
        )

    return bound(candidates, hot)


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, text: str = "text", scan: EntropyScan | None = None) -> DataFrame:
    """Add `base_spans` and `secret_spans`: array<struct<start, rank, stop, kind>> by start, then kind."""
    scan = scan or EntropyScan()
    t = text_or_empty(text)
    base = [_named(_located(t, ASSIGN, ASSIGN_MIN), "assign"), _named(_located(t, ACCESS), "access"), _named(_located(t, HEX), "hex")]
    out = docs.withColumn("base_spans", F.array_sort(F.concat(*base)))
    return out.withColumn("secret_spans", F.array_sort(F.concat(F.col("base_spans"), _entropy(t, scan))))


def _told(spans: str) -> Column:
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The thin result: one row per row of `docs`, with counts per base kind and spans as text."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter(F.col("base_spans"), lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_told("base_spans").cast("binary"), 256).alias("base_sha256"),
        _told("secret_spans").alias("spans"),
    )


def oracle(scan: EntropyScan | None = None) -> str:
    """DuckDB SQL for secret_digest: every window's entropy is counted anew there."""
    scan = scan or EntropyScan()
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def either(word: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    assign = f"""(?:{words})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    patterns = [assign, ACCESS, "[0-9a-f]{16,}", f"{CANDIDATE_CLASS}{{{scan.window},}}"]
    located = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS rank, unnest(found) AS token, unnest(groups) AS held, unnest(list_transform(range(1, len(found) + 1), lambda i:
                list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0)))::BIGINT AS start
            FROM (SELECT doc_id, regexp_extract_all(t, {quoted(p)}) AS found, regexp_extract_all(t, {quoted(p)}, {1 if k == 0 else 0}) AS groups, regexp_split_to_array(t, {quoted(p)}) AS pieces
                  FROM d WHERE regexp_matches(t, {quoted(p)}))"""
        for k, p in enumerate(patterns)
    )
    whole = "|".join(scan.allow_whole)
    allowed = f"regexp_full_match(token, {quoted(whole)})" if whole else "false"
    w, inside, hexes = scan.window, quoted(_inside(scan)), quoted(f"{HEX_CLASS}{{{scan.window},}}")

    def taken(source: str, pattern: str, which: str) -> str:
        """The parts of `source`'s tokens that match (found) or lie between matches (pieces), with their starts."""
        upto = "i" if which == "found" else "i - 1"
        return f"""SELECT doc_id, {which}[i] AS token, (start + coalesce(list_sum(list_transform(pieces[1:{upto}], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0))::BIGINT AS start
            FROM (SELECT *, unnest(range(1, len({which}) + 1)) AS i FROM (SELECT doc_id, start, regexp_extract_all(token, {pattern}) AS found, regexp_split_to_array(token, {pattern}) AS pieces FROM {source}))"""

    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
        ), m AS ({located}
        ), base AS (
            SELECT doc_id, rank, start, start + length(token) AS stop FROM m WHERE rank < 3 AND (rank > 0 OR length(held) >= {ASSIGN_MIN})
        ), long_runs AS (SELECT * FROM m WHERE rank = 3
        ), seg AS (SELECT * FROM ({taken("long_runs", inside, "pieces")}) WHERE length(token) >= {w}
        ), cand AS (
            SELECT *, false AS is_hex FROM seg WHERE NOT regexp_full_match(token, '{HEX_CLASS}+') AND NOT {allowed}
            UNION ALL SELECT *, true FROM ({taken("seg", hexes, "found")}) WHERE NOT {allowed}
        ), win AS (
            SELECT doc_id, start, is_hex, i, list_sum(list_transform(list_distinct(cs), lambda c: -(len(list_filter(cs, lambda x: x = c)) / {w}.0) * log2(len(list_filter(cs, lambda x: x = c)) / {w}.0))) AS h
            FROM (SELECT doc_id, start, is_hex, i, string_split(substr(token, i + 1, {w}), '') AS cs FROM (SELECT *, unnest(range(0, length(token) - {w} + 1)) AS i FROM cand))
        ), hot AS (
            SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, start, is_hex ORDER BY i) <= {w} THEN 0 ELSE 1 END AS fresh
            FROM win WHERE h >= CASE WHEN is_hex THEN {scan.thresholds["entropy_hex"]} ELSE {scan.thresholds["entropy_b64"]} END - 1e-9
        ), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, start, is_hex ORDER BY i) AS run FROM hot
        ), added AS (
            SELECT doc_id, CASE WHEN is_hex THEN 4 ELSE 3 END AS rank, start + min(i) AS start, start + max(i) + {w} AS stop FROM runs GROUP BY doc_id, start, is_hex, run
        ), allspans AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM added
        ), told AS (
            SELECT doc_id, is_base, rank, start, stop, {list(KINDS)}[rank + 1] || ':' || start || ':' || stop AS s FROM allspans
        ), g AS (
            SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
                   coalesce(string_agg(s, ',' ORDER BY start, rank, stop) FILTER (is_base), '') AS base, string_agg(s, ',' ORDER BY start, rank, stop) AS spans
            FROM told GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""
