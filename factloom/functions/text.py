"""Text expressions: white space, token estimates, fact lists, templates, names."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in both regular-expression dialects that queries meet, so that results agree.
BLANK = r"[ \t\n\r\f]"


def strip(text: Column) -> Column:
    """Remove white space of all kinds at both ends; trim() would remove spaces alone."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def hypothesis(text: Column) -> Column:
    return F.replace(strip(text), F.lit("\n"), F.lit(" "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")).cast("bigint")


def token_estimate(text: Column) -> Column:
    """Four thirds of the words; a double."""
    return word_count(text) * F.lit(4.0) / F.lit(3.0)


def split_delimited(text: Column, delimiter: str = "//") -> Column:
    """Facts between delimiters, stripped, on one line each. Empty ones stay: an empty text has one empty fact."""
    return F.transform(F.split(text, re.escape(delimiter), -1), hypothesis)


_HEADER = r"(?i)^\s*##[^\n]*Facts:[ \t]*\n?"
_MARK = r"^(?:[0-9]+\.|\*)[ \t]*"


def _bound(value: Column, use) -> Column:
    """use(value), where the value is worked out once a row: it is held by a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_facts(text: Column, drop: tuple[str, ...] = (":", "")) -> Column:
    """Facts of a marked list.

    A header line (`## ... Facts:`) goes; lines are stripped. A line that starts with `N.` or `*` opens a fact; other lines
    continue the open fact on a new line. A text without any mark has a fact on each line that isn't blank.
    """
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, _HEADER, ""), "\n"), strip), lambda s: s != "")

    def grouped(own: Column) -> Column:
        starts = F.filter(F.transform(own, lambda s, i: F.when(s.rlike(_MARK), i)), lambda i: i.isNotNull())
        # Lines before the first mark make up a fact, too.
        begins = F.when(F.get(starts, F.lit(0)) > 0, F.concat(F.array(F.lit(0)), starts)).otherwise(starts)

        def facts(at: Column) -> Column:
            until = lambda k: F.coalesce(F.get(at, k + 1), F.size(own))
            fact = lambda i, k: F.array_join(F.transform(F.slice(own, i + 1, until(k) - i), lambda s, j: F.when(j == 0, F.regexp_replace(s, _MARK, "")).otherwise(s)), "\n")
            return F.transform(at, lambda i, k: strip(fact(i, k)))

        return F.when(F.size(starts) > 0, _bound(begins, facts)).otherwise(own)

    return F.filter(_bound(lines, grouped), lambda s: ~s.isin(*drop))


def split_facts_plain(text: Column, drop: tuple[str, ...] = (":", "")) -> Column:
    """The older rule: cut at every newline that is followed by a mark; what comes first keeps its mark."""
    parts = F.split(F.regexp_replace(text, _HEADER, ""), r"\n\s*(?:\d+\.|\*)\s*")
    return F.filter(F.transform(parts, strip), lambda s: ~s.isin(*drop))


def fill_template(template: str, **values: Column) -> Column:
    """Fill `{name}` placeholders, all at once: a value that contains a placeholder is left as it is."""
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if spec or conversion or name not in values:
                raise ValueError(f"no value for the placeholder {{{name}}}")
            parts.append(values[name])
    return F.concat(*parts) if parts else F.lit("")


def first_match(value: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The name of the first rule whose pattern, without regard to case, occurs in the value."""
    told = None
    for pattern, name in rules:
        test = value.rlike(f"(?i){pattern}")
        told = F.when(test, name) if told is None else told.when(test, name)
    return told.otherwise(otherwise if otherwise is not None else F.lit(None))


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null, not empty, where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def safe_name(model: Column) -> Column:
    return F.translate(model, "/", "_")


def error_text(errors: Column) -> Column:
    """A JSON list of messages, joined by `//`."""
    return F.array_join(F.from_json(errors, "array<string>"), "//")


def text_column(columns: list[str]) -> str:
    """The column of the note: the first that starts with note_text or is TEXT."""
    for c in columns:
        if c.startswith("note_text") or c == "TEXT":
            return c
    raise ValueError(f"no text column among {columns}")


def endpoint(url: str) -> str:
    """The API endpoint in a request's URL."""
    m = re.match(r"^https://[^/]+/v\d+/(.+)$", url) or re.match(r"^https://[^/]+/openai/deployments/[^/]+/(.+?)(?:\?|$)", url)
    if m is None:
        raise ValueError(f"no endpoint in {url}")
    return m[1]
