"""Content keys and composite identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(text: Column) -> Column:
    """MD5 of the UTF-8 text, as 32 hex digits; null for null."""
    return F.md5(text.cast("binary"))


def compose(*parts: Column | str, sep: str = "|") -> Column:
    """Join parts; a null part makes the id null, which concat_ws would skip."""
    columns: list[Column] = []
    for p in parts:
        if columns:
            columns.append(F.lit(sep))
        columns.append(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"))
    return F.concat(*columns)


CUSTOM_ID = ("dataset", "split", "uid", "doc_id", "dataset_name", "note_type", "prompt", "index", "entailment_type")


def parse_custom_id(custom_id: Column) -> dict[str, Column]:
    """Columns of a 4-part id (dataset|split|int uid|prompt) or a 6-part one (doc|dataset|type|prompt|int index|kind).

    Any other number of parts, or a third (fifth) part that isn't an integer, gives nulls throughout.
    """
    p = F.split(custom_id, r"\|")
    whole = lambda i: F.when(F.get(p, F.lit(i)).rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.trim(F.get(p, F.lit(i))).try_cast("bigint"))
    four = (F.size(p) == 4) & whole(2).isNotNull()
    six = (F.size(p) == 6) & whole(4).isNotNull()
    at = lambda ok, i: F.when(ok, F.get(p, F.lit(i)))
    return {
        "dataset": at(four, 0),
        "split": at(four, 1),
        "uid": F.when(four, whole(2)),
        "doc_id": at(six, 0),
        "dataset_name": at(six, 1),
        "note_type": at(six, 2),
        "prompt": F.when(four | six, F.get(p, F.lit(3))),
        "index": F.when(six, whole(4)),
        "entailment_type": at(six, 5),
    }
