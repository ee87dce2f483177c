"""From a judge's free answer to a 0/1 verdict.

Order of the rules: an object's `entailment_prediction` (in strict JSON, or in the outermost braces of the answer); a digit
at the end; the words `entailment` (1), `neutral` (0), `yes` (1), `no` (0), wherever they stand; else nothing. A verdict that
isn't 0, 1 or a truth value is unparseable, and counts as 0. A number in quotes is unparseable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import unused

FIELD = "$.entailment_prediction"


def parse_json(answer: Column) -> Column:
    """A variant, or null. Strict: single quotes aren't JSON, and the lenient JSON functions are of no use here."""
    return F.coalesce(F.try_parse_json(answer), F.try_parse_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1)))


def _told(answer: Column, v: Column) -> dict[str, Column]:
    field = F.try_variant_get(v, FIELD, "variant")
    present = field.isNotNull()
    kind = F.schema_of_variant(field)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(v, FIELD, "boolean").cast("double")).when(
        kind != "STRING", F.try_variant_get(v, FIELD, "double")
    )
    low = F.lower(answer)
    said = (
        F.when(answer.rlike("[0-9]$"), F.right(answer, F.lit(1)).try_cast("int"))
        .when(low.contains("entailment"), 1)
        .when(low.contains("neutral"), 0)
        .when(low.contains("yes"), 1)
        .when(low.contains("no"), 0)
    )
    raw = F.when(present, F.try_variant_get(v, FIELD, "string")).otherwise(said.cast("string"))
    return {"raw": raw, "value": F.when(present, number).otherwise(said.cast("double"))}


def with_verdict(df: DataFrame, answer: str, names: tuple[str, str, str] = ("raw", "not_parseable", "prediction")) -> DataFrame:
    """`df` with the verdict of a column of answers: raw (string), not_parseable (boolean), prediction (int).

    An answer is parsed in a projection of its own, and what it says is read in another one, so that each row is parsed once, whatever uses the verdict.
    """
    parsed, raw, value = unused([*df.columns, *names], "parsed", "raw", "value")
    a = F.col(answer)
    # Only an object can hold the field.
    rows = df.withColumn(parsed, F.when(a.contains("{"), parse_json(a)))
    told = _told(a, F.col(parsed))
    rows = rows.select(*df.columns, told["raw"].alias(raw), told["value"].alias(value))
    good = F.coalesce(F.col(value).isin(0.0, 1.0), F.lit(False))
    outputs = F.col(raw), ~good, F.when(good, F.col(value)).otherwise(0).cast("int")
    return rows.select(*df.columns, *[c.alias(n) for c, n in zip(outputs, names)])


def map_unparseable(prediction: Column, unparseable: Column, to: int) -> Column:
    """-1: null, which callers drop; 0 or 1: what an unparseable answer counts as."""
    if to not in (-1, 0, 1):
        raise ValueError("unparseable answers map to -1, 0 or 1")
    return F.when(unparseable, F.lit(None if to == -1 else to)).otherwise(prediction)
